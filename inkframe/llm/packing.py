"""Best-fit packing of tokenised documents, planned on the histogram of lengths."""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm.store import written

#: Tokens a sequence holds, and the id that ends each document.
LENGTH, END = 2048, 0


@cache
def encoder(ranks: bytes, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """The byte-level BPE of a file of ranks and of ``added`` tokens, once a process."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(x): int(n) for x, n in (line.split() for line in ranks.splitlines() if line)}, special_tokens=dict(added))


#: White space as the pattern has it, so much of it in a row that the pattern's look ahead may run out of stack.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def ids_of(enc, text: str) -> list[int]:
    """The ids of a text of any kind and length.

    The pattern never matches across the border from other text to white space, and of white space all but the last character
    before other text, all of it before an added token or the end, is one match. So a long run of it is encoded as one word, without the pattern, and what lies around it apart.
    """
    out: list[int] = []
    at, added = 0, tuple(enc.special_tokens_set)
    for m in _BLANKS.finditer(text):
        last = m.end() - (m.end() < len(text) and not text.startswith(added, m.end()))
        out += enc.encode(text[at : m.start()], allowed_special="all")
        out += enc._encode_single_piece(text[m.start() : last])
        at = last
    return out + enc.encode(text[at:], allowed_special="all") if at else enc.encode(text, allowed_special="all")


def pieces_of(docs: DataFrame, ranks: bytes, pattern: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """(part, id, piece, start, length, ids_crc32[, ids]) of every document's pieces of at most ``length`` ids.

    A document is its text's ids and then END, so an empty or null text is one piece of one id. Longer ones
    are cut into full pieces; their first piece takes what is left over. ``part`` is the task that read it.
    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers; ``ids`` are those bytes.
    Strings of ``added`` tokens get their own id wherever a text holds them; other special strings are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern, added)
        for b in batches:
            doc, piece, start, size, crc, body = [], [], [], [], [], []
            for k, text in enumerate(b.column(2)):
                ids = np.array([*ids_of(enc, text.as_py() or ""), END], "<u4")
                at, n = 0, len(ids) % length or length
                for p in range(-(-len(ids) // length)):
                    part = ids[at : at + n].tobytes()
                    doc.append(k), piece.append(p), start.append(at), size.append(n), crc.append(zlib.crc32(part))
                    if with_ids:
                        body.append(part)
                    at, n = at + n, length
            k = pa.array(doc, pa.int32())
            columns = [b.column(0).take(k), b.column(1).take(k), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["part", "id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(body, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"part int, id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], length: int = LENGTH) -> pd.DataFrame:
    """Best-fit decreasing over a histogram of lengths: runs (size, rank, n, sequence, offset), sizes ascending.

    The run's piece of rank ``rank + i`` among those of its size goes to sequence ``sequence + i`` at
    ``offset``, for i < n. Sequences with equal free space are kept as ranges of numbers, and a run fills
    one range or a part of it, so the work and the plan follow the number of lengths, not of documents.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # by free space: ranges (first sequence, how many)
    spaces: list[int] = []
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def add(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            k = bisect.bisect_left(spaces, size)
            if k == len(spaces):
                first, n, space = opened, min(left, -(-left // (length // size))), length
                opened += n
            else:
                space = spaces[k]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[k]
            used = min(n, left)
            rows.append((size, rank, used, first, length - space))
            add(space - size, first, used)
            add(space, first + used, n - used)
            rank, left = rank + used, left - used
    return pd.DataFrame(sorted(rows), columns=["size", "rank", "n", "sequence", "offset"]).astype("int64")


def pack(docs: DataFrame, ranks: bytes, pattern: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of every document.

    The pieces are written once. Two small tables follow: pieces by (task, length), from which a running
    sum gives each task's first rank within a length, and pieces by length (at most ``length`` rows, the
    only rows that reach the driver), from which the slots are planned. A piece's rank within its length
    is its task's first rank plus its place there, so a length that a third of all pieces share is still
    spread over all tasks. Null ids, repeated rows and extra columns are fine: a row is a document.
    """
    table = written(pieces_of(docs, ranks, pattern, length, id_col, text_col, with_ids, added), "pieces")
    by_task = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = written(by_task, "piece-lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(histogram, length)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("part", "length").orderBy("id", "piece", "start", "ids_crc32")
    ranked = table.withColumn("rank", F.row_number().over(within)).join(firsts.hint("shuffle_merge"), ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first") - 1).drop("part", "first")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = np.int64(1) << 40
        keys = (slots["size"] * width + slots["rank"]).to_numpy()
        sequence, rank, offset = (slots[c].to_numpy() for c in ("sequence", "rank", "offset"))
        for f in frames:
            k = np.searchsorted(keys, (f["length"] * width + f["rank"]).to_numpy(), "right") - 1
            f["sequence_id"], f["offset"] = sequence[k] + f["rank"].to_numpy() - rank[k], offset[k]
            yield f.drop(columns="rank")

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields if f.name != "rank"} | {"sequence_id": "long", "offset": "long"}
    placed = ranked.mapInPandas(place, ", ".join(f"{k} {v}" for k, v in kinds.items()))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")
