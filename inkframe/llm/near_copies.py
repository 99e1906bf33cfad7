"""Near copies by the Jaccard similarity of word shingles.

Fingerprints propose pairs by vantage-point trees, and MinHash bands those that no radius of fingerprints
reaches; every link is measured exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm.graph import connected_components
from inkframe.llm.store import join_hot, written

#: Words a shingle, and the least similarity of near copies as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Bands and MinHashes a band. A pair of similarity s shares none with probability (1 - s**ROWS) ** BANDS: 0.000005 at 0.8.
BANDS, ROWS = 40, 6
SEED, CHUNK = 42, 8192
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(data: bytes) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of a UTF-8 text's runs of SHINGLE words (fewer words: one run of all; none: none)."""
    words = data.lower().split()  # bytes: lower() changes A-Z only and split() takes exactly space, \\t-\\r
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(w, SEED) for w in words], np.uint64)
    out = np.zeros(n - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = out * _STEP + h[k : k + len(out)]
    return np.unique(_mixed(out))


def bands(own: np.ndarray) -> np.ndarray:
    """The BANDS keys (signed longs) of a set of shingles that isn't empty."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), CHUNK):
        np.minimum(low, (x[i : i + CHUNK] * _TIMES + _PLUS).min(axis=1), out=low)
    out = np.arange(BANDS, dtype=np.uint64)
    for m in low.reshape(BANDS, ROWS).T:
        out = _mixed((out ^ m.astype(np.uint64)) * _STEP)
    return out.view(np.int64)


def are_near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have at least LEAST of their union in common."""
    p, q = LEAST
    if min(len(a), len(b)) * q < max(len(a), len(b)) * p:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * q >= (len(a) + len(b) - both) * p


def fingerprint(own: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(own), CHUNK):
        ones += np.unpackbits(own[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(ones * 2 > len(own)).tolist())


def _digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def digest(text: Column) -> Column:
    """A digest of each text's set of shingles (null: empty), that of ``classes``."""

    @F.pandas_udf("binary")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series([_digest(shingles(x)) for x in s], dtype=object)

    return run(F.coalesce(text.cast("binary"), F.lit("").cast("binary")))


def _data(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own, fp, bands) of every row: a digest of its set of shingles, its fingerprint and its bands (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(_bytes(x)) for x in b.column(1)]
            fps = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            columns = [b.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(fps), pa.array([bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "own", "fp", "bands"])

    rows = _data(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, own binary, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, words) of ``wanted`` (node, id, own): the shingles as bytes, of a row of that id with that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(_bytes(x)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "own", "words"])

    rows = _data(docs, id_col, text_col).join(wanted.select("id").hint("shuffle_hash"), "id", "left_semi")
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, own binary, words binary")
    return found.groupBy("id", "own").agg(F.first("words").alias("words")).join(wanted.hint("shuffle_hash"), ["id", "own"]).select("node", "words")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b; a written table) that are near copies. Pairs are as many on one id as there may be."""

    def side(k: str) -> DataFrame:
        return written(sets.join(pairs.groupBy(k).agg(F.count(F.lit(1)).alias(f"n_{k}")), F.col("node") == F.col(k)).select(k, f"n_{k}", F.col("words").alias(f"words_{k}")), "near-sets")

    one = written(join_hot(pairs, side("b"), "b", "n_b").drop("n_b"), "near-pairs")
    both = join_hot(one, side("a"), "a", "n_a").select("a", "b", "words_a", "words_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(_bytes(w), np.uint64) for w in b.column(k)] for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array([are_near(s, t) for s, t in zip(x, y)], pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return written(both.mapInArrow(run, f"a {kind}, b {kind}"), "near-links")


def prefix_pairs(table: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of rows of ``table`` (id, class, words) of different class, no pair of LEAST or more missing.

    Two sets that have LEAST of their union in common share one of their first n - ceil(n * LEAST) + 1 shingles in
    any order common to all (Chaudhuri et al., 2006); here the rarest of ``table`` come first. What either set
    has before the first shared one it has alone, which bounds what they share (Xiao et al., 2008). So members of a
    large group that differ too much meet in next to no row, however much the group shares.
    """
    p, q = LEAST

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = np.frombuffer(_bytes(b.column(2)[k]), np.int64)
                at = pa.array(np.full(len(own), k, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(own), len(own), np.int64)), pa.array(own)], names=["id", "class", "size", "h"])

    kind = table.schema["id"].dataType.simpleString()
    each = written(table.select("id", "class", "words").mapInArrow(spread, f"id {kind}, class {kind}, size long, h long"), "near-shingles")
    counts = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-counts")
    common = join_hot(each, counts, "h", "n").groupBy("id", "class", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("common"))
    alone = F.col("size") - F.size("common")
    first = F.floor((F.col("size") * (q - p)) / q) + 1 - alone
    heads = common.where(first > 0).select("id", "class", "size", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), first.cast("int"))["h"]).alias("k", "h"))
    heads = written(heads.select("id", "class", "size", (F.col("alone") + F.col("k")).alias("before"), "h"), "near-heads")
    left, right = (heads.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "class", "size", "before"))) for x in "ab")
    enough = " AND ".join(f"(size_{x} - before_{x}) * {p + q} >= (size_a + size_b) * {p}" for x in "ab")
    pairs = left.join(right, "h").where(f"id_a < id_b AND class_a <> class_b AND {enough}")
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, own, class, component) of every row; component is the smallest id reachable over near copies (null if no row of it has an id).

    Rows with equal sets of shingles (``own``, their digest) are one node, named by 64 bits of a hash; ``class``
    is the smallest node reachable. ``link`` gives edges (a, b) between the rows of a table (fp, rep) of distinct
    fingerprints. Its edges, and each band's members with the one that meets most others in all its bands, which
    is what the others vary, are measured first; that joins groups of near copies at a cost in proportion to
    their size. Members of bands that are still apart are then compared by ``prefix_pairs``. So every pair of LEAST or more that shares a band is linked, and none below it.
    """
    rows = written(sketches(docs, id_col, text_col), "near-sketches")
    nodes = written(rows.groupBy("own").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).withColumn("node", F.xxhash64("own")), "near-nodes")
    known = nodes.where("rep IS NOT NULL")
    keys = written(known.select("node", F.explode("bands").alias("band")), "near-bands")
    groups = written(keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-groups")
    members = written(join_hot(keys, groups, "band", "n"), "near-members")
    meets = members.groupBy("node").agg(F.sum("n").alias("met"))
    middle = members.join(meets, "node").groupBy("band").agg(F.max(F.struct("met", "node"))["node"].alias("first"), F.count(F.lit(1)).alias("n"))
    members = members.select("band", "node")
    proposed = join_hot(members, written(middle, "near-middles"), "band", "n").where("node <> first").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))
    if link is not None:
        prints = written(known.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "near-prints")
        equal = join_hot(known.select("fp", "node"), prints, "fp", "n").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        found = link(prints.select("fp", F.col("first").alias("rep"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        proposed = proposed.unionByName(equal).unionByName(found)
    proposed = written(proposed.distinct(), "near-pairs")
    wanted = proposed.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    wanted = known.select("node", F.col("rep").alias("id"), "own").join(wanted, "node", "left_semi")
    sets = written(_sets(docs, written(wanted, "near-wanted"), id_col, text_col), "near-words")
    links = _measured(proposed, sets)

    joined = connected_components(links)
    now = written(members.join(joined, "node", "left").select("band", "node", F.coalesce("component", "node").alias("class")), "near-members")
    apart = now.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("band")
    rest = written(now.join(apart, "band", "left_semi").select(F.col("node").alias("id"), "class").distinct(), "near-apart")
    if not rest.isEmpty():
        more = written(prefix_pairs(written(sets.withColumnRenamed("node", "id").join(rest, "id"), "near-rest")), "near-pairs")
        if not more.isEmpty():
            joined = connected_components(links.unionByName(_measured(more, sets)))

    found = written(nodes.join(joined, "node", "left").select("own", "n", "rep", F.coalesce("component", "node").alias("class")), "near-classes")
    smallest = written(found.groupBy("class").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("m")), "near-smallest")
    found = written(join_hot(found, smallest, "class", "m").select("own", "n", "class", "component"), "near-classes")
    return join_hot(rows.select("id", "own"), found, "own", "n").select("id", "own", "class", "component")
