"""Byte-level BPE by DuckDB recursive queries within each partition."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Contractions that one recursive query makes a word; words that need more enter the next query. This
#: bounds the rows a query keeps, as each contraction leaves a copy of the word's tokens.
ROUNDS = 24
#: Bytes of a word that one recursive query sees; longer words are put together from such pieces. Tokens on
#: each side of a border between pieces that are encoded again with it, at first.
PIECE, NEAR = 64, 4
#: Words whose ids a worker remembers, rows that one query may come to (32 bytes each), and characters of text
#: whose words are looked up at a time (a longer text is one lookup of its own).
REMEMBERED, ROWS, CHARACTERS = 800_000, 6_000_000, 6_000_000

#: One row a token position, at ``spot`` = word * 2^32 + place in the word. A pair's merge has the id of the
#: merged token, which is its rank, so a word's smallest ``merged * 2^32 + place`` is the leftmost of its
#: pairs of lowest rank. A word without a pair has no such number and takes no further part.
ENCODE = """
WITH RECURSIVE state(step, spot, id, best) AS (
    WITH pairs AS (
        SELECT a.spot >> 32 AS word, min((merged << 32) | (a.spot & 4294967295)) AS best
        FROM start AS a JOIN start AS b ON b.spot = a.spot + 1 JOIN merges ON pair = (a.id << 20) | b.id GROUP BY 1
    )
    SELECT 0, spot, id, best FROM start LEFT JOIN pairs ON word = spot >> 32
    UNION ALL
    (WITH shorter AS MATERIALIZED (
        SELECT step + 1 AS step, CASE WHEN spot & 4294967295 > best & 4294967295 THEN spot - 1 ELSE spot END AS spot,
               CASE WHEN spot & 4294967295 = best & 4294967295 THEN best >> 32 ELSE id END AS id
        FROM state WHERE best IS NOT NULL AND step < $rounds AND spot & 4294967295 <> (best & 4294967295) + 1
    ), pairs AS (
        SELECT a.spot >> 32 AS word, min((merged << 32) | (a.spot & 4294967295)) AS best
        FROM shorter AS a JOIN shorter AS b ON b.spot = a.spot + 1 JOIN merges ON pair = (a.id << 20) | b.id GROUP BY 1
    )
    SELECT step, spot, id, best FROM shorter LEFT JOIN pairs ON word = spot >> 32)
)
SELECT spot >> 32 AS word, list(id ORDER BY spot) AS ids, any_value(best) IS NULL AS done
FROM state WHERE best IS NULL OR step = $rounds GROUP BY word
"""

#: Tokens of each word put together again in the order of their positions.
DECODE = """
SELECT word, string_agg(hex(bytes), '' ORDER BY seq) AS data
FROM tokens JOIN vocabulary USING (id) GROUP BY word
"""


class Codec:
    """Encoder and decoder of one process, with the merge table in an in-memory DuckDB of one thread."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(x): int(n) for x, n in (line.split() for line in ranks.splitlines() if line)}
        self.find = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        self.tokens = {n: t for t, n in self.ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.ids: dict[str, str] = {}
        self.data: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": "", "preserve_insertion_order": False})
        split = [(self.ranks[t[:k]], self.ranks[t[k:]], n) for t, n in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        merges = pa.table({"pair": pa.array([x << 20 | y for x, y, _ in split], pa.int64()), "merged": pa.array([n for _, _, n in split], pa.int64())})
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "bytes": pa.array(self.ranks.keys(), pa.binary())})
        self.db.register("m", merges)
        self.db.register("v", vocabulary)
        self.db.execute("CREATE TABLE merges AS FROM m; CREATE TABLE vocabulary AS FROM v")
        self.db.unregister("m")
        self.db.unregister("v")

    def _query(self, sql: str, name: str, table: dict[str, np.ndarray], **given) -> pa.Table:
        self.db.register(name, pa.table(table))
        try:
            return self.db.sql(sql, params=given or None).to_arrow_table()
        finally:
            self.db.unregister(name)

    def contracted(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word by contracting its leftmost pair of lowest rank until there is none."""
        out: list[np.ndarray | None] = [None] * len(words)
        work: list[tuple[int, np.ndarray]] = []
        for k, w in enumerate(words):
            if w in self.ranks:
                out[k] = np.array([self.ranks[w]], np.int64)
            else:
                work.append((k, self.bytes[np.frombuffer(w, np.uint8)]))
        work.sort(key=lambda x: len(x[1]))  # long words last, so first to be taken
        while work:
            now, rows = [], 0
            while work and (not now or rows + len(work[-1][1]) * min(ROUNDS, len(work[-1][1])) <= ROWS):
                now.append(work.pop())
                rows += len(now[-1][1]) * min(ROUNDS, len(now[-1][1]))
            n = np.array([len(ids) for _, ids in now])
            word = np.repeat(np.arange(len(now)), n)
            seq = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            got = self._query(ENCODE, "start", {"spot": word << 32 | seq, "id": np.concatenate([ids for _, ids in now])}, rounds=ROUNDS)
            ids = got["ids"].combine_chunks()
            cuts, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
            for j, (w, done) in enumerate(zip(got["word"].to_pylist(), got["done"].to_pylist())):
                own = flat[cuts[j] - cuts[0] : cuts[j + 1] - cuts[0]]
                if done:
                    out[now[w][0]] = own
                else:
                    work.append((now[w][0], own))
        return out

    def _fit(self, pairs: list[tuple[int, int]]) -> None:
        """Notes for each pair of tokens whether their bytes are encoded as just these two."""
        new = list(set(pairs).difference(self.fits))
        if len(self.fits) + len(new) > REMEMBERED:
            self.fits, new = {}, list(set(pairs))
        said = self.contracted([self.tokens[a] + self.tokens[b] for a, b in new])
        self.fits.update((p, tuple(x.tolist()) == p) for p, x in zip(new, said))

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; a word that is itself a token is that token.

        A word of over PIECE bytes is contracted piece by piece. Tokens are a text's encoding if and only if
        the bytes of every two neighbours are encoded as these two: of the contractions that would cross a
        border, the first sees on its two sides what it would see with these two tokens alone. Neighbours
        from one contraction fit, so only borders are tested; around one that doesn't fit, some tokens on
        both sides are contracted together, with new borders where they end, and more of them each round.
        """
        short = [k for k, w in enumerate(words) if len(w) <= PIECE or w in self.ranks]
        out: list[np.ndarray | None] = [None] * len(words)
        for k, ids in zip(short, self.contracted([words[k] for k in short])):
            out[k] = ids
        long = [k for k in range(len(words)) if out[k] is None]
        cut = {k: [words[k][i : i + PIECE] for i in range(0, len(words[k]), PIECE)] for k in long}
        known = list(dict.fromkeys(p for k in long for p in cut[k]))
        ids_of = dict(zip(known, [x.tolist() for x in self.contracted(known)]))
        parts = {k: [list(ids_of[p]) for p in cut[k]] for k in long}
        near = NEAR
        while parts:
            self._fit([(a[-1], b[0]) for own in parts.values() for a, b in zip(own, own[1:])])
            again: list[tuple[int, int, bytes]] = []
            for k in list(parts):
                own = [parts[k][0]]
                given = fresh = False  # whether the last part has given tokens away this round, or is the bytes to be contracted
                for part in parts[k][1:]:
                    if fresh or given and not self.fits[own[-1][-1], part[0]]:
                        own.append(part)
                        given = fresh = False
                    elif self.fits[own[-1][-1], part[0]]:
                        own[-1].extend(part)
                        given = False
                    else:
                        middle, before, after = own[-1][-near:] + part[:near], own[-1][:-near], part[near:]
                        own[-1:] = [before] if before else []
                        again.append((k, len(own), b"".join(map(self.tokens.__getitem__, middle))))
                        own += [middle, after] if after else [middle]
                        given, fresh = True, not after
                parts[k] = own
            for (k, at, _), ids in zip(again, self.contracted([w for _, _, w in again])):
                parts[k][at] = ids.tolist()
            for k in [k for k, own in parts.items() if len(own) == 1]:
                out[k] = np.array(parts.pop(k)[0], np.int64)
            near *= 2
        return out

    def decoded(self, ids: list[np.ndarray]) -> list[bytes]:
        n = np.array([len(x) for x in ids], np.int64)
        if not n.sum():
            return [b""] * len(ids)
        seq = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        got = self._query(DECODE, "tokens", {"word": np.repeat(np.arange(len(ids)), n), "seq": seq, "id": np.concatenate(ids)})
        out = [b""] * len(ids)
        for w, data in zip(got["word"].to_pylist(), got["data"].to_pylist()):
            out[w] = bytes.fromhex(data)
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes the words not known yet and decodes their ids again; forgets all when there are too many."""
        new = list(words.difference(self.ids))
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids, self.data = {}, {}
            new = list(words)
        for i in range(0, len(new), 100_000):
            part = new[i : i + 100_000]
            ids = self.merged([w.encode() for w in part])
            self.data.update(zip(part, self.decoded(ids)))
            self.ids.update(zip(part, [" ".join(map(str, x.tolist())) for x in ids]))

    def texts(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """(decimal ids joined by blanks, decoded bytes) of each text."""
        words = [self.find(t) for t in texts]
        self.learn(set().union(*words))
        for own in words:
            yield " ".join(map(self.ids.__getitem__, own)), b"".join(map(self.data.__getitem__, own))


@cache
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids array<int>, decoded]) of every row.

    ``ranks`` are the bytes of a file of base64 tokens and ranks (a fixed vocabulary, so it travels with the
    plan), ``pattern`` the pre-tokeniser's. Each match is encoded by itself and without special tokens.
    Null texts are empty: no tokens. Null ids, repeated rows and extra columns are fine; order of rows is
    free. Each distinct word of a batch is encoded and decoded once, whatever the texts repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                texts, size = [], 0
                while lo + len(texts) < b.num_rows and size < CHARACTERS:
                    texts.append(b.column(1)[lo + len(texts)].as_py() or "")
                    size += len(texts[-1])
                part = b.slice(lo, len(texts))
                lo += len(texts)
                said = list(c.texts(texts))
                columns = [
                    part.column(0), pa.array([ids.count(" ") + (ids != "") for ids, _ in said], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in said], pa.string()), pa.array([hashlib.sha256(data).hexdigest() for _, data in said], pa.string()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([[int(i) for i in ids.split()] for ids, _ in said], pa.list_(pa.int32())), pa.array([data for _, data in said], pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids)
    return out.withColumnRenamed("id", id_col)
