"""SimHash near-duplicates: fingerprints of word shingles, linked by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import near_copies
from inkframe.llm.graph import connected_components, spanning_edges
from inkframe.llm.store import hashed_sample, join_hot, written

#: Words a shingle, hash seed, and the number of differing bits up to which two fingerprints link.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints a shard should hold, if there are so many that SHARDS are too few as many as LARGEST, and the number of them that the driver may see to place the shards' pivots.
SHARD, SHARDS, LARGEST, SAMPLE = 32_768, 256, 1 << 20, 32_768
#: Members of a leaf within a shard; shingles and queries handled at a time.
LEAF, CHUNK, QUERIES = 64, 65_536, 16_384


def fingerprint(data: bytes) -> int:
    """The 64-bit SimHash of one UTF-8 text: majority of the bits of its shingles' XXH64, zero without words."""
    words = data.lower().split()  # bytes: lower() changes A-Z only and split() takes exactly space, \\t-\\r
    n = len(words)
    if not n:
        return 0
    h64 = xxhash.xxh64_intdigest
    if n < SHINGLE:
        return h64(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - SHINGLE]]).tolist()
    ends = (ends[SHINGLE - 1 :] - 1).tolist()
    total = n - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for i in range(0, total, CHUNK):
        h = np.array([h64(joined[s:e], SEED) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > total).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row: the fingerprint's bits as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class VantageTree:
    """A vantage-point tree under Hamming distance.

    A node keeps a pivot and a radius; members at most the radius away lie inside. By the triangle
    inequality a query within ``reach`` of a member needs the inside only if d - reach <= radius and the
    outside only if d + reach > radius, d being its distance from the pivot.
    """

    def __init__(self, members: np.ndarray, leaf: int, seed: int = 1, tries: int = 8, reach: int = RADIUS):
        rng = np.random.default_rng(seed)
        self.pivot, self.radius, self.inside, self.outside, self.first, self.last = [], [], [], [], [], []
        order = np.arange(len(members))
        todo = [(self._node(0, len(members)), 0, len(members))]
        while todo:
            k, lo, hi = todo.pop()
            if hi - lo <= leaf:
                continue
            own = members[order[lo:hi]]
            best = None
            for p in rng.choice(own, min(tries, len(own)), replace=False):
                d = np.bitwise_count(own ^ p)
                mu = int(np.median(d))
                if (d <= mu).all():
                    mu -= 1
                inside = int((d <= mu).sum())
                if not 0 < inside < len(own):
                    continue
                cost = max(inside, len(own) - inside) + int(((d - np.int16(reach) <= mu) & (d + np.int16(reach) > mu)).sum())
                if best is None or cost < best[0]:
                    best = (cost, p, mu, d <= mu)
            if best is None:
                continue
            _, p, mu, near = best
            part = order[lo:hi]
            mid = lo + int(near.sum())
            order[lo:hi] = np.concatenate([part[near], part[~near]])
            self.pivot[k], self.radius[k] = p, mu
            self.inside[k], self.outside[k] = self._node(lo, mid), self._node(mid, hi)
            todo += [(self.inside[k], lo, mid), (self.outside[k], mid, hi)]
        self.order = order
        self.pivot, self.radius = np.array(self.pivot, np.uint64), np.array(self.radius, np.int16)
        self.inside, self.outside = np.array(self.inside), np.array(self.outside)

    def _node(self, lo: int, hi: int) -> int:
        for column, x in zip((self.pivot, self.radius, self.inside, self.outside, self.first, self.last), (0, 0, -1, -1, lo, hi)):
            column.append(x)
        return len(self.pivot) - 1

    def visit(self, queries: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(query's index, leaf) for each leaf that can hold members within reach; reach 0: each query's own leaf."""
        q, at = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        done_q, done_at = [], []
        while len(q):
            leaf = self.inside[at] < 0
            done_q.append(q[leaf])
            done_at.append(at[leaf])
            q, at = q[~leaf], at[~leaf]
            d = np.bitwise_count(queries[q] ^ self.pivot[at]).astype(np.int16)
            near, far = d - reach <= self.radius[at], d + reach > self.radius[at]
            q, at = np.concatenate([q[near], q[far]]), np.concatenate([self.inside[at[near]], self.outside[at[far]]])
        return np.concatenate(done_q or [q]), np.concatenate(done_at or [at])


def linked_pairs(members: np.ndarray, queries: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (query, member) of all pairs with query < member and at most ``radius`` differing bits, some queries at a time."""
    tree = VantageTree(members, leaf)
    for i in range(0, len(queries), QUERIES):
        part = queries[i : i + QUERIES]
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        q, at = tree.visit(part, radius)
        by = np.argsort(at, kind="stable")
        q, at = q[by], at[by]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            if s == e:
                continue
            own = tree.order[tree.first[at[s]] : tree.last[at[s]]]
            for o in range(0, len(own), 8192):
                block = own[o : o + 8192]
                for c in range(s, e, 2048):
                    qs = q[c : min(c + 2048, e)]
                    x, y = np.nonzero(np.bitwise_count(part[qs][:, None] ^ members[block][None, :]) <= radius)
                    keep = part[qs[x]] < members[block[y]]
                    found.append((qs[x[keep]] + i, block[y[keep]]))
        yield tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def link_fingerprints(table: DataFrame, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all of ``table`` (fp, distinct; rep) within ``radius`` bits of one another.

    The driver fits a tree over about SAMPLE fingerprints, until its leaves are shards of about ``shard``
    members. Every fingerprint lives in one shard and queries each shard that the triangle bounds leave
    open, so each pair meets; within a shard a second tree prunes further. Pairs shrink to stars as they are found.
    """
    n = table.count()
    shard = shard or max(SHARD, min(LARGEST, n // SHARDS))
    seen = hashed_sample(table.select("fp", F.xxhash64("fp").alias("h")), "h", n, SAMPLE).select("fp") if n > shard else table.select("fp").limit(0)
    sample = np.sort(seen.toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    top = VantageTree(sample, max(32, int(shard * len(sample) / max(n, 1))))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy(np.int64).view(np.uint64)
            _, home = (x for x in top.visit(fp, 0))
            q, at = top.visit(fp, radius)
            own = np.zeros(len(fp), np.int64)
            own[top.visit(fp, 0)[0]] = home
            yield pd.DataFrame({"shard": at, "fp": f["fp"].to_numpy()[q], "rep": f["rep"].to_numpy()[q], "home": own[q] == at})

    def link(f: pd.DataFrame) -> pd.DataFrame:
        fp, rep = f["fp"].to_numpy(np.int64).view(np.uint64), f["rep"].to_numpy()
        home = f["home"].to_numpy()
        a = b = rep[:0]
        for q, m in linked_pairs(fp[home], fp, radius):
            a, b = spanning_edges(np.concatenate([a, rep[q]]), np.concatenate([b, rep[home][m]]))
        return pd.DataFrame({"a": a, "b": b})

    kind = table.schema["rep"].dataType.simpleString()
    routed = table.select("fp", "rep").mapInPandas(route, f"shard long, fp long, rep {kind}, home boolean")
    return routed.groupBy("shard").applyInPandas(link, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row; component_id is the smallest id reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Rows with equal fingerprints are
    one node, so copies are never paired. Rows with a null id get a row with their fingerprint's component
    (null if no row of it has an id). Repeated ids give repeated rows. Extra columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash")
    groups = written(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-groups")
    links = connected_components(link_fingerprints(groups.where("rep IS NOT NULL"), radius, shard))
    classes = groups.join(links, groups["rep"] == links["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    out = join_hot(prints, written(classes, "simhash-classes"), "fp", "n")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group of near copies, with all their columns.

    Near copies are texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. That is
    about 10 of 64 bits, give or take 3. The vantage-point trees propose what lies within RADIUS bits, but no
    radius finds the rest and little else, so MinHash bands propose as well; each proposal is measured
    (``near_copies``).

    The kept ids are as many as the documents, so both sides shuffle at every size; the texts once, unsorted.
    Rows with a null id stay; null and empty texts are one group. Of rows with one id in one group one stays
    (of equal shingles that of the smallest text); rows with one id and texts of different groups are told apart
    by their shingles. An empty table stays empty. Extra columns come along.
    """
    rows = written(near_copies.classes(docs, id_col, text_col, link_fingerprints).where("id IS NOT NULL"), "near-rows")
    ids = written(rows.groupBy(F.col("id").alias(id_col)).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("id") == F.col("component")).alias("_first")).where("_first"), "kept")
    out = docs.where(F.col(id_col).isNull()).unionByName(docs.join(ids.where("_n = 1").hint("shuffle_hash"), id_col, "left_semi").select(docs.columns))
    again = ids.where("_n > 1").select(id_col)
    if again.isEmpty():
        return out
    own = rows.where("id = component").groupBy("id", "class").agg(F.min("own").alias("own")).join(again.withColumnRenamed(id_col, "id"), "id", "left_semi")
    several = docs.join(again.hint("shuffle_hash"), id_col, "left_semi")
    whole = F.struct(*docs.columns)
    several = several.groupBy(F.col(id_col).alias("id"), near_copies.digest(F.col(text_col)).alias("own")).agg(F.min_by(whole, F.struct(F.col(text_col), F.to_json(whole))).alias("_row"))
    return out.unionByName(several.join(own.hint("shuffle_hash"), ["id", "own"], "left_semi").select("_row.*"))
