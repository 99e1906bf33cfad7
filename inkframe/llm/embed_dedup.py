"""Near-duplicate embeddings by a forest of random-projection trees with spill."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.graph import connected_components, spanning_edges
from inkframe.llm.store import hashed_sample, join_hot, written
from inkframe.llm.vectors import matrix, rows_of, unit, usable

#: Cosine from which vectors link; trees; vectors a leaf should hold; vectors that one tree is grown from, on the driver or in a task.
COSINE, TREES, LEAF, SAMPLE = 0.95, 4, 512, 16_384
#: Overlap of a split in standard deviations of a linked pair's difference along a random direction.
SPILL = 0.5
#: What a single-precision cosine may be off by at most, and more; it only decides which rows are measured in double.
LOOSE = 1e-3
#: Vectors of a block: a leaf of more is compared in pairs of blocks, each a task's work of its own.
BLOCK = 4096
#: Sampled vectors that a leaf is told from at least, levels of trees at most, vectors that one task routes below the first level, and leaves of more than a block that may be broadcast.
FEWEST, LEVELS, PORTION, LARGE = 16, 6, 32_768, 200_000


class Tree:
    """Random splits at the median of a sample; vectors within ``spill`` of a split go to both sides.

    A split is given up when the overlap leaves a side nearly whole, as in a cloud of copies.
    """

    def __init__(self, sample: np.ndarray, leaf: int, spill: float, seed: int):
        rng = np.random.default_rng(seed)
        self.direction, self.cut, self.low, self.high = [], [], [], []
        self.spill = spill
        todo = [(self._node(), np.arange(len(sample)))]
        while todo:
            k, own = todo.pop()
            if len(own) <= leaf:
                continue
            for _ in range(3):
                d = rng.standard_normal(sample.shape[1])
                d /= np.sqrt(d @ d)
                p = sample[own] @ d
                cut = float(np.median(p))
                low, high = own[p <= cut + spill], own[p > cut - spill]
                if max(len(low), len(high)) < 0.9 * len(own):
                    self.direction[k], self.cut[k] = d, cut
                    self.low[k], self.high[k] = self._node(), self._node()
                    todo += [(self.low[k], low), (self.high[k], high)]
                    break
        width = sample.shape[1]
        self.direction = np.array([np.zeros(width) if d is None else d for d in self.direction], np.float32)
        self.cut, self.low, self.high = np.array(self.cut), np.array(self.low), np.array(self.high)

    def _node(self) -> int:
        for column, x in ((self.direction, None), (self.cut, 0.0), (self.low, -1), (self.high, -1)):
            column.append(x)
        return len(self.cut) - 1

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row of ``x`` falls into."""
        row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        out_row, out_at = [row[:0]], [at[:0]]
        while len(row):
            leaf = self.low[at] < 0
            out_row.append(row[leaf])
            out_at.append(at[leaf])
            row, at = row[~leaf], at[~leaf]
            if not len(row):
                break
            p = np.concatenate([np.einsum("ij,ij->i", x[row[i : i + 65536]], self.direction[at[i : i + 65536]]) for i in range(0, len(row), 65536)])
            low, high = p <= self.cut[at] + self.spill, p > self.cut[at] - self.spill
            row, at = np.concatenate([row[low], row[high]]), np.concatenate([self.low[at[low]], self.high[at[high]]])
        return np.concatenate(out_row), np.concatenate(out_at)


def _compare(a: pd.DataFrame, b: pd.DataFrame | None, leaf: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links within ``a``, or between ``a`` and ``b``: ids, links owned by this leaf, stars (node, root).

    A pair that shares several leaves is counted in the smallest of them only. Whether that is this leaf
    depends on the two lists of leaves alone, so rows with equal lists are decided together.
    """
    same = b is None
    b = a if same else b
    x, y = (unit(matrix([np.frombuffer(v, np.float64) for v in f["v"]])) for f in (a, b))
    ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
    wa, wb = a["n"].to_numpy(), b["n"].to_numpy()
    hit_a, hit_b = np.zeros(len(x), bool), np.zeros(len(y), bool)
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    for i in range(0, len(x), 512):
        hit = x32[i : i + 512] @ y32.T >= np.float32(cosine - LOOSE)
        if same:
            hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
        hit_a[i : i + 512] = hit.any(axis=1)
        hit_b |= hit.any(axis=0)
    ra, rb = np.flatnonzero(hit_a), np.flatnonzero(hit_b)
    if not len(ra):
        return ia[:0], wa[:0], ia[:0], ia[:0]
    hit = x[ra] @ y[rb].T >= cosine
    if same:
        np.fill_diagonal(hit, False)
    lists = [{s: k for k, s in enumerate(dict.fromkeys(f["leaves"].to_numpy()[r]))} for f, r in ((a, ra), (b, rb))]
    lower = [[[k for k in np.frombuffer(s, np.int64).tolist() if k < leaf] for s in d] for d in lists]
    column = {k: c for c, k in enumerate(sorted({k for side in lower for own in side for k in own}))}
    member = [np.zeros((len(side), max(1, len(column))), np.float32) for side in lower]
    for m, side in zip(member, lower):
        for r, own in enumerate(side):
            m[r, [column[k] for k in own]] = 1
    owned = member[0] @ member[1].T == 0  # no smaller leaf in common
    ka = np.array([lists[0][s] for s in a["leaves"].to_numpy()[ra]])
    kb = np.array([lists[1][s] for s in b["leaves"].to_numpy()[rb]])
    links_a, links_b = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
    nodes = np.concatenate([ia[ra], ib[rb]])
    label = nodes.copy()
    for i in range(0, len(ra), 512):
        part = hit[i : i + 512]
        own = part & owned[ka[i : i + 512]][:, kb]
        links_a[i : i + 512] = own @ wb[rb]
        links_b += wa[ra[i : i + 512]] @ own
    while True:  # smallest id of each local component
        before = label.copy()
        high = np.iinfo(np.int64).max
        for i in range(0, len(ra), 512):
            part = hit[i : i + 512]
            left = np.minimum(label[i : i + 512][: len(part)], label[: len(ra)][i : i + 512])
            label[i : i + len(part)] = np.minimum(left, np.where(part, label[len(ra) :][None, :], high).min(axis=1))
            label[len(ra) :] = np.minimum(label[len(ra) :], np.where(part, label[i : i + len(part)][:, None], high).min(axis=0))
        if np.array_equal(label, before):
            break
    ids, links = (ia[ra], links_a) if same else (nodes, np.concatenate([links_a, links_b]))
    off = nodes != label
    return ids, links, nodes[off], label[off]


def _route(trees: list[Tree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf of every tree that each row of ``x`` falls into, by row and leaf; tree t's leaves start at t * 2^32."""
    pairs = [tree.leaves(x) for tree in trees]
    row = np.concatenate([r for r, _ in pairs])
    at = np.concatenate([a + (t << 32) for t, (_, a) in enumerate(pairs)])
    by = np.lexsort((at, row))
    return row[by], at[by]


def _lists(row: np.ndarray, at: np.ndarray, n: int) -> list[bytes]:
    starts = np.searchsorted(row, np.arange(n + 1))
    return [at[s:e].tobytes() for s, e in zip(starts, starts[1:])]


def leaves(nodes: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(leaf, node, n, v binary, leaves binary) of each row of ``nodes`` (node, n, v array<double>; a written table) for each leaf it falls into.

    The driver grows the first level for each width from about ``sample`` rows. Of so many rows that a leaf
    couldn't be told from FEWEST of these, leaves come out too large; each is then split again by a tree
    from its own sample, grown and followed in tasks, and so on. So leaves hold about ``leaf`` rows at any
    size, but for clouds that no split takes apart. A width that the sample doesn't hold is a leaf to begin with.
    """
    total = nodes.count()
    seen = hashed_sample(nodes, "node", total, sample).select("node", "v").toPandas().sort_values("node")
    rate = len(seen) / max(total, 1)
    forest: dict[int, tuple[int, list[Tree]]] = {}

    def spill(width: int) -> float:
        return SPILL * np.sqrt(max(0.0, 2 - 2 * cosine) / width)

    for k, (width, own) in enumerate(seen.groupby(seen["v"].map(len))["v"]):
        x = unit(matrix(own.to_list()))
        forest[int(width)] = k, [Tree(x, max(FEWEST, int(leaf * rate)), spill(int(width)), seed * 1000 + t) for t in range(trees)]
    shared = nodes.sparkSession.sparkContext.broadcast(forest)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for width, own in f.groupby(f["v"].map(len)):
                raw = matrix(own["v"].to_list())
                if width in shared.value:
                    k, grown = shared.value[width]
                    row, at = _route(grown, unit(raw))
                    at = at + (k << 40)
                else:
                    row, at = np.arange(len(raw)), np.full(len(raw), -1 - width)
                lists, bodies = _lists(row, at, len(raw)), [v.tobytes() for v in raw]
                for i in range(0, len(row), 20_000):
                    r = row[i : i + 20_000]
                    yield pd.DataFrame({"leaf": at[i : i + 20_000], "node": own["node"].to_numpy()[r], "n": own["n"].to_numpy()[r], "v": [bodies[k] for k in r], "leaves": [lists[k] for k in r]})

    kind = "leaf long, node long, n long, v binary, leaves binary"
    placed = written(nodes.select("node", "n", "v").mapInPandas(route, kind), "leaves")
    if total * FEWEST <= sample * leaf:
        return placed
    for level in range(1, LEVELS):
        sizes = written(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 2 * leaf), "leaf-sizes")
        if sizes.isEmpty():
            break
        share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("m")) * (1 << 30)
        inner = join_hot(placed.select("leaf", "node", "v"), sizes, "leaf", "m").where(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) < share)

        def grow(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("node")
            x = unit(matrix([np.frombuffer(v, np.float64) for v in f["v"]]))
            tree = Tree(x, max(FEWEST, int(leaf * len(x) / f["m"].iloc[0])), spill(x.shape[1]), seed * 1000 + level * 100 + int(key[0]) % 97)
            return pd.DataFrame({"leaf": [key[0]], "m": [f["m"].iloc[0]], "tree": [pickle.dumps(tree)]})

        grown = written(inner.groupBy("leaf").applyInPandas(grow, "leaf long, m long, tree binary"), "trees")
        portions = F.ceil(F.col("m") / PORTION).cast("int")
        large = join_hot(placed, grown.select("leaf", "m"), "leaf", "m").withColumn("portion", F.pmod(F.xxhash64("node"), portions).cast("int"))
        ways = grown.select("leaf", "tree", F.explode(F.sequence(F.lit(0), portions - 1)).alias("portion"))

        def follow(key: tuple, f: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
            if not len(f):
                return pd.DataFrame({c.split()[0]: [] for c in kind.split(", ")}).astype({"leaf": "int64", "node": "int64", "n": "int64"})
            row, at = pickle.loads(way["tree"].iloc[0]).leaves(unit(matrix([np.frombuffer(v, np.float64) for v in f["v"]])))
            out = f[["leaf", "node", "n", "v", "leaves"]].iloc[row]
            return out.assign(leaf=((out["leaf"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))

        deeper = large.groupBy("leaf", "portion").cogroup(ways.groupBy("leaf", "portion")).applyInPandas(follow, kind)
        rest = placed.join(grown.select("leaf").hint("shuffle_merge"), "leaf", "left_anti")
        most = sizes.agg(F.max("m")).first()[0]
        placed = written(rest.unionByName(deeper), "leaves")
        if most * FEWEST <= sample * leaf:
            break

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"node": f["node"], "leaves": [np.sort(np.asarray(x, np.int64)).tobytes() for x in f["leaves"]]})

    lists = placed.groupBy("node").agg(F.collect_set("leaf").alias("leaves")).mapInPandas(pack, "node long, leaves binary")
    return written(placed.drop("leaves").join(lists.hint("shuffle_merge"), "node").select("leaf", "node", "n", "v", "leaves"), "leaves")


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, seed: int = 11, sample: int = SAMPLE
) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row of ``df``.

    Links are pairs of cosine >= ``cosine`` in double precision that share a leaf of some tree; vectors of
    different widths never link. Equal vectors are one node, named by 64 bits of a hash, with a count, so copies
    are never paired with one another. Unusable vectors (null, zero, null or non-finite components) and rows
    with a null id link with nothing. A repeated id is a row each, with the links of its own vector. Extra
    columns are not read. An empty table gives an empty result.

    Each vector goes to its ``leaves`` with the list of all of them; a task compares one leaf, or one pair of
    blocks of a large leaf, and returns counts and a star for each component it found, never the pairs.
    """
    rows = rows_of(df, id_col, vector_col).where("id IS NOT NULL")
    groups = rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = written(groups.withColumn("node", F.xxhash64("v")), "vectors")
    routed = leaves(nodes, cosine, trees, leaf, sample, seed)
    sizes = written(routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).where(f"m > {block}"), "leaf-sizes")
    big = routed.join(F.broadcast(sizes) if sizes.count() <= LARGE else sizes, "leaf", "left")
    parts = F.coalesce(F.ceil(F.col("m") / block), F.lit(1)).cast("int")
    big = big.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # The block meets itself and every other block of its leaf: tasks (low, high) with low <= high.
    meets = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = big.select("leaf", "node", "n", "v", "leaves", "own", F.explode(meets).alias("other"))
    dealt = dealt.select("leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", F.col("node").alias("id"), "n", "v", "leaves")

    def compare(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        at, a, b = key
        ids, links, node, root = _compare(f, None, at, cosine) if a == b else _compare(f[f["own"] == a], f[f["own"] == b], at, cosine)
        return pd.DataFrame({"node": np.concatenate([ids, node]), "links": np.concatenate([links, np.zeros(len(node), np.int64)]), "root": np.concatenate([ids, root])})

    found = written(dealt.groupBy("leaf", "a", "b").applyInPandas(compare, "node long, links long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("node <> root"), "node", "root")
    known = nodes.join(counts, "node", "left").join(classes, "node", "left")
    known = written(known.select("v", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("class"), "n"), "classes")
    smallest = written(known.groupBy("class").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("m")), "smallest")
    known = join_hot(known, smallest, "class", "m").select("v", "n_links", "component_id", "n")
    return _members(df, rows, known, id_col, vector_col)


def _members(df: DataFrame, rows: DataFrame, known: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Each row of ``df`` with its vector's numbers; vectors that many rows share are joined by broadcast of their hash."""
    key = F.xxhash64("v")
    narrow = written(rows.select("id", key.alias("h"), "v"), "members")
    known = written(known.withColumn("h", key), "classes")
    out = join_hot(narrow.withColumn("k", F.struct("h", "v")).drop("h", "v"), known.withColumn("k", F.struct("h", "v")).drop("h", "v"), "k", "n")
    out = out.select(F.col("id").alias(id_col), "n_links", "component_id")
    rest = df.where(~usable(F.col(vector_col)) | F.col(id_col).isNull())
    out = out.unionByName(rest.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id")))
    return out.select(id_col, F.col("n_links").cast("long"), "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)).alias("kept"))
