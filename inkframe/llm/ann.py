"""Nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm.store import hashed_sample, written
from inkframe.llm.vectors import matrix, rows_of

#: Neighbours asked for; vectors that the driver sees to place the cells; width of the error bound in its own unit.
TOP, SAMPLE, EPSILON = 10, 8_192, 3.0
#: Cells that vectors are divided into, at most, and rounds that place them; bytes of vectors that a block of a cell
#: holds, and vectors a block from which there are more blocks than cores; queries estimated at a time, and codes.
CELLS, ROUNDS, BLOCK_BYTES, BLOCK_FEW, CHUNK, CODES = 256, 5, 16 << 20, 2_048, 64, 8_192
#: The signs that each byte stands for, first bit first.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


@cache
def rotation(width: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray, centre: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs of the rotated residuals, length of the residual, its cosine with its own code) of each row.

    The last is the correction scalar: an estimate of <o, q> is <code, q> divided by it (Gao and Long, 2024).
    """
    r = x - centre
    length = np.sqrt((r * r).sum(axis=1))
    o = (r / np.where(length > 0, length, 1)[:, None]) @ rotation(x.shape[1], seed)
    return np.packbits(o > 0, axis=1), length, np.where(length > 0, np.abs(o).sum(axis=1) / np.sqrt(x.shape[1]), 1.0)


def inner_products(bits: np.ndarray, q: np.ndarray) -> np.ndarray:
    """<signs, q> of each row of ``q`` with each packed code: a table of 256 sums a byte, looked up by the code's bytes."""
    padded = np.zeros((len(q), 8 * bits.shape[1]), np.float32)
    padded[:, : q.shape[1]] = q
    out = np.zeros((len(q), len(bits)), np.float32)
    for b in range(bits.shape[1]):
        out += np.take(padded[:, 8 * b : 8 * b + 8] @ SIGNS.T, bits[:, b], axis=1)
    return out


def bounds(bits: np.ndarray, length: np.ndarray, own: np.ndarray, q: np.ndarray, centre: np.ndarray, seed: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, error) of the squared distance of each query (row) and code (column), from packed codes and scalars alone."""
    width = q.shape[1]
    r = q - centre
    far = np.sqrt((r * r).sum(axis=1))
    turned = ((r / np.where(far > 0, far, 1)[:, None]) @ rotation(width, seed)).astype(np.float32)
    inner = inner_products(bits, turned) / np.float32(np.sqrt(width)) / own.astype(np.float32)
    wide = epsilon * np.sqrt(np.maximum(0.0, 1 - own * own)) / own / np.sqrt(max(1, width - 1))
    scale = 2 * far[:, None] * length[None, :]
    return length[None, :] ** 2 + far[:, None] ** 2 - scale * inner, scale * (wide[None, :] + 1e-5)


def distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components summed in their order."""
    d = x - q
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


def apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all rows and centres, exact enough to be told from others by a margin of a millionth of their size."""
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def cells(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """At most ``n`` centres of ``x``, by a few rounds of k-means from rows chosen at random."""
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False))]
    for _ in range(ROUNDS):
        own = apart(x, centres).argmin(axis=1)
        centres = np.stack([x[own == k].mean(axis=0) for k in np.unique(own)])
    return centres


class Block:
    """The vectors of one block with their codes, packed."""

    def __init__(self, rows: pd.DataFrame, centre: np.ndarray):
        self.x = matrix([np.frombuffer(v, np.float64) for v in rows["v"]])
        self.bits = np.stack([np.frombuffer(b, np.uint8) for b in rows["bits"]])
        self.length, self.own = rows["length"].to_numpy(), rows["own"].to_numpy()
        self.ids, self.centre = rows["ids"].to_list(), centre

    def nearest(self, names: np.ndarray, q: np.ndarray, limits: np.ndarray, k: int, seed: int, epsilon: float) -> Iterator[tuple[int, int, float]]:
        """(query, id, distance) of each query's k nearest here, but for what lies beyond its limit."""
        for i in range(0, len(q), CHUNK):
            part = q[i : i + CHUNK]
            both = [bounds(self.bits[c : c + CODES], self.length[c : c + CODES], self.own[c : c + CODES], part, self.centre, seed, epsilon) for c in range(0, len(self.x), CODES)]
            guess, error = (np.concatenate([b[j] for b in both], axis=1) for j in (0, 1))
            low = guess - error
            near = min(k + 1, len(self.x))  # one more: the query's own vector may be among them
            first = np.argpartition(guess, near - 1, axis=1)[:, :near]
            for j, (name, point) in enumerate(zip(names[i : i + CHUNK], part)):
                # Exact distances of the best guesses bound the k-th; only codes that may lie below it are measured.
                limit = min(distance(self.x[first[j]], point).max() if near == k + 1 else np.inf, limits[i + j])
                may = np.flatnonzero(low[j] <= limit * limit * (1 + 1e-6))
                if not len(may):
                    continue
                d = distance(self.x[may], point)
                cut = min(np.partition(d, near - 1)[near - 1] if len(d) >= near else np.inf, limit * (1 + 1e-12))
                rows = sorted((float(s), int(v)) for b, s in zip(may[d <= cut], d[d <= cut]) for v in self.ids[b] if v != name)
                yield from ((int(name), v, s) for s, v in rows[:k])


ROW = "block string, cell int, what int, id long, ids array<long>, v binary, bits binary, length double, own double, most double"
FOUND = "query_id long, vec_id long, score double"


def _searched(index: DataFrame, visits: DataFrame, centres: dict[int, np.ndarray], k: int, seed: int, epsilon: float) -> DataFrame:
    """FOUND of each block of ``index`` for each row of ``visits`` (block, id, v, most) there.

    A block's vectors come before its visitors in one sorted stream, so each vector moves once however many
    queries there are; a task holds one block and one batch of queries.
    """
    names = [c.split()[0] for c in ROW.split(", ")]
    left = index.select("block", "cell", F.lit(0).alias("what"), F.lit(None).cast("long").alias("id"), "ids", "v", "bits", "length", "own", F.lit(None).cast("double").alias("most"))
    right = visits.select("block", F.lit(0).alias("cell"), F.lit(1).alias("what"), "id", F.lit(None).cast("array<long>").alias("ids"), "v", *(F.lit(None).cast(t).alias(c) for c, t in (("bits", "binary"), ("length", "double"), ("own", "double"))), "most")
    stream = left.unionByName(right).select(names).repartition("block").sortWithinPartitions("block", "what")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, block = None, [], None
        for f in frames:
            for name, part in f.groupby("block", sort=False):
                if name != at:
                    at, held, block = name, [], None
                rows, asked = part[part["what"] == 0], part[part["what"] == 1]
                if len(rows):
                    held.append(rows)
                if not len(asked) or not held:
                    continue
                if block is None:
                    whole = pd.concat(held)
                    width = len(whole["v"].iloc[0]) // 8
                    block = Block(whole, centres[width][int(whole["cell"].iloc[0])] if width in centres else np.zeros(width))
                q = matrix([np.frombuffer(v, np.float64) for v in asked["v"]])
                out = list(block.nearest(asked["id"].to_numpy().astype(np.int64), q, asked["most"].to_numpy(), k, seed, epsilon))
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return stream.mapInPandas(run, FOUND)


def first_block(i: int, blocks: int) -> int:
    """Which of a cell's blocks a query searches first: by a hash of its id, as ids may all be multiples of one number."""
    return (int(i) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) * blocks >> 64


def nearest(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, seed: int = 5, epsilon: float = EPSILON, block_bytes: int = BLOCK_BYTES, few: int = BLOCK_FEW, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows of each row for which ``is_query`` holds.

    Nearness is Euclidean distance in double precision, ties to the smaller id, rows of a query's own id left
    out. Only vectors of one width compare. Rows with an unusable vector (null, zero, null or non-finite
    components) or a null id take no part; fewer candidates than ``k`` give fewer rows, an empty table none. A
    repeated query id asks with its smallest vector; as a candidate each of its rows counts, equal ones once.
    Extra columns are not read.

    Every distinct vector is coded; of the rows that share one, the k + 1 smallest ids are kept, which is
    all that any answer can name. The driver places up to CELLS centres by a sample of about ``sample`` vectors; a
    cell is dealt to blocks by hash. Each query first searches one block of its nearest cell. That bounds its
    k-th distance, and by the triangle inequality rules out cells whose farthest vector is still too far; it
    then visits the blocks of all others. In a block the codes' bounds choose what is measured exactly.
    """
    spark = df.sparkSession
    rows = rows_of(df, id_col, vector_col).where("id IS NOT NULL")
    some = rows.select("id", "v").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rn") <= k + 1)
    nodes = written(some.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v")), "distinct")
    total = nodes.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    seen = hashed_sample(nodes, "h", total, sample).select("h", "v").toPandas().sort_values("h")
    centres: dict[int, np.ndarray] = {}
    for width, own in seen.groupby(seen["v"].map(len))["v"]:
        x = matrix(own.to_list())
        blocks = total * len(x) / len(seen) / max(1, min(block_bytes // (8 * int(width)), few))
        centres[int(width)] = cells(x, max(1, min(CELLS, len(x) // 16, int(blocks))), seed)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for width, own in f.groupby(f["v"].map(len)):
                x = matrix(own["v"].to_list())
                places = centres.get(width, np.zeros((1, width)))
                far = apart(x, places)
                cell = far.argmin(axis=1)
                bits, length, scalar = codes(x, places[cell], seed)
                yield pd.DataFrame({"width": width, "cell": cell.astype(np.int32), "ids": own["ids"], "h": own["h"], "v": [v.tobytes() for v in x], "bits": [b.tobytes() for b in bits], "length": length, "own": scalar})

    coded = written(nodes.mapInPandas(encode, "width int, cell int, ids array<long>, h long, v binary, bits binary, length double, own double"), "codes")
    known = coded.where(F.col("width").isin(list(centres))).groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("r")).collect()  # at most CELLS rows a sampled width
    size = {(c.width, c.cell): (-(-c.n // max(1, min(block_bytes // (8 * c.width), max(few, total // 64)))), c.r) for c in known}
    spread = spark.createDataFrame([(w, c, b) for (w, c), (b, _) in size.items()], "width int, cell int, blocks int")
    name = F.concat_ws(".", "width", "cell", F.pmod("h", F.coalesce("blocks", F.lit(1))).cast("string"))
    index = coded.join(F.broadcast(spread), ["width", "cell"], "left").withColumn("block", name)

    def home(width: int, cell: int, i: int) -> str:
        return f"{width}.{cell}.{first_block(i, size.get((width, cell), (1, 0))[0])}"

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for width, own in f.groupby(f["v"].map(len)):
                x = matrix(own["v"].to_list())
                cell = apart(x, centres.get(width, np.zeros((1, width)))).argmin(axis=1)
                yield pd.DataFrame({"block": [home(width, c, i) for c, i in zip(cell, own["id"])], "id": own["id"], "v": [v.tobytes() for v in x], "most": np.inf})

    asked = rows_of(df.where(is_query), id_col, vector_col).where("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked.mapInPandas(start, "block string, id long, v binary, most double"), "queries")
    first = written(_searched(index, asked, centres, k, seed, epsilon), "found")
    limits = first.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("c"), F.max("score").alias("s")).select("id", F.when(F.col("c") >= k, F.col("s")).alias("limit"))

    def go_on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for at, i, v, limit in zip(f["block"], f["id"], f["v"], f["limit"]):
                width = len(v) // 8
                limit = np.inf if limit is None or np.isnan(limit) else limit
                if width not in centres:
                    continue
                far = apart(np.frombuffer(v, np.float64)[None], centres[width])[0]
                for cell, d in enumerate(far):
                    blocks, r = size.get((width, cell), (0, 0.0))
                    if (d - r) - 1e-6 * (d + r) <= limit:
                        out += [(b, i, v, limit) for j in range(blocks) if (b := f"{width}.{cell}.{j}") != at]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["block", "id", "v", "most"])
                    out = []
            yield pd.DataFrame(out, columns=["block", "id", "v", "most"])

    more = asked.drop("most").join(limits, "id", "left").select("block", "id", "v", "limit").mapInPandas(go_on, "block string, id long, v binary, most double")
    found = first.unionByName(_searched(index, more, centres, k, seed, epsilon))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
