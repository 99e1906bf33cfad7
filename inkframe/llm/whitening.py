"""Whitening of embeddings: exact covariance by products of digit slices, then eigenvectors of any accuracy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm.store import written

#: Bits of a digit, and vectors that are multiplied at a time: a sum of CHUNK products of two digits is below
#: 2^53, so float64 holds it exactly in any order of addition.
BITS, CHUNK = 20, 1 << 12
#: Units an entry is counted in, and components that are returned.
UNITS, COMPONENTS = 256, 4
#: Partial sums of tasks that meet before the last merge.
SPREAD = 256


def scaled(vector: Column, units: int = UNITS) -> Column:
    """The entries as longs: the floor of ``units`` times the entry as double; beyond the range of long, its ends."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * units).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and all its entries are finite numbers; zeros count."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & finite, F.lit(False))


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in column])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as int64 where nothing can leave its range, else as Python integers."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if x.size else 0
    if most < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def slices(y: np.ndarray) -> list[np.ndarray]:
    """Digits of BITS bits, lowest first, as float64: ``y`` is the sum of slice k times 2^(BITS * k); the last has the sign."""
    out, half = [], 1 << (BITS - 1)
    while True:
        if not y.size or max(abs(int(y.min())), abs(int(y.max()))) < half:
            return [*out, y.astype(np.float64)]
        low = ((y + half) & ((1 << BITS) - 1)) - half  # from -half to half - 1
        out.append(low.astype(np.float64))
        y = (y - low) >> BITS


def gram(y: np.ndarray) -> np.ndarray:
    """The exact matrix of products of the columns of integers, as Python integers: float64 products of slices, put together."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for lo in range(0, len(y), CHUNK):
        parts = slices(y[lo : lo + CHUNK])
        for a, x in enumerate(parts):
            for b in range(a + 1):
                g = (x.T @ parts[b]).astype(np.int64).astype(object)
                total = total + ((g if a == b else g + g.T) << (BITS * (a + b)))
    return total


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums entry by entry of arrays of decimal strings: first of some tasks' each, then of those, so no group holds all."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = [0] * len(f["v"].iloc[0])
        for v in f["v"]:
            total = [a + int(b) for a, b in zip(total, v)]
        return pd.DataFrame({**{k: [f[k].iloc[0]] for k in keys}, "n": [int(f["n"].sum())], "v": [[str(a) for a in total]]})

    kinds = ", ".join(f"{k} int" for k in keys)
    some = rows.groupBy(*keys, "part").applyInPandas(add, f"{kinds}, n long, v array<string>")
    return some.groupBy(*keys).applyInPandas(add, f"{kinds}, n long, v array<string>")


@dataclass(frozen=True)
class Whitening:
    """What the fit list of one width says: n, sums, unit eigenvectors (rows) by falling eigenvalue, and what they explain."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float


def _round(x: np.ndarray, bits: int) -> np.ndarray:
    return (x + (1 << (bits - 1))) >> bits


def _floats(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Integers as float64 times 2^shift, the largest about 1."""
    shift = max((abs(int(v)).bit_length() for v in x.flat), default=0)
    return np.array([math.ldexp(float(int(v) >> max(0, shift - 64)), max(0, shift - 64) - shift) for v in x.flat]).reshape(x.shape), shift


def eigen(m: np.ndarray, count: int) -> tuple[list[np.ndarray], list[int], int]:
    """Leading unit eigenvectors and eigenvalues of a positive semidefinite matrix of Python integers.

    Both are integers times 2^-bits. The start is numpy's; each vector is then mended by the float64 solution of what its
    exact residual leaves, until that is nothing to ``bits`` bits, and taken out of the matrix. So small eigenvalues beside huge ones
    are as good as the first. ``bits`` is such that what an integer matrix of lower rank leaves can be told from an eigenvalue.
    """
    width = len(m)
    trace = sum(int(m[k, k]) for k in range(width))
    bits = (COMPONENTS + 1) * max(1, trace.bit_length()) + 4 * width.bit_length() + 64
    a = m << bits
    vectors, values = [], []
    for _ in range(min(count, width)):
        f, shift = _floats(a)
        w, u = np.linalg.eigh((f + f.T) / 2)
        v = np.array([int(x) for x in (u[:, -1] * 2.0**53)], dtype=object) << (bits - 53)
        value = 0
        for _ in range(40):
            v = (v << bits) // math.isqrt(int((v * v).sum()))
            image = _round(a.dot(v), bits)
            value = int(_round(np.array([(image * v).sum()], dtype=object), bits)[0])
            left = image - _round(v * value, bits)
            size = max(abs(int(x)) for x in left)
            if size <= width << 8:
                break
            r, rs = _floats(left)
            at = math.ldexp(float(value >> max(0, shift - 64)), max(0, shift - 64) - shift)
            gap = at - w
            part = u.T @ r
            part[np.abs(gap) < 1e-9 * max(at, 1e-300)] = 0
            gap[np.abs(gap) < 1e-9 * max(at, 1e-300)] = 1
            d = u @ (part / gap)
            # the correction in units of 2^(rs - shift), as an integer with ``bits`` bits behind the point
            by = rs - shift + bits - 60
            step = np.array([int(x) for x in d * 2.0**60], dtype=object)
            v = v + (step << by if by >= 0 else step >> -by)
        if value <= (trace << bits) >> (COMPONENTS * trace.bit_length() + 4 * width.bit_length()):
            value = 0  # the rank is lower: an eigenvalue of this rank can't be so small
        vectors.append(v)
        values.append(value)
        a = a - _round(np.multiply.outer(v, v) * value, 2 * bits)
    return vectors, values, bits


def solve(n: int, sums: list[int], m: np.ndarray, count: int = COMPONENTS) -> Whitening:
    """The whitening from the exact matrix of products of n * x - sums, which is n^3 times the covariance."""
    vectors, values, bits = eigen(m, count)
    trace = sum(int(m[k, k]) for k in range(len(m)))
    rows, deviations, explained = [], [], []
    for v, e in zip(vectors, values):
        x = np.array([float(int(c) / (1 << bits)) if abs(int(c)).bit_length() < 1000 else float(c) for c in v])
        x = x / math.sqrt((x * x).sum()) * (1 if x[np.abs(x).argmax()] > 0 else -1)
        rows.append(x)
        # sqrt(e) n, as projections are of n * x - sums: e is value / (2^bits n^3)
        deviations.append(math.sqrt(math.ldexp(float(e >> max(0, e.bit_length() - 64)), max(0, e.bit_length() - 64) - bits) / n))
        explained.append((e << 64) // (trace << bits) / 2.0**64 if trace and (e << 64) >= trace << bits else (e / (trace << bits) if trace else 0.0))
    found = [k for k, e in enumerate(values) if e]
    error = 0.0
    for i in found:
        for j in found:
            # of the vectors as returned, in exact arithmetic
            p, q = (np.array([int(c * 2.0**60) for c in rows[k]], dtype=object) for k in (i, j))
            got = int(p.dot(m.dot(q)))
            c = got / (math.isqrt(values[i] * values[j]) << 120 >> bits) if values[i] * values[j] else 0.0
            error = max(error, abs(c - (i == j)))
    return Whitening(n, sums, np.array(rows), np.array(deviations), np.array(explained), error)


def fit(vectors: DataFrame) -> dict[int, Whitening]:
    """The whitening of each width from ``vectors`` (x array<long>), each distinct vector counted once.

    Tasks add up the entries of their distinct vectors, and in a second pass the products of n * x - sums; what they return is a
    matrix row each, merged in two rounds. Only sums (a row a width and dimension) reach the driver, which holds one matrix of
    the vectors' width at a time: a width of 1,024 is 1,000,000 integers.
    """
    distinct = written(vectors.select("x").distinct(), "distinct-vectors")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for f in frames:
            sizes = f["x"].map(len)
            for width, part in f.groupby(sizes):
                x = matrix(part["x"])
                # halves of 32 bits add up without overflow
                s = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                n, t = total.get(width, (0, 0))
                total[width] = n + len(x), t + s
        yield from (pd.DataFrame({"width": [w], "n": [n], "v": [[str(a) for a in s]]}) for w, (n, s) in total.items())

    part = (F.spark_partition_id() % SPREAD).alias("part")
    got = _merged(distinct.mapInPandas(sums, "width int, n long, v array<string>").select("*", part), ["width"]).collect()
    known = {r["width"]: (r["n"], [int(a) for a in r["v"]]) for r in got}

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for f in frames:
            sizes = f["x"].map(len)
            for width, part in f.groupby(sizes):
                total[width] = total.get(width, 0) + gram(centred(matrix(part["x"]), *known[width]))
        for width, g in total.items():
            yield pd.DataFrame({"width": width, "i": np.arange(width), "n": 1, "v": [[str(a) for a in row] for row in g]})

    rows = written(_merged(distinct.mapInPandas(products, "width int, i int, n long, v array<string>").select("*", part), ["width", "i"]), "products")
    out = {}
    for width, (n, s) in known.items():
        m = np.zeros((width, width), dtype=object)
        for r in rows.where(F.col("width") == width).collect():
            m[r["i"]] = [int(a) for a in r["v"]]
        out[width] = solve(n, s, m)
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error, deviation_exact), up to COMPONENTS rows a vector.

    Vectors that are null, empty or hold null or non-finite entries have no row; those of different widths are fitted apart, each with its
    own n. The fit list is the distinct vectors, so copies change nothing; every row, copies included, is returned, null ids too. A
    component without variance (eigenvalue zero, as of a single vector) has whitened null and explained 0, and identity_error
    leaves it out. ``deviation`` is null where it is beyond a long; ``deviation_exact`` has its digits at any size. An empty table gives no rows;
    extra columns aren't read. No vector is shuffled but for the distinct list, so copies of one vector are no hot key.
    """
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), scaled(F.col(vector_col)).alias("x"))
    known = fit(rows)
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits = shared.value
        for f in frames:
            sizes = f["x"].map(len)
            for width, part in f.groupby(sizes):
                w = fits[width]
                y = centred(matrix(part["x"]), w.n, w.sums)
                small = y.dtype != object and len(w.sums) * max(abs(int(y.min())), abs(int(y.max()))) ** 2 < 1 << 63
                deviation = (y * y).sum(axis=1) if small else (y.astype(object) ** 2).sum(axis=1)
                shown = y.astype(np.float64)
                digits, count = [str(int(d)) for d in deviation], len(w.explained)
                for k in range(count):
                    z = shown @ w.vectors[k] / w.deviations[k] if w.deviations[k] else np.full(len(shown), np.nan)
                    yield pd.DataFrame({"id": part["id"], "component": k + 1, "n": w.n, "deviation": digits, "whitened": z, "explained": w.explained[k], "identity_error": w.identity_error})

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(run, f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    value = F.when(F.isnan("whitened"), None).otherwise(F.col("whitened")).alias("whitened")
    exact = F.col("deviation")
    return out.select(F.col("id").alias(id_col), "component", "n", exact.try_cast("long").alias("deviation"), value, "explained", "identity_error", exact.alias("deviation_exact"))
