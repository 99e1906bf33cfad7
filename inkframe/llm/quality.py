"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.store import hashed_sample, written

#: Buckets of hashed n-grams (0 is the bias), and the labelled rows that training reads (twice as many at most).
BUCKETS, SAMPLE = 1 << 18, 8_000
#: The learner's rates, penalties and passes; what a feature's share of a text is multiplied by.
ALPHA, BETA, L1, L2, PASSES, SCALE = 1.0, 1.0, 0.01, 0.01, 3, 8.0
#: What a word counts as, alone and as a pair, whichever word it is, if it repeats the one before it or its
#: pair repeats the one two or three words before (words with signs are two or three): texts that stammer
#: share no words, and a good word said over and over is no good sign.
REPEAT = np.uint64(0x5BD1E9)
#: Words remembered with their hashes, and words of a text handled at a time.
REMEMBERED, CHUNK = 300_000, 1 << 20

TOKENS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _hashes.get(word)
    if h is None:
        if len(_hashes) >= REMEMBERED:
            _hashes.clear()
        h = _hashes[word] = zlib.crc32((word if not word.isdigit() else "0").encode("utf-8", "surrogatepass"))
    return h


def _buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of a text's words and word pairs, repeats included, some at a time."""
    words = TOKENS.findall(text)
    last = None
    for i in range(0, len(words), CHUNK):
        part = words[i : i + CHUNK]
        try:
            h = [_hashes[w] for w in part]
        except KeyError:
            h = [_hash(w) for w in part]
        one = np.array(h, np.uint64)
        whole = one if last is None else np.concatenate([last, one])
        two = (whole[:-1] * np.uint64(0x9E3779B97F4A7C15) + whole[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        again = whole[:-1] == whole[1:]
        for lag in (2, 3):
            again[lag:] |= two[lag:] == two[:-lag]
        two[again] = REPEAT
        last = one[-1:]
        single = one * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        single[len(one) - len(again) :][again] = REPEAT
        yield single % np.uint64(BUCKETS - 1) + np.uint64(1)
        yield two % np.uint64(BUCKETS - 1) + np.uint64(1)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values: SCALE times the share of the text's n-grams, and 1 for the bias."""
    found = [x for x in _buckets(text)]
    k, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
    return np.concatenate([[0], k.astype(np.int64)]), np.concatenate([[1.0], SCALE * n / max(1, n.sum())])


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """The weights after PASSES over ``rows`` (buckets, values, label), in their order (McMahan et al., 2013)."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(PASSES):
        for k, x, y in rows:
            w = weights(z[k], n[k])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA * w
            n[k] += g * g
    return weights(z, n).astype(np.float32)


def score(text: str, w: np.ndarray) -> float:
    total, n = 0.0, 0
    for k in _buckets(text):
        total, n = total + float(w[k].sum(dtype=np.float64)), n + len(k)
    return 1 / (1 + np.exp(-np.clip(w[0] + SCALE * total / max(1, n), -35, 35)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from about ``sample`` labelled rows, chosen by the hash of their id.

    One task learns, as the updates follow one another. Its input is at most twice ``sample`` rows of features, each
    of at most BUCKETS numbers however long the text, which other tasks have counted. Null labels and ids
    teach nothing, null texts are empty; each label of an id teaches once, and of several texts of one id the one
    of smallest CRC-32 is its text. Without labelled rows all weights are zero (score 0.5). Extra columns are not
    read. Training repeats exactly for the same rows, in any partitioning.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("id"))
    known = F.broadcast(written(hashed_sample(known, "h", known.count(), sample), "labelled"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(known.select("id"), "id", "left_semi")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, zlib.crc32(t.encode("utf-8", "surrogatepass")), k.tobytes(), x.tobytes()) for i, t in zip(f["id"], f["text"]) for k, x in [features(t)]]
            yield pd.DataFrame(rows, columns=["id", "crc", "k", "x"])

    kind = texts.schema["id"].dataType.simpleString()
    counted = texts.mapInPandas(count, f"id {kind}, crc long, k binary, x binary").groupBy("id").agg(F.min(F.struct("crc", "k", "x")).alias("row"))
    rows = written(counted, "features").join(known, "id").select("h", "id", "y", "row.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = []
        for f in frames:
            got += [(h, i, y, crc, np.frombuffer(k, np.int64), np.frombuffer(x, np.float64)) for h, i, y, crc, k, x in zip(f["h"], f["id"], f["y"], f["crc"], f["k"], f["x"])]
        got.sort(key=lambda r: r[:4])
        yield pd.DataFrame({"w": [learn([(k, x, y) for _, _, y, _, k, x in got]).tobytes()]})

    w = rows.repartition(1).mapInPandas(run, "w binary").collect()
    return np.frombuffer(w[0]["w"], np.float32) if w else np.zeros(BUCKETS, np.float32)


def score_of(text: Column, w: np.ndarray) -> Column:
    """The score of each whole text, null as empty; never null. It depends on the text alone, so equal rows score alike.

    The model (1 MB, fixed by BUCKETS) is broadcast; rows are scored where they lie, no shuffle, and only
    the text goes to Python.
    """
    shared = SparkSession.getActiveSession().sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for s in series:
            yield pd.Series([score(t or "", own) for t in s], dtype="float64")

    return run(F.coalesce(text, F.lit("")))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0
