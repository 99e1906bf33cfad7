"""Toxicity by compression distance: a zstandard dictionary of each class, windows compressed with both."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.store import hashed_sample, written
from inkframe.llm.words import runs

#: Labelled rows that training reads (twice as many at most).
SAMPLE = 12_000
#: Training text of the dictionaries: that many of the words of most ordinary texts, and the stems that stand out in
#: toxic ones by so many standard deviations and documents at least.
WORDS, STEMS, DEVIATIONS, LEAST = 20_000, 4096, 6.0, 3
#: Bytes of a stem, blank before it included; bytes of the ordinary dictionary; lengths of what training looks for.
SHORTEST, LONGEST, ORDINARY, SEGMENT, PIECE = 5, 25, 32_768, 16, 6
#: Stands behind every window and in both dictionaries, so that zstandard finds something in the last bytes of
#: a window and never stores it as it is.
TAIL = b"\n-- one window of a text, compressed by itself --\n"
#: Bytes saved that the calibration tells apart; windows whose saving a worker remembers.
GAINS, REMEMBERED = 12, 300_000

#: A window is a word: letters, digits and whatever isn't ASCII.
WORD, BORDER = re.compile(rb"[^\x00-/:-@\[-`{-\x7f]+"), re.compile(rb"[\x00-/:-@\[-`{-\x7f]")


def windows(text: str) -> Counter[bytes]:
    """The windows of a whole text, in lower case and between blanks, and how often each occurs."""
    n: Counter[bytes] = Counter()
    for part in runs(text.lower().encode("utf-8", "surrogatepass"), WORD, BORDER):
        n.update(part)
    return Counter({b" " + w + b" ": k for w, k in n.items()})


def surroundings(text: str) -> dict[bytes, int]:
    """Each word of a text between blanks, and a checksum of the words around its first occurrence."""
    out: dict[bytes, int] = {}
    for part in runs(text.lower().encode("utf-8", "surrogatepass"), WORD, BORDER):
        for before, w, after in zip([b"", *part], part, [*part[1:], b""]):
            if w not in out:
                out[w] = zlib.crc32(after, zlib.crc32(before + b" "))
    return {b" " + w[:LONGEST] + b" ": h for w, h in out.items()}


def stems(word: bytes) -> list[bytes]:
    """A word between blanks, and its beginnings."""
    return [word, *(word[:k] for k in range(SHORTEST, min(len(word) - 1, 13) + 1))]


class Distance:
    """What each window saves with the toxic dictionary against the ordinary one, in bytes."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.packers = [self._packer(ordinary + TAIL), self._packer(ordinary + toxic + TAIL)]
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _packer(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=16, chain_log=17, search_log=6, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        given.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=given, compression_params=how)

    def saved(self, window: bytes) -> int:
        got = self.known.get(window)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            a, b = (len(p.compress(window + TAIL)) for p in self.packers)
            got = self.known[window] = a - b
        return got

    def features(self, text: str) -> np.ndarray:
        """Shares and logarithms of the numbers of windows that save at least so many bytes, the mean, and how many there are."""
        n, total = np.zeros(GAINS), 0
        known, every = self.known, 0
        for w, k in windows(text).items():
            got = known.get(w)
            if got is None:
                got = self.saved(w)
            every += k
            total += k * got
            if got > 0:
                n[min(got, GAINS) - 1] += k
        at_least = n[::-1].cumsum()[::-1]
        return np.concatenate([at_least / max(1, every), np.log1p(at_least[1:8:2]), [total / max(1, every), math.log1p(every)]])


@dataclass(frozen=True)
class Model:
    """The two dictionaries, and the calibration: mean, deviation and weight of each feature, the first weight the bias."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> float:
        z = self.weights[0] + self.weights[1:] @ ((x - self.mean) / self.deviation)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def trained(samples: list[tuple[bytes, int]], size: int, whole: bool) -> bytes:
    """A dictionary of about ``size`` bytes from samples and how often each is repeated, in an order by checksum.

    With ``whole``, samples that training left out follow it, all of them where there are too few to train on.
    """
    order = sorted((zlib.crc32(s + b"%d" % k), s) for s, n in samples for k in range(n))
    try:
        out = zstandard.train_dictionary(size, [s for _, s in order], k=SEGMENT, d=PIECE).as_bytes()
    except zstandard.ZstdError:
        out = b""
    return out + b"".join(s for s, _ in samples if whole and s not in out)


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and weights of a logistic regression of ``y`` on the features, by Newton's method."""
    width = x.shape[1]
    if not len(x):
        return np.zeros(width), np.ones(width), np.zeros(width + 1)
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / deviation])
    w, keep = np.zeros(width + 1), ridge * len(x) * np.append(1e-3, np.ones(width))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return mean, deviation, w


def standing_out(counts: DataFrame, toxic: int, ordinary: int) -> tuple[list[bytes], list[tuple[bytes, int]]]:
    """Stems of toxic texts and words of ordinary ones, from ``counts`` (stem, t, o: documents of either class).

    A stem stands out if its toxic documents are DEVIATIONS standard deviations more than chance; of stems one of which begins
    the other, and in almost as many toxic documents, the longer one counts.
    """
    share = toxic / max(1, toxic + ordinary)
    usual = share * (F.col("t") + F.col("o"))
    z = (F.col("t") - usual) / F.sqrt(usual * (1 - share) + 1)
    out = counts.where((F.col("t") >= LEAST) & (F.length("stem") >= SHORTEST)).withColumn("z", z).where(F.col("z") > DEVIATIONS)
    found = {bytes(r["stem"]): r["t"] for r in out.orderBy(F.desc("z"), "stem").limit(STEMS).collect()}
    within = {s[:k] for s, t in found.items() for k in range(SHORTEST, len(s)) if t >= 0.8 * found.get(s[:k], t + t)}
    usual_words = counts.where((F.col("o") > 1) & F.hex("stem").endswith("20"))
    words = [(bytes(r["stem"]), r["o"]) for r in usual_words.orderBy(F.desc("o"), "stem").limit(WORDS).collect()]
    return [s for s in found if s not in within], words


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model learned from about ``sample`` labelled rows, chosen by the hash of their id.

    Tasks count in how many toxic and ordinary texts of the sample each stem occurs; the driver sees the STEMS stems that stand
    out most and the WORDS most usual words, and trains a dictionary on each list. Tasks then measure
    the sample's windows, and the driver fits the calibration to at most twice ``sample`` rows of 18 features. Null labels and
    ids teach nothing, null texts are empty; each label of an id teaches once, with the text of smallest CRC-32 if it has
    several. Without labelled rows every score is 0.5. Extra columns aren't read. Training repeats exactly.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    known = known.withColumn("h", F.xxhash64("id"))
    known = F.broadcast(written(hashed_sample(known, "h", known.count(), sample), "toxic-labels"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(known.select("id"), "id", "left_semi")
    one = texts.groupBy("id").agg(F.min(F.struct(F.crc32(F.col("text").cast("binary")).alias("crc"), F.col("text").alias("text"))).alias("x"))
    rows = written(one.join(known, "id").select("y", F.col("x.text").alias("text")), "toxic-texts")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for y, text in zip(f["y"], f["text"]):
                found = surroundings(text)
                yield pd.DataFrame({"word": list(found), "around": list(found.values()), "y": bool(y)})

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, t, o) for w, t, o in zip(f["word"], f["t"], f["o"]) for s in stems(w)]
            yield pd.DataFrame(rows, columns=["stem", "t", "o"])

    once = rows.mapInPandas(count, "word binary, around long, y boolean").distinct().groupBy("word").agg(F.count_if("y").alias("t"), F.count_if(~F.col("y")).alias("o"))
    counts = written(once.mapInPandas(begin, "stem binary, t long, o long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "stems")
    every = once.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    marked, usual = standing_out(counts, every["t"] or 0, every["o"] or 0)
    toxic = trained([(s, 4) for s in marked], max(256, sum(map(len, marked))), True)
    ordinary = trained([(w, 1 + int(math.log2(n))) for w, n in usual], ORDINARY, False)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Distance(ordinary, toxic)
        for f in frames:
            yield pd.DataFrame({"y": f["y"], "x": [d.features(t).tolist() for t in f["text"]], "crc": [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in f["text"]]})

    got = sorted((r["crc"], r["y"], r["x"]) for r in rows.mapInPandas(measure, "y int, x array<double>, crc long").collect())
    x = np.array([r[2] for r in got]).reshape(len(got), GAINS + 6)
    return Model(ordinary, toxic, *calibrated(x, np.array([float(r[1] != 0) for r in got])))


def score_of(text: Column, model: Model) -> Column:
    """The score of each whole text, null as empty; never null. It depends on the text alone, so equal rows score alike.

    The model (some 100 KB, bounded by ORDINARY and STEMS) is broadcast; rows are scored where they lie, without shuffle. An empty
    text has no windows and gets what the calibration gives such texts. Memory follows the longest text's distinct words.
    """
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        d = Distance(m.ordinary, m.toxic)
        for s in series:
            yield pd.Series([m.score(d.features(t or "")) for t in s], dtype="float64")

    return run(F.coalesce(text, F.lit("")))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2
