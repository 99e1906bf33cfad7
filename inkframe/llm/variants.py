"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm.store import join_hot, written
from inkframe.llm.words import lower, runs

#: Shortest word, least number of occurrences, and how many times as frequent a form is.
LENGTH, OCCURRENCES, TIMES = 7, 2, 10
#: One run in so many has a code point deleted.
NOISE = 31
#: Rows of a shard of the index from which it is split; rows by lists that are merged at a time; words that a
#: task counts before it passes them on.
SHARD, CELLS, COUNTED = 2048, 1 << 18, 400_000

#: Lower-cased UTF-8: a-z and U+00C0 to U+00FF, the latter always a byte C3 and another one. Other ASCII ends a run.
RUN, BORDER = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+"), re.compile(rb"[\x00-`{-\x7f]")

NONE = np.iinfo(np.int64).max


def noisy(run: bytes, seed: int) -> bytes:
    """The run, or what is left of it if its checksum says so; ``seed`` is the CRC-32 of the id and a colon."""
    h = zlib.crc32(run, seed)
    if h % NOISE:
        return run
    s = run.decode()
    k = h % len(s)
    return (s[:k] + s[k + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words of at least ``length`` code points with at least ``least`` occurrences.

    A run counts once a document and occurrences are summed in tasks before they shuffle, so a frequent word is no
    hot key. Null texts have no words; a null id is written as nothing (``:word``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])
            n.clear()
            return out

        for b in batches:
            for i, text in zip(b.column(0), b.column(1).cast(pa.binary())):
                seed = zlib.crc32(i.as_py().encode() + b":")
                for part in runs(lower(text.as_py()), RUN, BORDER):
                    for w, k in Counter(part).items():
                        if len(w) >= length and len(w := noisy(w, seed).decode()) >= length:
                            n[w.encode()] += k
                    if len(n) >= COUNTED:
                        yield passed()
        yield passed()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _region(own: Column, size: Column, a: Column, b: Column) -> Column:
    """A row of the shard of words equal but for one edit at a place of the longer word from ``a`` to before ``b``.

    The longer word has ``size`` code points; a word that isn't ``own`` has one less, so what follows ``b`` in the
    longer word begins one place earlier in it.
    """
    rest = F.when(own, b).otherwise(b - 1)
    key = F.concat_ws(":", size, a, b, F.substring(F.col("word"), F.lit(1), a), F.substring(F.col("word"), rest + 1, size))
    return F.struct(own.alias("own"), size.alias("size"), a.alias("a"), b.alias("b"), key.alias("key"))


def _halves(rows: DataFrame) -> DataFrame:
    """Both halves of each row's region (columns own, size, a, b), with the key of what lies outside the half."""
    c = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    own, size, a, b = (F.col(x) for x in ("own", "size", "a", "b"))
    both = F.explode(F.array(_region(own, size, a, c), _region(own, size, c, b))).alias("r")
    return rows.select("word", "n", both).select("word", "n", "r.*")


def shards(words: DataFrame, limit: int = SHARD) -> DataFrame:
    """The index dealt to shards: (word, n, own, size, a, b, key), rows of one ``key`` in one shard.

    An edit leaves one half of a word as it is, so a word is dealt by each half, as the longer or an equally long
    partner and as the shorter one. A shard of over ``limit`` rows is halved again by the region its words may differ
    in, as often as it takes, until words of a shard differ in three code points in a row at most. So no shard
    follows the number of words, every pair meets in exactly one, and shards of one word are dropped.
    """
    n = F.length("word")
    rows = _halves(words.select("word", "n", F.explode(F.array(F.struct(F.lit(True).alias("own"), n.alias("size")), F.struct(F.lit(False).alias("own"), (n + 1).alias("size")))).alias("r"))
                   .select("word", "n", "r.own", "r.size", F.lit(0).alias("a"), F.col("r.size").alias("b")))
    found: DataFrame | None = None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("own").alias("any_own"), F.first(F.col("b") - F.col("a")).alias("wide"))
        sizes = written(sizes.where((F.col("rows") > 1) & F.col("any_own")).drop("any_own"), "shard-sizes")
        sized = join_hot(rows, sizes, "key", "rows")
        split = (F.col("rows") > limit) & (F.col("wide") > 3)
        ready = sized.where(~split).drop("rows", "wide")
        found = ready if found is None else found.unionByName(ready)
        if not sizes.where(split).limit(1).count():
            return found
        rows = written(_halves(sized.where(split).drop("rows", "wide", "key")), "shards")


def merged(posts: np.ndarray, lists: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(probe, entry) of the entries that at least ``least`` of a probe's posting lists hold, from ``first`` on.

    ``posts`` are all lists in one ascending array of list * 2^32 + entry; ``lists`` holds a row of list numbers a
    probe (below 0: none). All probes merge their lists at once: each keeps the front of its lists, as the heap of a
    merge does, takes the ``least``-th smallest of them, below which no entry can be in so many lists, and
    leaps there in all its lists; lists that are at it then step on.
    """
    key = np.where(lists < 0, NONE >> 32, lists) << 32
    ends = np.append(posts, NONE)
    at = np.searchsorted(posts, key + first[:, None])
    probe = np.arange(len(lists))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    low = (1 << 32) - 1

    def front() -> np.ndarray:
        x = ends[at]
        return np.where((x ^ key) >> 32 == 0, x & low, low)

    now = front() if lists.shape[1] >= least else np.full((len(lists), least), low)
    while len(probe):
        v = np.partition(now, least - 1, axis=1)[:, least - 1]
        go = v < low
        if not go.all():
            probe, key, at, v = probe[go], key[go], at[go], v[go]
        if not len(probe):
            break
        at = np.searchsorted(posts, key + v[:, None])
        now = front()
        hit = now == v[:, None]
        enough = hit.sum(axis=1) >= least
        out.append((probe[enough], v[enough]))
        at = at + hit
        now = front()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _same_length(letters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (letters[i] != letters[j]).sum(axis=1) == 1


def _one_longer(letters: np.ndarray, size: int, b: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether word i without its first code point that differs from word j is word j, and that one lies before ``b``."""
    s, t = letters[i, 1 : size + 1], letters[j, 1:size]
    same = s[:, :-1] == t
    first = np.where(same.all(axis=1), size - 1, same.argmin(axis=1))
    moved = s[:, 1:] == t
    return (first < b) & (moved | (np.arange(size - 1) < first[:, None])).all(axis=1)


def near_pairs(words: list[str], own: np.ndarray, group: np.ndarray, size: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of words of one group that differ by exactly one edit at a place from ``a`` to before ``b``.

    ``own`` words have ``size`` code points, the others one less; a pair has an own word. Each pair comes once. The index holds
    2-grams with their places, of words between two zeros; of the b - a + 1 grams around the region an edit leaves all
    but 2, at their place or, in a word one shorter, at theirs or one before.
    """
    letters = np.zeros((len(words), size + 2), np.uint8)
    for k, w in enumerate(words):
        x = w.encode("latin-1")
        letters[k, 1 : len(x) + 1] = np.frombuffer(x, np.uint8)
    width = b - a + 1
    grams = letters[:, a : b + 1].astype(np.int64) * 256 + letters[:, a + 1 : b + 2]
    if b - a == 1:
        grams[:] = 0  # the edit may touch both grams, so all words of the group are candidates
    place = np.arange(width)
    keys = ((group[:, None] * (size + 2) + place) << 16) + grams
    least = max(1, width - 2)
    mine, short = np.flatnonzero(own), np.flatnonzero(~own)
    found = []
    names, lists = np.unique(keys[mine], return_inverse=True)
    lists = lists.reshape(len(mine), width)
    posts = np.sort((lists << 32) + mine[:, None], axis=None)
    p, j = merged(posts, lists, mine + 1, least)
    i = mine[p]
    ok = _same_length(letters, i, j)
    found.append((i[ok], j[ok]))
    if len(short) and len(mine):
        held = keys[short][:, : width - 1]
        names = np.unique(held)
        posts = np.sort((np.searchsorted(names, held) << 32) + short[:, None], axis=None)
        asked = np.concatenate([keys[mine][:, : width - 1], keys[mine][:, 1:] - (1 << 16)], axis=1)
        spot = np.searchsorted(names, asked)
        lists = np.where(names[np.minimum(spot, len(names) - 1)] == asked, spot, -1)
        p, j = merged(posts, lists, np.zeros(len(mine), np.int64), least)
        i = mine[p]
        ok = _one_longer(letters, size, b, i, j)
        found.append((i[ok], j[ok]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _block(words: list[str], n: np.ndarray, own: np.ndarray, group: np.ndarray, size: int, a: int, b: int) -> pa.RecordBatch:
    i, j = near_pairs(words, own, group, size, a, b)
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words, dtype=object), kind="stable")] = np.arange(len(words))
    order = np.lexsort([rank[j], -n[j], i])
    i, j = i[order], j[order]
    of, first, count = np.unique(i, return_index=True, return_counts=True)
    best = j[first]
    columns = [pa.array([words[k] for k in of], pa.string()), pa.array(count, pa.int64()), pa.array([words[k] for k in best], pa.string()), pa.array(n[best], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "near", "best", "best_n"])


def near_words(words: DataFrame, limit: int = SHARD) -> DataFrame:
    """(word, n_near, best, best_n) of the words of ``words`` (word, n) that have a near word.

    ``best`` is the near word of largest n, of equals the smallest. Shards meet in tasks, whole; a task merges
    posting lists for many words at a time and passes on a row a word and shard, never pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(kept).combine_chunks()
            key = t["key"].combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            size, a, b = (t[c].to_numpy() for c in ("size", "a", "b"))
            n, own = t["n"].to_numpy(), t["own"].to_numpy(zero_copy_only=False)
            upto = len(starts) - (1 if last else 2)  # the last shard may go on in the next batch
            k = 0
            while k < upto:
                lo, e = starts[k], k + 1
                while e < upto and (size[starts[e]], a[starts[e]], b[starts[e]]) == (size[lo], a[lo], b[lo]) and (starts[e + 1] - lo) * 2 * (b[lo] - a[lo] + 1) <= CELLS:
                    e += 1
                hi = starts[e]
                yield _block(t["word"].slice(lo, hi - lo).to_pylist(), n[lo:hi], own[lo:hi], key[lo:hi].astype(np.int64) - key[lo:hi].min(), int(size[lo]), int(a[lo]), int(b[lo]))
                k = e
            kept[:] = t.slice(starts[max(upto, 0)]).to_batches()

        for batch in batches:
            kept.append(batch)
            if sum(x.num_rows for x in kept) >= 50_000:
                yield from done(False)
        if kept:
            yield from done(True)

    rows = shards(words, limit).repartition("key").sortWithinPartitions("size", "a", "b", "key", "word")
    found = rows.select("word", "n", "own", "size", "a", "b", "key").mapInArrow(run, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("x")).select("word", "n_near", F.col("x.w").alias("best"), (-F.col("x.m")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for ``links`` (word, form): the end of the chain of forms from each word on.

    Each form is ``TIMES`` as frequent as its word, so chains are no longer than the largest count has digits.
    A word has a few thousand possible near words at most, so no form is a hot key.
    """
    out = links.select("word", F.col("form").alias("root"))
    step = links.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while True:
        moved = written(out.join(step, "root").select("word", "next"), "chains")
        if not moved.limit(1).count():
            return out
        out = written(out.join(moved, "word", "left").select("word", F.coalesce("next", "root").alias("root")), "chains")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, limit: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row a word.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased, some with a code point
    deleted by checksum (``noisy``); ``form`` is the near word of largest n if that is at least ``times`` the word's n, ``root``
    the end of the chain of forms, the word itself if it has none. Null and empty texts, and an empty table, have no words; repeated
    rows count as often as they stand; a run of any length is one word; extra columns aren't read.
    """
    words = written(word_counts(docs, id_col, text_col), "words")
    near = near_words(words, limit).select(F.col("word").alias("w"), "n_near", "best", "best_n")
    near = words.join(near, F.col("word") == F.col("w"), "left").drop("w")
    ok = F.col("best_n") >= times * F.col("n")
    rows = written(near.select("word", F.when(ok, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("best_n")).alias("form_n")), "near-words")
    ends = roots(rows.where(F.col("form").isNotNull()).select("word", "form")).select(F.col("word").alias("w"), "root")
    return rows.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
