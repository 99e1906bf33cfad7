"""Spelling variants, toxicity and whitening: plain versions, odd rows, long texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from inkframe.llm import queries, toxicity, variants, whitening

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, word string, n long, key string, own boolean, id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "k", True, "x") for i, t in rows], KIND).repartition(3)


def plain_variants(rows):
    """Words as the contract has them, and each word's near ones by trying every pair of one length or one apart."""
    import re

    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w, k in n.items():
        near = [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 10 * k else None, k, len(near))
    return {(w, f, _end(out, w), k, c, n[f] if f else None) for w, (f, k, c) in out.items()}


def _end(out, w):
    while out[w][0]:
        w = out[w][0]
    return w


@pytest.fixture(scope="module")
def spelled():
    r = random.Random(7)
    words = ["".join(r.choice("abé") for _ in range(r.choice((7, 8, 8, 9, 10)))) for _ in range(250)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Éaaaaaa", "z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1499]
    words += ["abcdefgh"[:k] + c + "abcdefgh"[k:] for k in range(9) for c in "xyh"]
    texts = [(k, " ".join(r.choice(words).title() if r.random() < 0.1 else r.choice(words) for _ in range(60))) for k in range(60)]
    texts += [(90, "commonword " * 2000), (91, "commonwort " * 150 + "commonvort " * 9), (None, "commonwort\tcommonvort"), (92, None), (93, ""), (93, "cafés-abc÷def 1234567 中文中文中文中文"), (94, " ".join(words[-40:])), (94, " ".join(words[-40:]))]
    return texts


@pytest.mark.parametrize("limit", [2048, 8, 2])
def test_variants_equal_plain_version(spark, spelled, limit):
    got = variants.group_variants(docs_of(spark, spelled), limit=limit).collect()
    assert {tuple(r) for r in got} == plain_variants(spelled) and len(got) == len(set(got))
    assert ("commonvort", "commonwort", "commonword") in {(r["word"], r["form"], r["root"]) for r in got}


def test_variants_equal_sql_and_take_empty_tables(spark):
    got = queries.op11_variants(spark, SF).toPandas().set_index("word").sort_index()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = con.execute(queries.VARIANTS_SQL).df().set_index("word").sort_index()
    assert got.astype(object).where(got.notna(), None).equals(want[got.columns].astype(object).where(want[got.columns].notna(), None))
    assert variants.group_variants(docs_of(spark, [(1, None), (2, "")])).collect() == []


def test_text_is_counted_alike_in_steps(monkeypatch):
    from inkframe.llm import words

    text = "AbÉxy, zürich中zürich 12 end" * 50
    whole = [w for part in words.runs(words.lower(text.encode()), variants.RUN, variants.BORDER) for w in part]
    steps = [w for part in words.runs(words.lower(text.encode()), variants.RUN, variants.BORDER, 5) for w in part]
    assert whole == steps and whole[0] == "abÉxy".encode()


def test_merge_keeps_what_enough_lists_hold():
    r = np.random.default_rng(3)
    held = [np.flatnonzero(r.random(60) < 0.3) for _ in range(40)]
    posts = np.sort(np.concatenate([(k << 32) + x for k, x in enumerate(held)]))
    lists = r.integers(-1, 40, (50, 6))
    for least in (1, 2, 4):
        first = r.integers(0, 30, 50)
        p, e = variants.merged(posts, lists, first, least)
        want = {(a, b) for a in range(50) for b in range(first[a], 60) if sum(k >= 0 and b in held[k] for k in lists[a]) >= least}
        assert set(zip(p.tolist(), e.tolist())) == want and len(p) == len(want)


@pytest.fixture(scope="module")
def model(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    return toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))


def test_toxicity_holds_out_and_repeats(spark, model):
    sf = SF.replace("0.001", "0.01")
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("toxic", "lang", toxicity.score_of(F.col("text"), model).alias("s")).collect()
    said = [(r["toxic"], r["s"] >= 0.3) for r in rows if r["lang"] == "en"]
    assert sum(y == p for y, p in said) >= 0.95 * len(said)  # the other languages have too few toxic rows here
    again = toxicity.train(docs.repartition(5), labels.repartition(2).where(~toxicity.held_out(F.col("doc_id"))))
    assert again.toxic == model.toxic and again.ordinary == model.ordinary and np.array_equal(again.weights, model.weights)


def test_toxicity_features_equal_plain_compression(model):
    import re

    text = "Moron! The Été is worthless, 12 trash trash."
    d = toxicity.Distance(model.ordinary, model.toxic)

    def size(window, content):
        how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=16, chain_log=17, search_log=6, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
        given = zstandard.ZstdCompressionDict(content + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=given, compression_params=how).compress(window + toxicity.TAIL))

    gains = []
    for w in re.findall(r"\w+", text.lower()):
        window = f" {w} ".encode()
        gains.append(size(window, model.ordinary) - size(window, model.ordinary + model.toxic))
    x = d.features(text)
    assert x[0] == sum(g >= 1 for g in gains) / len(gains) and math.isclose(x[-2], sum(gains) / len(gains))
    assert max(gains) >= 3 and d.features(text) is not x and np.array_equal(d.features(text), x)


def test_toxicity_takes_odd_rows(spark, model):
    long = "worthless " * 400_000
    rows = docs_of(spark, [(1, None), (2, ""), (2, ""), (None, "a b"), (3, long), (4, "x" * 3_000_000), (5, "\U0001f600 中")])
    got = rows.select("doc_id", toxicity.score_of(F.col("text"), model).alias("s")).collect()
    assert len(got) == 7 and all(0 <= r["s"] <= 1 for r in got) and len({r["s"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert rows.where("false").select(toxicity.score_of(F.col("text"), model)).collect() == []
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    for given in (labels, labels.where("false"), labels.where("toxic = 1")):
        m = toxicity.train(rows, given)
        assert 0 <= rows.select(F.max(toxicity.score_of(F.col("text"), m))).first()[0] <= 1
    assert toxicity.train(rows, labels.where("false")).score(np.ones(toxicity.GAINS + 6)) == 0.5


VECTORS = [
    (1, [0.5, -0.25, 1.0]), (2, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3]), (3, [-0.0, 0.0, 0.0]), (None, [1.0, 2.0, -3.0]), (4, [0.1001, 0.2, 0.3]),
    (5, None), (6, [1.0, None, 0.0]), (7, [float("nan"), 0.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (9, [7.0, -1.5, 0.25]), (10, []), (11, [2.0]), (12, [2.0]), (13, [1.0, 2.0]), (14, [3.0, 5.0]),
]


def plain_whitening(rows):
    """In float64, but for sums: by width, the covariance of the distinct vectors and its eigenvectors."""
    out, wide = [], defaultdict(list)
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            wide[len(v)].append((i, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    for width, got in wide.items():
        x = sorted({v for _, v in got})
        n, s = len(x), [sum(c) for c in zip(*x)]
        m = np.array(x, float) - np.array(s) / n
        e, u = np.linalg.eigh(m.T @ m / n)
        for i, v in got:
            d = sum((n * c - t) ** 2 for c, t in zip(v, s))
            for k in range(min(4, width)):
                value, vector = e[-1 - k], u[:, -1 - k]
                if value < 1e-9 * max(1, e[-1]):
                    out.append((i, k + 1, n, d, None, 0.0))
                else:
                    z = (np.array(v) - np.array(s) / n) @ (vector if vector[np.abs(vector).argmax()] > 0 else -vector) / math.sqrt(value)
                    out.append((i, k + 1, n, d, z, value / e.sum()))
    return out


def test_whitening_equals_plain_version(spark):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in VECTORS], "vec_id long, embedding array<float>, x int, part int").repartition(3)
    got = whitening.whiten(df).collect()
    want = plain_whitening(VECTORS)
    key = lambda r: (repr(r[0]), r[1], r[3])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(a)[:4] == b[:4] and a["deviation_exact"] == str(b[3])
        assert (a["whitened"] is None) == (b[4] is None) and (b[4] is None or math.isclose(a["whitened"], b[4], rel_tol=1e-9, abs_tol=1e-9))
        assert math.isclose(a["explained"], b[5], rel_tol=1e-9, abs_tol=1e-15) and a["identity_error"] < 1e-9
    assert whitening.whiten(df.where("vec_id = 5")).collect() == []


def test_whitening_of_the_table(spark):
    got = queries.op13_whitening(spark, SF).toPandas()
    x = queries.table(spark, SF, "embeddings").toPandas()
    v = np.floor(256 * np.stack(x["embedding"]).astype(float)).astype(np.int64)
    own = np.unique(v, axis=0)
    n, s = len(own), own.sum(axis=0)
    assert len(got) == 4 * len(x) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-12
    d = {i: int(((n * r - s) ** 2).sum()) for i, r in zip(x["vec_id"], v)}
    assert all(d[i] == y for i, y in zip(got["vec_id"], got["deviation"]))
    e = np.linalg.eigvalsh((own - s / n).T @ (own - s / n) / n)[::-1]
    for k in range(4):
        part = got[got["component"] == k + 1]
        assert np.allclose(part["explained"], e[k] / e.sum(), rtol=1e-12)


def test_products_are_exact_and_small_eigenvalues_hold():
    r = np.random.default_rng(5)
    x = r.integers(-9, 10, (5000, 6)) * np.array([10**15, 10**11, 10**7, 1000, 10, 1])
    n, s = len(x), [int(c) for c in x.astype(object).sum(axis=0)]
    y = whitening.centred(x, n, s)
    assert y.dtype == object
    m = y.T.dot(y)
    assert (whitening.gram(y) == m).all()
    w = whitening.solve(n, s, m)
    # columns of such different size are nearly uncorrelated, so what is left of a column after the larger ones is its eigenvalue
    left, want = [[float(c) for c in row] for row in (m / n).tolist()], []
    left = np.array(left) / n**2
    for k in range(4):
        want.append(left[k, k])
        left = left - np.outer(left[:, k], left[k]) / left[k, k]
    assert np.allclose(w.deviations**2 / n**2, want, rtol=1e-6) and w.identity_error < 1e-4
    extreme = np.array([[2**63 - 1, -(2**63), 0], [0, 5, 1], [7, 7, 2]])
    s = [int(c) for c in extreme.astype(object).sum(axis=0)]
    y = whitening.centred(extreme, 3, s)
    assert (whitening.gram(y) == y.T.dot(y)).all()


def test_whitening_takes_huge_entries_and_long_deviations(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    assert len(got) == 6 and got[1, 1]["deviation"] is None
    x = [[2**63 - 1, 256], [-(2**63), 512], [0, 768]]
    s = [sum(c) for c in zip(*x)]
    assert got[1, 2]["deviation_exact"] == str(sum((3 * a - b) ** 2 for a, b in zip(x[0], s)))
