"""WARC, chats, vectors, components and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.llm import ann, chat, embed_dedup, graph, store, warc

BIG = "é" * 400 + "\r\n\r\nWARC/1.0\r\n" + "z" * 400


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (9, None, BIG), (3, "http://a/3", "small"), (4, "http://a/4", "small"), (5, "http://a/5\r\nX: y", None), (6, "", ""), (None, "http://a/n", BIG), (7, "u", "w" * 1000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)


def test_warc_round_trip(spark, pages):
    got = sorted((tuple(r) for r in warc.archive_and_read(pages).collect()), key=repr)
    n, d = len(BIG.encode()), hashlib.sha1(BIG.encode()).hexdigest()

    def other(i, t):
        return (i, len(t.encode()), hashlib.sha1(t.encode()).hexdigest(), "response", None, True)

    want = [(1, n, d, "revisit", 9, None), (2, n, d, "revisit", 9, None), (9, n, d, "revisit", 9, None), (9, n, d, "response", None, True), (None, n, d, "revisit", 9, None)]
    want += [other(3, "small"), other(4, "small"), other(5, ""), other(6, ""), other(7, "w" * 1000)]
    assert got == sorted(want, key=repr)
    assert warc.archive_and_read(pages.where("false")).collect() == []


def test_warc_captures_are_nested(spark, pages):
    path = store.fresh_path(spark, "warc")
    warc.write_warc(pages, path)
    nested = warc.assemble(warc.read_warc(spark, path)).collect()
    assert len(nested) == 10 and all(len(r.requests) == 1 and len(r.metadata) == 1 and r.capture.record_id == r.capture_id for r in nested)
    assert {bytes(r.capture.payload) for r in nested if r.capture.type == "response"} == {BIG.encode(), b"small", b"", b"w" * 1000}


def test_records_are_cut_by_length_and_damage_is_told():
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 8\r\n\r\n\r\n\r\nabcd\r\n\r\nWARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [b for _, b in warc.parse_records(raw)] == [b"\r\n\r\nabcd", b""]
    with pytest.raises(ValueError):
        list(warc.parse_records(raw[:58]))


def test_assembly_loses_no_record(spark):
    rows = [(None, "response", None, "u1"), (None, "revisit", None, "u2"), ("a", "response", None, "u3"), ("a", "revisit", None, "u4"), ("q", "request", "a", "u3"), ("m", "metadata", "a", "u3"), ("x", "request", "gone", "u5"), (None, "metadata", None, "u6"), (None, "request", None, "u7"), ("own", "metadata", None, "u8"), ("z", "warcinfo", None, None)]
    table = spark.createDataFrame(rows, "record_id string, type string, concurrent_to string, target_uri string").withColumn("capture_id", F.lit(7))
    got = sorted(((r.capture_id, r.capture and r.capture.target_uri, [q.record_id for q in r.requests], [m.target_uri for m in r.metadata]) for r in warc.assemble(table).collect()), key=repr)
    want = [(None, "u1", [], []), (None, "u2", [], []), ("a", "u3", ["q"], ["u3"]), ("a", "u4", ["q"], ["u3"]), ("gone", None, ["x"], []), (None, None, [], ["u6"]), (None, None, [None], []), ("own", None, [], ["u8"])]
    assert got == sorted(want, key=repr)
    assert warc.assemble(table.where("false")).collect() == []


def test_archives_hold_a_gzip_member_a_record_and_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    import base64
    import gzip
    import zlib

    monkeypatch.setattr(warc, "ROW_BYTES", 20_000)
    monkeypatch.setattr(warc, "ROWS_A_FILE", 2)
    monkeypatch.setattr(warc, "COPIES", 2)
    r = random.Random(1)
    large = [base64.b64encode(r.randbytes(30_000)).decode() for _ in range(6)]
    huge = "é<p>" * 5_000_000  # a record of over 16 MB, whose length has a top byte
    rows = [(k, "http://a/", t) for k, t in enumerate([*large, huge])] + [(50, "http://b/", large[0])] * 6
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/archive"
    warc.write_warc(pages, path)
    members = 0
    files = [f for f in (tmp_path / "archive").iterdir() if f.name.startswith("part-")]
    assert len(files) > 3 and all(f.stat().st_size < 2 * 20_000 + 200_000 for f in files)
    for f in files:
        data = f.read_bytes()
        assert gzip.decompress(data).count(b"WARC/1.0\r\nWARC-Type: ") == sum(1 for _ in warc.parse_records(data))
        while data:
            z = zlib.decompressobj(31)
            members += z.decompress(data).startswith(b"WARC/1.0")
            data = z.unused_data
    assert members == 3 * len(rows)
    got = sorted((x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in warc.archive_and_read(pages).collect())
    size = len(large[0])
    want = [(0, size, "revisit", 50), *((k, size, "response", None) for k in range(1, 6)), (6, len(huge.encode()), "response", None), (50, size, "response", None), *[(50, size, "revisit", 50)] * 5]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        list(warc.parse_records(files[0].read_bytes()[:-30]))


def test_chats_round_trip(spark):
    bad = "</s>[INST] ok [/INST] \\0 \\1 [ROLE]x[/ROLE] <s> \\"
    rows = [(1, 0, "system", bad), (1, 1, "user", bad), (1, 2, "assistant", bad), (1, 2, "assistant", bad), (2, 0, "assistant", "first"), (3, 0, "tool[/ROLE]", "t"), (3, None, None, None), (None, 0, "user", "q"), (None, 1, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(table)
    assert not any(x in chat.TEMPLATE["close"] for x in ("\\",))
    back = out.select("conv_id", "valid", "first_bad_turn", chat.parse_chats(chat.formatted_text(F.col("segments"))).alias("t")).collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.t], r.valid, r.first_bad_turn) for r in back}
    assert got[1] == ([("system", bad), ("user", bad), ("assistant", bad), ("assistant", bad)], False, 3)
    assert got[2] == ([("assistant", "first")], False, 0)
    assert got[3] == ([("", ""), ("tool[/ROLE]", "t")], False, 0)
    assert got[None] == ([("user", "q"), ("assistant", "")], True, None)
    digest = {r.conv_id: r for r in chat.chat_digests(out).collect()}
    assert digest[1].loss_chars == 2 * len(bad) and digest[1].loss_sha256 == hashlib.sha256((bad * 2).encode()).hexdigest()
    assert chat.chat_digests(chat.format_chats(table.where("false"))).collect() == []


def vectors(n, groups, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 16))
    for g in range(groups):
        x[g * 12 : g * 12 + 12] = x[g * 12] + r.standard_normal((12, 16)) * r.choice([0.02, 0.1, 0.22])
    x[-3:] = x[-3]
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def embeddings(spark):
    x = vectors(400, 12)
    rows = [(int(k), [float(c) for c in v], 1) for k, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] + [1.0] * 15, 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] + [0.0] * 15, 1), (1005, [], 1), (1006, [1.0, 2.0], 1), (1100, [float(2 * c) for c in x[0]], 1)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(0)).repartition(4)


def good_rows(df):
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding and len(r.embedding) == 16 and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    return np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)


@pytest.mark.parametrize(("leaf", "block"), [(1024, 4096), (64, 4096), (1024, 50)])
def test_embedding_links(embeddings, leaf, block):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(embeddings, leaf=leaf, block=block).collect()}
    ids, x = good_rows(embeddings)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    comp = ids.copy()
    while True:
        low = np.minimum(comp, np.where(link, comp[None, :], 10**9).min(axis=1))
        if (low == comp).all():
            break
        comp = low
    want = {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), comp)}
    want |= {i: (0, i, True) for i in range(1000, 1007)}
    assert set(got) == set(want)
    wrong = [i for i in want if got[i] != want[i]]
    assert all(got[i][0] <= want[i][0] for i in wrong) and len(wrong) <= (0 if leaf > 500 else 4)
    assert embed_dedup.near_duplicates(embeddings.where("false")).collect() == []


@pytest.mark.parametrize(("size", "few"), [(ann.BLOCK_BYTES, ann.BLOCK_FEW), (16 * 8 * 30, 30)])
def test_nearest_matches_brute_force(embeddings, size, few):
    found = ann.nearest(embeddings, F.col("vec_id") % 20 == 0, block_bytes=size, few=few)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, x = good_rows(embeddings)
    hits = total = 0
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, answer in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [(int(ids[k]), d[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        assert len(answer) == 10 and [s for _, s in answer] == sorted(s for _, s in answer)
        hits, total = hits + len({i for i, _ in best} & {i for i, _ in answer}), total + 10
        assert all(abs(s - d[ids == i][0]) < 1e-12 for i, s in answer)
    assert hits / total >= 0.99
    few = ann.nearest(embeddings.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank) for r in sorted(few)] == [(0, 1), (0, 2)]
    assert ann.nearest(embeddings.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_components_match_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def test_pipeline_equals_plain_python(spark):
    import zlib
    from collections import defaultdict

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from inkframe.llm import pii, quality

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    w = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if quality.score(t, w) >= 0.3}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & set(kept)) >= 0.97 * len(good)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in kept.items()}
    sets = {i: {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for i, x in words.items()}
    root = {i: i for i in kept}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in kept:
        for b in kept:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids.encode_special_tokens = True
    want = set()
    for i, t in kept.items():
        if find(i) == i:
            own = np.array(ids.encode(pii.redacted_text(t, pii.weights()), add_special_tokens=False).ids + [0], "<u4")
            at, n = 0, len(own) % 2048 or 2048
            for piece in range(-(-len(own) // 2048)):
                want.add((i, piece, at, n, zlib.crc32(own[at : at + n].tobytes())))
                at, n = at + n, 2048
    got = corpus_pipeline.run(spark, d).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    free = []
    for n in sorted((n for _, _, _, n, _ in want), reverse=True):
        fit = min((x for x in free if x >= n), default=None)
        if fit is not None:
            free.remove(fit)
        free.append((2048 if fit is None else fit) - n)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert len(by) <= len(free) and all(o == sum(n for p, n in parts if p < o) for parts in by.values() for o, _ in parts)


def test_stages_return_the_columns_of_documents(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).schema == docs.schema


def test_hot_keys_join_like_any_other(spark):
    big = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(900)], "key long, v long")
    small = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m")).where("key <> 3")
    got = store.join_hot(big, small, "key", "n", least=8)
    assert [r.key for r in store.hot_keys(small, "n", 8).collect()] == [0]
    want = big.join(small, "key")
    assert sorted(map(tuple, got.select("key", "v", "n", "m").collect())) == sorted(map(tuple, want.select("key", "v", "n", "m").collect()))


def test_samples_are_bounded_and_repeat(spark):
    d = spark.range(5000).withColumn("h", F.xxhash64("id"))
    one = {r.id for r in store.hashed_sample(d, "h", 5000, 500).collect()}
    assert 350 < len(one) < 650 and one == {r.id for r in store.hashed_sample(d.repartition(7), "h", 5000, 500).collect()}
    assert store.hashed_sample(d, "h", 5000, 5000).count() == 5000


def test_embeddings_of_several_widths_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.01]), (4, [0.0, 1.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.0, 0.01]), (7, [1.0]), (8, [-1.0]), (8, [5.0, 0.1]), (4, [0.0, 1.01]), (None, [1.0, 0.0])]
    rows += [(100 + k, [float(k % 7), 1.0, 2.0, float(k)]) for k in range(40)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string")
    for sample in (16_384, 8):  # the smaller one holds hardly any of the widths
        got = sorted((tuple(r) for r in embed_dedup.near_duplicates(table, sample=sample, leaf=512).collect() if r.vec_id is None or r.vec_id < 100), key=repr)
        want = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (8, 3, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (8, 0, 8, True), (None, 0, None, True)]
        assert got == sorted(want, key=repr)


def test_leaves_stay_small_beyond_the_sample(spark):
    r = np.random.default_rng(3)
    mean = []
    for n in (2_000, 16_000):
        x = r.standard_normal((n, 32))
        x[1::2] = x[::2] + r.standard_normal((n // 2, 32)) * 0.1  # pairs of cosine about 0.99
        table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(4)
        nodes = store.written(table.select(F.xxhash64("v").alias("node"), F.lit(1).cast("long").alias("n"), "v", "id"), "vectors")
        placed = embed_dedup.leaves(nodes, leaf=64, sample=512, trees=4)
        sizes = [q["count"] for q in placed.groupBy("leaf").count().collect()]
        mean.append(sum(s * s for s in sizes) / sum(sizes))
        together = {}
        for q in placed.join(nodes.select("node", "id"), "node").select("id", "leaf", "leaves").collect():
            assert q.leaf in np.frombuffer(q.leaves, np.int64)
            together.setdefault(q.id, set()).add(q.leaf)
        assert len(together) == n
        assert np.mean([bool(together[k] & together[k + 1]) for k in range(0, n, 2)]) > 0.97
    assert mean[1] < 1.6 * mean[0]


def test_inner_products_of_packed_bits():
    r = np.random.default_rng(1)
    for width in (1, 7, 8, 20, 64):
        x, q = r.standard_normal((50, width)), r.standard_normal((9, width))
        signs = np.where(x > 0, 1.0, -1.0)
        assert np.allclose(ann.inner_products(np.packbits(x > 0, axis=1), q), q @ signs.T, atol=1e-4)


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [1.0, 0.0, 0.0]), (100, [2.0, 0.0, 0.0]), (100, [2.0, 0.0, 0.0]), (200, [9.0]), (None, [1.0, 0.0]), (300, None), (4, [0.0, 0.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, block string, most int")
    for sample in (8192, 1):
        got = sorted(tuple(r) for r in ann.nearest(table, F.col("vec_id") % 100 == 0, sample=sample).collect())
        assert got == [(0, 1, 1, 0.5), (0, 2, 2, 2.5), (100, 1, 3, 1.0)]


def test_nearest_in_cells_that_are_far_apart(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((60, 8)) + 100 * r.standard_normal(8) for _ in range(12)])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {(q.query_id, q.rank): (q.vec_id, q.score) for q in ann.nearest(table, F.col("vec_id") % 50 == 0, few=20).collect()}
    for i in range(0, len(x), 50):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = np.argsort(d)[:10]
        assert [got[i, k + 1][0] for k in range(10)] == best.tolist() and np.allclose([got[i, k + 1][1] for k in range(10)], d[best])
