"""Odd rows, long texts, and plain versions of what SQL can't express."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkframe.llm import bpe, html_text, packing, pii, quality, queries, simhash, store

R = random.Random(12)
LONG = " ".join(f"{R.choice(['alpha', 'beta', 'gamma', '12', 'x@y.org', '4111 1111 1111 1111'])}{R.randrange(50)}" for _ in range(150_000))
KIND = "doc_id long, text string, lang string, source string, n_chars long, id string, part string, v int, length string, own string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (3, "three two one"), (None, "nobody"), (None, "nobody"), (4, LONG), (5, LONG), (6, " \n\t "), (7, "a b c d e f g h"), (8, "a b c d e f g h")]
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "x", 1, "x", "x") for i, t in texts], KIND).repartition(3)


def digest(rows, key):
    return sorted((tuple(r) for r in rows), key=lambda r: repr(r[key]) + repr(r))


def test_each_operator_takes_odd_rows(spark, odd):
    w = np.zeros(quality.BUCKETS, np.float32)
    ranks, pattern = queries.ranks(), public_tokenizers.PATTERN
    runs = {
        "score": lambda d: d.select("doc_id", quality.score_of(F.col("text"), w).alias("s")),
        "simhash": simhash.near_duplicates,
        "bpe": lambda d: bpe.encode(d, ranks, pattern, with_ids=False),
        "html": lambda d: d.select("doc_id", html_text.extract(F.col("text")).alias("t")),
        "pii": pii.report,
        "pack": lambda d: packing.pack(d, ranks, pattern).select("doc_id", "piece", "start", "length", "ids_crc32"),
    }
    for name, run in runs.items():
        one = digest(run(odd).collect(), 0)
        assert one == digest(run(odd.repartition(1)).collect(), 0), name
        assert run(odd.where("false")).collect() == [], name
        rows = Counter(r[0] for r in one if name != "pack" or r[1] == 0)
        assert rows == Counter({1: 1, 2: 1, 3: 3, None: 2, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}), name
        same = {i: [r[1:] for r in one if r[0] == i] for i in (4, 5, 7, 8)}
        assert same[7] == same[8] and same[4] == same[5] or name == "simhash", name


def test_long_text_has_the_plain_fingerprint():
    import xxhash

    words = LONG.lower().split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(len(words) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert simhash.fingerprint(LONG.encode()) == want


def plain_features(text):
    words = quality.TOKENS.findall(text)
    mask = (1 << 64) - 1
    h = [zlib.crc32((w if not w.isdigit() else "0").encode()) for w in words]
    pairs = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & mask) >> 40 for a, b in zip(h, h[1:])]
    again = [h[k] == h[k + 1] or any(k >= lag and pairs[k] == pairs[k - lag] for lag in (2, 3)) for k in range(len(pairs))]
    one = [(x * 0x9E3779B97F4A7C15 & mask) >> 40 for x in h]
    repeat = int(quality.REPEAT)
    one = [one[0], *(repeat if a else x for a, x in zip(again, one[1:]))] if one else []
    found = Counter(x % (quality.BUCKETS - 1) + 1 for x in [*one, *(repeat if a else p for a, p in zip(again, pairs))])
    n = max(1, sum(found.values()))
    return {0: 1.0} | {k: quality.SCALE * c / n for k, c in found.items()}


def test_features_and_learning_equal_plain_python():
    r = random.Random(7)
    texts = [" ".join(r.choice(["good", "plain", "words", "12", "!!", "so", "ß", "日本"]) for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", "so so so so", "a b a b a b a b"]
    rows = []
    for t in texts:
        k, x = quality.features(t)
        want = plain_features(t)
        assert dict(zip(k.tolist(), x.tolist())) == pytest.approx(want) and len(k) == len(want)
        rows.append((k, x, r.randrange(2)))
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -math.copysign(abs(z[k]) - quality.L1, z[k]) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for k, x, y in rows:
            own = {int(a): float(b) for a, b in zip(k, x)}
            w = {a: weight(a) for a in own}
            p = 1 / (1 + math.exp(-sum(w[a] * b for a, b in own.items())))
            for a, b in own.items():
                g = (p - y) * b
                z[a] += g - (math.sqrt(n[a] + g * g) - math.sqrt(n[a])) / quality.ALPHA * w[a]
                n[a] += g * g
    got = quality.learn(rows)
    assert {int(k) for k in np.flatnonzero(got)} == {k for k in z if weight(k)}
    assert all(abs(got[k] - weight(k)) < 1e-5 for k in z)
    for t in texts:
        want = 1 / (1 + math.exp(-sum(weight(a) * b for a, b in plain_features(t).items())))
        assert abs(quality.score(t, got) - want) < 1e-5


def test_training_takes_odd_labels(spark, odd):
    labels = spark.createDataFrame([(3, 1, "x"), (3, 1, "x"), (4, 0, "x"), (None, 1, "x"), (7, None, "x"), (99, 1, "x"), (1, 0, "x")], "doc_id long, quality int, text string")
    w = quality.train(odd, labels)
    assert (w == quality.train(odd.repartition(1), labels.repartition(1))).all() and w.any()


def test_ratios_equal_a_plain_version():
    r = random.Random(3)
    for _ in range(200):
        names = [f"/html/body/div.{k}/p" for k in range(r.randint(1, 6))]
        found = [(r.choice(names), "x" * r.randint(1, 40) + "," * r.randint(0, 9), r.randint(0, 60), r.choice([0, 0.1, 1, 1, 1]), 0) for _ in range(r.randint(0, 12))]
        order = list(dict.fromkeys(f[0] for f in found if f[3]))
        length = [np.mean([len(f[1]) for f in found if f[3] and f[0] == p]) for p in order]
        signs = [(sum(f[1].count(",") for f in found if f[3] and f[0] == p) + 1) / sum(1 for f in found if f[3] and f[0] == p) for p in order]

        def smooth(x):
            g = math.exp(-0.5)
            return [(x[k] + sum(g * x[j] for j in (k - 1, k + 1) if 0 <= j < len(x))) / (1 + sum(g for j in (k - 1, k + 1) if 0 <= j < len(x))) for k in range(len(x))]

        want = {}
        for p, a, b in zip(order, smooth(length), smooth(signs)):
            own = [f for f in found if f[3] and f[0] == p]
            want[p] = math.sqrt(a * b) * (1 - sum(min(f[2], len(f[1])) for f in own) / sum(len(f[1]) for f in own)) * min(f[3] for f in own)
        _, fused, limit = html_text.ratios(found)
        assert fused == pytest.approx(want) and limit == pytest.approx(0.8 * np.std(list(want.values())) if want else 0)


def test_ratios_decide_what_is_content(monkeypatch):
    part = "Words in a row, with signs; and more of them. It goes on, and on, for a while. "
    lists = "".join(f"<div class=b{k}><p>Some words {k} without any sign</p><p>And more like these</p><p>Once again</p></div>" for k in range(16))
    page = f"<body><div class=a2><p>{part * 4}</p><p>{part * 3}</p></div>{lists}</body>"
    want = "\n".join([(part * 4).strip(), (part * 3).strip()])
    assert html_text.main_text(page) == want
    whole = html_text.ratios
    monkeypatch.setattr(html_text, "ratios", lambda found: (whole(found)[0], {p: 1.0 for p in whole(found)[1]}, 0.5))
    assert html_text.main_text(page) != want


def test_long_pages_are_read_whole():
    page = "<html><body><article><h1>Head</h1>" + "".join(f"<p>Paragraph {k}, with some words; and signs.</p>" for k in range(20_000)) + "</article></body></html>"
    said = html_text.main_text(page).split("\n")
    assert len(said) == 20_001 and said[-1] == "Paragraph 19999, with some words; and signs."


def test_stages_take_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    labels = [(k, k % 2) for k in range(1000, 1200)]
    more = [(k, ("good plain words in a row of text number " if k % 2 else "$$$ ### !! | | ") * 5 + str(k), "en", "s", 0, "x", "x", 1, "x", "x") for k in range(1000, 1200)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table = odd.unionByName(spark.createDataFrame(more, KIND))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (table, odd, table.where("false")):
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if name != "best-fit packing":
                assert out.schema == docs.schema
            assert docs.count() or not rows
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, table, str(tmp_path)).collect()}
    assert {k for k in kept if k and k >= 1000} == {k for k in range(1000, 1200) if k % 2}
    left = Counter(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, odd, str(tmp_path)).collect())
    assert left == Counter({1: 1, 3: 2, None: 2, 4: 1, 7: 1})  # 2 and 6 are as empty as 1; the two texts of 3 have other words' order
    clean = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, odd, str(tmp_path)).collect()}
    assert clean[1].text is None and clean[1].n_chars is None and "x@y.org" not in clean[4].text and clean[4].n_chars == len(clean[4].text)


def test_intermediate_tables_can_be_removed(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(store, "_written", [])
    t = store.written(spark.range(5), "some")
    path = store._written[0]
    assert t.count() == 5 and os.path.isdir(path) and store.clean(spark) == 1 and not os.path.exists(path) and store._written == []


def test_ids_of_long_white_space_equal_the_library(spark):
    from tokenizers import Tokenizer

    enc = packing.encoder(queries.ranks(), public_tokenizers.PATTERN, queries.added_tokens())
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    parts = ["a", "'s", " ", "\n", "\t", "\x1c", "\x85", "é", "!", " " * 4100, "\n" * 4096, "　" * 4097, "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(300)]
    texts += ["x " + " " * 5_000_000 + "a", "x" + "\n" * 5_000_000 + "a", "x" + "\t " * 2_500_000 + "b", "x" + " " * 2_000_000]
    for t in texts:
        assert packing.ids_of(enc, t) == plain.encode(t, add_special_tokens=False).ids, t[:40]
    got = packing.pack(spark.createDataFrame([(1, texts[-4])], "doc_id long, text string"), queries.ranks(), public_tokenizers.PATTERN, added=queries.added_tokens()).collect()
    assert sum(p["length"] for p in got) == 5_000_003


def test_pages_of_any_depth_take_linear_work():
    import time

    pages = {
        "<div>" * 200_000 + "Text, here." + "</div>" * 200_000: "Text, here.",
        "<section>" * 2000 + "x" + "</div>" * 200_000: "x",
        "<ul><li>" + "<div>" * 100_000 + "</li>" * 200_000 + "a, b.": "a, b.",
        "<div class=sidebar>" * 200_000 + "a, b.": "a, b.",
        "<li><div>" * 100_000 + "</p>" * 100_000 + "c.": "c.",
    }
    for page, want in pages.items():
        began = time.process_time()
        assert html_text.main_text(page) == want
        assert time.process_time() - began < 20


def test_first_blocks_are_even_for_ids_that_share_a_divisor():
    from inkframe.llm import ann

    for blocks in (2, 4, 5, 10, 12, 25, 100):
        n = Counter(ann.first_block(100 * k, blocks) for k in range(20_000))
        assert len(n) == blocks and max(n.values()) <= 1.2 * min(n.values())


def test_a_very_long_turn_is_formatted():
    from pyspark.sql import SparkSession

    from inkframe.llm import chat

    said = "</s>[INST] \\ [/INST]" * 50_000
    rows = SparkSession.getActiveSession().createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    got = chat.chat_digests(chat.format_chats(rows)).first()
    assert got["loss_chars"] == len(said) and got["n_turns"] == 2
