"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import ann, bpe, chat, embed_dedup, html_text, packing, pii, quality, simhash, toxicity, variants, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks() -> bytes:
    """The driver reads the vocabulary (a fixed half megabyte); it travels with the plan."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def added_tokens() -> tuple[tuple[str, int], ...]:
    """(string, id) of the tokens that the JSON vocabulary adds to the ranks; it matches them in texts as they stand."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), quality.held_out(F.col("doc_id"))
    w = quality.train(docs, table(spark, sf_dir, "labels").where(~out))
    rows = docs.select("doc_id", out.alias("held_out"), quality.score_of(F.col("text"), w).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digests(chat.format_chats(rows.unionByName(more)))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN, with_ids=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN, added=added_tokens())


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_text.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~out))
    rows = docs.select("doc_id", out.alias("held_out"), toxicity.score_of(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _escaped_sql(text: str) -> str:
    e = chat.TEMPLATE["escape"]
    out = f"replace({text}, '{e}', '{e}0')"
    for k, x in enumerate(chat.controls(chat.TEMPLATE), 1):
        out = f"replace({out}, '{x}', '{e}{k}')"
    return out


def _chat_sql() -> str:
    t = chat.TEMPLATE
    close = len(t["close"])
    marks = " ".join(f"WHEN role = '{r}' THEN {len(m)}" for r, m in t["open"].items())
    return f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, CASE {marks} ELSE {len("".join(t["other"]))} + length({_escaped_sql("role")}) END + length({_escaped_sql("text")}) + {close} AS n,
           lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS final
    FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST({len(t["begin"])} + sum(n) AS BIGINT) AS formatted_chars,
       bool_and((before || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AND max(role) FILTER (WHERE final) = 'assistant' AS in_order
FROM sized GROUP BY conv_id"""


WARC_SQL = """
WITH rows AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
ranked AS (
    SELECT *, first_value(page_id) OVER w AS top, row_number() OVER w AS k
    FROM rows WINDOW w AS (PARTITION BY d ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND k > 1 THEN top END AS refers_to, CASE WHEN n >= 1000 AND k > 1 THEN NULL ELSE true END AS intact
FROM ranked"""


#: Every pair compared: for small tables only.
LINKS_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a),
classes AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM classes"""

NEAREST_SQL = """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
    FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10"""


def _crc32_step(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8, byte by byte."""
    table = "[" + ", ".join(str(_crc32_step(c)) for c in range(256)) + "]"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST(('0x' || x) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, list_extract({table}, (xor(c, x) & 255) + 1)), CAST(4294967295 AS BIGINT)), 4294967295)"


#: Words with one code point left out meet: two of one length at the same place, or one with the other itself.
VARIANTS_SQL = f"""
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents) GROUP BY 1, 2 HAVING length(r) >= 7),
hashed AS (SELECT *, {_crc32_sql("id || ':' || r")} AS h FROM runs),
noisy AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
    UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest),
near AS (
    SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS best, max(w.n) AS best_n
    FROM pairs JOIN words w ON w.word = b GROUP BY a),
rows AS MATERIALIZED (
    SELECT word, CASE WHEN best_n >= 10 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
    FROM words LEFT JOIN near USING (word)),
chain(word, stop, form) AS (
    SELECT word, word, form FROM rows
    UNION ALL SELECT c.word, r.word, r.form FROM chain c JOIN rows r ON r.word = c.form)
SELECT r.word, r.form, c.stop AS root, n, n_near, form_n FROM rows r JOIN chain c ON c.word = r.word AND c.form IS NULL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality, op2_warc, op3_embedding_dedup, op4_nearest, op5_simhash, op6_chat, op7_bpe, op8_packing, op9_html, op10_pii, op11_variants, op12_toxicity, op13_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op3_embedding_dedup": LINKS_SQL, "op4_nearest": NEAREST_SQL, "op6_chat": _chat_sql(), "op11_variants": VARIANTS_SQL}
