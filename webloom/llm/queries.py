"""Registered queries of the corpus operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import chat, decontam, knn, licenses, linededup, mixing, packing, pii, repair, simhash, toxicity, warc, whitening
from webloom.llm.common import written
from webloom.session import scratch_path
from webloom.sources.tables import load_table

#: The conversation that the chat query adds: control strings inside both texts.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, load_table(spark, sf_dir, "labels")).drop("text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"archives-{uuid.uuid4().hex}")
    warc.write_archives(load_table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_records(spark, path))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(load_table(spark, sf_dir, "documents"),
                                                  load_table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: a folder per source, language and 64 ids; ids divisible by 64, 1024 and 8192 are
    the licence files of their folder, their language and their source."""
    docs = load_table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", F.lit("corpus"), "source", "lang", (F.col("doc_id") / 64).cast("long"))
    name = F.when(F.col("doc_id") % 8192 == 0, F.concat_ws("/", F.lit("corpus"), "source", F.lit("LICENSE"))).when(
        F.col("doc_id") % 1024 == 0, F.concat_ws("/", F.lit("corpus"), "source", "lang", F.lit("LICENSE"))).when(
        F.col("doc_id") % 64 == 0, F.concat(folder, F.lit("/LICENSE")))
    path = F.coalesce(name, F.concat(folder, F.lit("/"), F.col("doc_id"), F.lit(".txt")))
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text")).drop("text")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.quantized(load_table(spark, sf_dir, "embeddings"))
    vectors = written(vectors.withColumn("row", F.monotonically_increasing_id()), "numbered-vectors")
    return knn.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(load_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, load_table(spark, sf_dir, "labels")).drop("text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(load_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(CONTROL_TEXT).alias("text"))
    return chat.digest(chat.format_conversations(rows.unionByName(more)))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(load_table(spark, sf_dir, "documents")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = load_table(spark, sf_dir, "conversations")
    return repair.digest(*repair.repair(repair.damaged(conversations), conversations))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_licenses": op5_licenses,
    "op6_top_k": op6_top_k,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat": op10_chat,
    "op11_packing": op11_packing,
    "op12_repair": op12_repair,
    "op13_whitening": op13_whitening,
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + 12], ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
       FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
             FROM d, (SELECT DISTINCT size FROM win))),
hit AS (SELECT r, i, size, item FROM pos JOIN win USING (size, g)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""

OP6_SQL = """
WITH x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(c::double * 1024)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, cast(list_inner_product(q.v, x.v) AS bigint) AS score
      FROM x q JOIN x ON q.r <> x.r AND len(q.v) = len(x.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, cast(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS int) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def _pii_sql() -> str:
    def kind(rank: int, name: str, pattern: str, valid: str, score: float, context: str) -> str:
        return f"""
SELECT r, {rank} AS rank, '{name}' AS kind, m, g, k, {score} AS score, '{context}' AS context FROM (
  SELECT r, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(string_split_regex(text, '{pattern}')) AS g,
         unnest(range(len(string_split_regex(text, '{pattern}')))) AS k FROM d)""", f"WHEN '{name}' THEN {valid}"

    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (f"len({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len({digits}) + 1), lambda i: "
            f"(CASE WHEN i % 2 = 1 THEN cast(reverse({digits})[i] AS int) "
            f"ELSE (2 * cast(reverse({digits})[i] AS int)) // 10 + (2 * cast(reverse({digits})[i] AS int)) % 10 END))) % 10 = 0")
    bare = "replace(m, ' ', '')"
    mod97 = (f"len({bare}) BETWEEN 15 AND 34 AND cast(list_reduce(list_transform(string_split({bare}[5:] || {bare}[:4], ''), "
             "lambda c: CASE WHEN c >= 'A' THEN cast(ascii(c) - 55 AS varchar) ELSE c END), lambda a, c: "
             "cast(cast(a || c AS bigint) % 97 AS varchar)) AS int) = 1")
    rules = [
        kind(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|contact|write"),
        kind(1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "list_bool_and(list_transform(string_split(m, '.'), lambda p: cast(p AS hugeint) <= 255))", 0.6,
             "ip|address|server|host|login"),
        kind(2, "card", r"[0-9]([\x20-]?[0-9])+", luhn, 0.7, "card|visa|master|credit|payment"),
        kind(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({digits}) BETWEEN 10 AND 15", 0.6,
             "phone|call|tel|mobile|fax"),
        kind(4, "iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", mod97, 0.8,
             "iban|account|bank"),
        kind(5, "ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "true", 0.3, "ssn|social security"),
        kind(6, "secret", "(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?"
             """["'']?[ \\t]{0,3}[=:][ \\t]{0,3}["'']?[A-Za-z0-9+/_-]{16,}={0,2}""",
             "list_entropy(string_split(regexp_extract(m, '[A-Za-z0-9+/_-]{16,}={0,2}$'), '')) >= 3.0", 0.6, "key|login|auth"),
    ]
    cases = " ".join(case for _, case in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({' UNION ALL '.join(sql for sql, _ in rules)}),
put AS (SELECT r, rank, kind, m, score, context, sum(len(g) + coalesce(len(m), 0)) OVER (PARTITION BY r, rank ORDER BY k) AS e
        FROM raw),
ok AS (SELECT r, rank, kind, cast(e - len(m) AS bigint) AS s, cast(e AS bigint) AS e, score, context FROM put
       WHERE m IS NOT NULL AND CASE kind {cases} END),
f AS (SELECT r, rank, kind, s, e FROM ok JOIN d USING (r)
      WHERE rank < 4 OR score + CASE WHEN regexp_matches(lower(
        text[greatest(s - 40, 0) + 1:s] || ' ' || text[e + 1:e + 40]), context) THEN 0.4 ELSE 0.0 END >= 0.5),
g AS (SELECT r, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip,
             count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
             count(*) FILTER (rank = 6) AS n_secret, count(*) AS n_spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_secret, 0) AS n_secret, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN g USING (r)
"""


def _escaped(x: str) -> str:
    return (rf"regexp_replace(regexp_replace(replace(coalesce({x}, ''), '\', '\e'), '<(/?s>)', '\\l\1', 'g'), "
            rf"'\[(/?INST\])', '\\b\1', 'g')")


OP10_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(length({_escaped('role')}) + length({_escaped('text')}) + 19)::bigint AS formatted_chars
FROM c GROUP BY conv_id
"""

OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, size::bigint AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""

ORACLES: dict[str, str] = {
    "op3_warc": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op6_top_k": OP6_SQL,
    "op7_pii": _pii_sql(),
    "op10_chat": OP10_SQL,
}
