"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chat, decontam, langid, licenses, mixing, repeats, simhash, token_output, topk, warc
from quillspark.llm.shared import table


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digests(table(spark, sf_dir, "documents"))


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rendered(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "part_no", "n_parts", "n_turns", "copies", "n_rendered", F.sha2("text", 256).alias("text_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"), licenses.ALL)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolved(warc.page_records(table(spark, sf_dir, "pages")), canonical=warc.crawl_url)
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.select("record_id", "canonical", F.unix_seconds("captured").alias("captured_s"), "base_id", "verdict", F.array_join(lines, "\n").alias("headers"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_tokens,
        op2_chat_snapshots,
        op3_decontaminate,
        op4_topk,
        op5_licenses,
        op6_simhash,
        op7_revisits,
        op8_language,
        op9_mix,
        op10_repeats,
    )
}

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_REST = "regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '')"
_ASKED = f"regexp_replace(regexp_replace(regexp_extract({_REST}, '[?](.*)$', 1), '(^|&)({warc.TRACKING})=[^&]*', '', 'g'), '^&', '')"

_safe = lambda c: f"replace(replace(coalesce({c}, ''), '{chat.START}', '<\\{chat.START[1:]}'), '{chat.END}', '<\\{chat.END[1:]}')"

ORACLE_SQL: dict[str, str] = {
    "op2_chat_snapshots": f"""
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        c AS (SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS l,
                     string_agg('{chat.START}' || {_safe("role")} || chr(10) || {_safe("text")} || '{chat.END}' || chr(10), '' ORDER BY turn, role, text) AS body
              FROM t GROUP BY conv_id),
        k AS (SELECT min(conv_id) AS conv_id, n, l, body, count(*) AS copies FROM c GROUP BY n, l, body)
        SELECT conv_id, 0 AS part_no, 1 AS n_parts, n AS n_turns, copies, n AS n_rendered, sha256(body) AS text_sha256
        FROM k AS a WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.n > a.n AND b.l[1:a.n] = a.l)
    """,
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, w[k:k + 9] AS win, len(w[k:k + 9]) AS n FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(k) WHERE len(w) > 0),
        pos AS (SELECT doc_id, k, n, w[k:k + n - 1] AS win FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS r(k)),
        hit AS (SELECT doc_id, k, pos.n AS n, item_id FROM pos JOIN win ON pos.win = win.win),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
    """,
    "op7_revisits": f"""
        WITH u AS (SELECT page_id AS id, substr(sha256(coalesce(html, '')), 1, 16) AS tag, strlen(html) AS size,
                          regexp_replace(lower(regexp_extract({_REST}, '^[^/?]*', 0)), '^(www|m)[.]|:(80|443)$', '', 'g')
                          || regexp_replace(regexp_extract({_REST}, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN {_ASKED} <> '' THEN '?' || {_ASKED} ELSE '' END AS canonical
                   FROM pages),
        v AS (SELECT *, CASE WHEN id % 7 = 0 THEN '' WHEN id % 3 = 0 THEN '"' || tag || '"' WHEN id % 3 = 2 THEN 'W/"' || tag || CASE WHEN id % 5 = 0 THEN 'x' ELSE '' END || '"' ELSE '' END AS etag,
                     CASE WHEN id % 7 <> 0 AND id % 3 = 1 THEN 'second ' || CAST(id AS VARCHAR) ELSE '' END AS modified FROM u),
        m AS (SELECT r.id AS id, max(b.id) AS base FROM v AS r JOIN u AS b ON r.canonical = b.canonical AND b.id < r.id + 1800 GROUP BY r.id),
        j AS (SELECT v.*, base, b.tag AS b_tag, b.size AS b_size,
                     CASE WHEN base IS NULL THEN 'no_response' WHEN etag = '' AND modified = '' THEN 'no_validator'
                          WHEN etag <> '' AND regexp_replace(etag, '^W/', '') = '"' || b.tag || '"' THEN 'resolved' WHEN etag = '' AND modified = 'second ' || CAST(base AS VARCHAR) THEN 'resolved' ELSE 'mismatch' END AS verdict
              FROM v LEFT JOIN m ON v.id = m.id LEFT JOIN u AS b ON b.id = base)
        SELECT 2 * id + 1 AS record_id, canonical, id + 1800 AS captured_s, CASE WHEN verdict = 'resolved' THEN 2 * base END AS base_id, verdict,
               CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || CAST(b_size AS VARCHAR) || chr(10) || 'content-type: text/html' || chr(10) || 'date: second ' || CAST(id + 1800 AS VARCHAR)
                    || chr(10) || 'etag: ' || CASE WHEN etag <> '' THEN etag ELSE '"' || b_tag || '"' END || chr(10) || 'last-modified: ' || CASE WHEN modified <> '' THEN modified ELSE 'second ' || CAST(base AS VARCHAR) END END AS headers
        FROM j
    """,
    "op4_topk": """
        WITH v AS (
          SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
          FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        ), s AS (
          SELECT a.row AS row, a.vec_id AS query_id, b.vec_id AS vec_id,
                 CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM s)
        WHERE place <= 5
    """,
}
