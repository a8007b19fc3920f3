"""The queries of the numbered operators, each over its whole table, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    d = dedup_lines(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_revisits import crawls, header_lines, resolve

    found = resolve(crawls(_table(spark, sf_dir, "pages")))
    return found.select("record_id", "url_key", "refers_to", "status", header_lines("headers").alias("headers"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity_filter import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rotated_codes import search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import bucket_of_id
    from .lm_scoring import score, train

    docs = _table(spark, sf_dir, "documents")
    held_out = bucket_of_id("doc_id", 10) == 0
    return score(docs, train(docs.where(~held_out).select("text")), held_out)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import bucket_of_id
    from .toxicity import learn, score

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return score(docs, learn(docs, labels, bucket_of_id("doc_id", 5) != 0), bucket_of_id("doc_id", 5) == 0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repair

    return repair(damaged(_table(spark, sf_dir, "conversations")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import bucket_of_id
    from .language_id import predict, train

    docs = _table(spark, sf_dir, "documents")
    held_out = bucket_of_id("doc_id", 4) == 2
    return predict(docs, train(docs, ~held_out), held_out)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit, document_masks

    return audit(document_masks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def _step(cost: int, edit: str, states: str) -> str:
    """SQL: the cheapest of the states, each nine digits of cost and then its edits, with one edit more."""
    return f"lpad((substr(least({states}), 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr(least({states}), 10) || '{edit}'"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_line_dedup, op4_simhash, op5_warc_revisits, op6_quality_classifier, op7_rotated_codes, op8_lm_scoring, op9_toxicity, op10_byte_bpe, op11_conversation_repair, op12_language_id, op13_filter_audit)}
SQL: dict[str, str] = {
    "op3_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
            FROM documents
        ), keyed AS (
            SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines
        ), owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
        marked AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS dropped FROM keyed LEFT JOIN owners USING (k))
        SELECT doc_id, count(*) AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op5_warc_revisits": r"""
        WITH parts AS (
            SELECT page_id, html,
                   regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)),
                       '^.*@', ''), ':(80|443)$', ''), '^www\.', '')
                   || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS place,
                   array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                       lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS asked
            FROM pages
        ), keyed AS (
            SELECT page_id, md5(coalesce(html, '')) AS md5, 'day ' || (page_id % 28) AS day,
                   strlen(coalesce(html, '')) AS size, place || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END AS url_key
            FROM parts
        ), responses AS (
            SELECT 8 * page_id + k AS record_id, url_key, (page_id * 7919 + k * 3571) % 10000 AS ts, '"' || md5 || '-' || k || '"' AS tag, day, size
            FROM keyed, (VALUES (0), (1), (2)) t(k)
        ), revisits AS (
            SELECT 8 * page_id + k AS record_id, url_key, (page_id * 104729 + k * 4999) % 10000 AS ts,
                   CASE WHEN NOT (page_id % 5 = 1 AND page_id % 3 = 0) THEN day END AS day,
                   CASE WHEN page_id % 7 = 3 THEN '"changed"' WHEN page_id % 5 <> 1 THEN 'W/"' || md5 || '-' || (page_id % 3) || '"' END AS sent
            FROM keyed, (VALUES (3), (4)) t(k)
        ), latest AS (
            SELECT url_key, ts, max(record_id) AS held FROM responses GROUP BY url_key, ts
        ), as_of AS (
            SELECT r.*, l.held FROM revisits r ASOF LEFT JOIN latest l ON r.url_key = l.url_key AND r.ts > l.ts
        ), met AS (
            SELECT r.*, k.tag, k.day AS old_day, k.size,
                   CASE WHEN k.record_id IS NULL THEN 'missing'
                        WHEN r.sent IS NOT NULL THEN CASE WHEN regexp_replace(r.sent, '^W/', '') = k.tag THEN 'merged' ELSE 'mismatch' END
                        WHEN r.day IS NOT NULL THEN CASE WHEN r.day = k.day THEN 'merged' ELSE 'mismatch' END
                        ELSE 'unchecked' END AS status
            FROM as_of r LEFT JOIN responses k ON k.record_id = r.held
        )
        SELECT record_id, url_key, held AS refers_to, status,
               CASE WHEN status = 'merged'
                    THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
                         || 'etag: ' || coalesce(sent, tag) || chr(10) || 'last-modified: ' || coalesce(day, old_day)
                    ELSE 'cache-control: max-age=120' || chr(10) || 'content-length: 0'
                         || coalesce(chr(10) || 'etag: ' || sent, '') || coalesce(chr(10) || 'last-modified: ' || day, '') END AS headers
        FROM met""",
    "op11_conversation_repair": rf"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
            FROM conversations
        ), dealt AS (
            SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''),
                       lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS kind
            FROM keyed
        ), rows AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM dealt, generate_series(1, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
        ), placed AS (
            SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows)
        ), marked AS (
            SELECT *, left(role, 1) AS r,
                   CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
            FROM placed
        ), counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
            FROM marked GROUP BY conv_id
        ), layers AS (
            SELECT conv_id, n, 0 AS i, '000000000' AS s0, NULL::VARCHAR AS s1, '000000003I' AS s2, '000000006II' AS s3 FROM counted
            UNION ALL
            SELECT conv_id, n, i, s0, s1, m2, least(m3, {_step(3, "I", "m2, NULL")}) FROM (
                SELECT conv_id, n, i, n0 AS s0, n1 AS s1, least(n2, {_step(3, "I", "n0, n1, n3")}) AS m2, n3 AS m3 FROM (
                    SELECT l.conv_id, l.n, m.i,
                           {_step(4, "D", "s0, NULL")} AS n0,
                           least({_step(4, "D", "s1, NULL")}, CASE WHEN r = 's' AND fault NOT IN ('b', 'd') THEN
                               CASE WHEN fault = 't' THEN {_step(3, "K", "s0, NULL")} ELSE {_step(0, "K", "s0, NULL")} END END) AS n1,
                           least({_step(4, "D", "s2, NULL")}, CASE WHEN fault NOT IN ('b', 'd') THEN least(
                               CASE WHEN fault = 't' THEN {_step(6, "R", "s0, s1, s3")} ELSE {_step(3, "R", "s0, s1, s3")} END,
                               CASE WHEN r = 'u' THEN CASE WHEN fault = 't' THEN {_step(3, "K", "s0, s1, s3")} ELSE {_step(0, "K", "s0, s1, s3")} END END) END) AS n2,
                           least({_step(4, "D", "s3, NULL")}, CASE WHEN fault NOT IN ('b', 'd') THEN least(
                               CASE WHEN fault = 't' THEN {_step(6, "R", "s2, NULL")} ELSE {_step(3, "R", "s2, NULL")} END,
                               CASE WHEN r = 'a' THEN CASE WHEN fault = 't' THEN {_step(3, "K", "s2, NULL")} ELSE {_step(0, "K", "s2, NULL")} END END) END) AS n3
                    FROM layers l JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i + 1))
        ), settled AS (SELECT conv_id, least(s0, s3) AS best FROM layers WHERE i = n),
        edits AS (
            SELECT conv_id, k, substr(best, 9 + k, 1) AS edit,
                   len(replace(substr(best, 10, k), 'I', '')) AS i, len(replace(substr(best, 10, k), 'D', '')) AS made
            FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS k FROM settled)
        ), led AS (
            SELECT e.*, m.role, m.text, CASE WHEN edit = 'K' AND made = 1 AND m.r = 's' THEN 1 ELSE 0 END AS leads
            FROM edits e LEFT JOIN marked m ON edit <> 'I' AND m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.i = e.i
            WHERE edit <> 'D'
        ), lines AS (
            SELECT conv_id, k, CASE WHEN edit = 'K' THEN role WHEN (made - max(leads) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                   || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
            FROM led
        ), texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS repaired FROM lines GROUP BY conv_id),
        every AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(substr(best, 1, 9), '0')::BIGINT AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM every e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
             LEFT JOIN settled s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), owners AS (SELECT t, min(doc_id) AS owner FROM d GROUP BY t), masks AS (
            SELECT part,
                   CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
                   | CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                   | CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
                   | CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                   | CASE WHEN doc_id > owner THEN 16 ELSE 0 END AS mask,
                   doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
                   doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
            FROM d JOIN owners USING (t)
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
                 JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
        ), steps AS (
            SELECT filter_order, step::INT AS step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
                   list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65)))::BIGINT AS before
            FROM orders, generate_series(1, 5) g(step)
        ), cells AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM masks GROUP BY ALL
        ), met AS (
            SELECT part, filter_order, step, bit,
                   coalesce(sum(n) FILTER ((mask & (bit | coalesce(before, 0))) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) = 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) <> 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n_good) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) = 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(n_toxic) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) = 0), 0)::BIGINT AS toxic_lost
            FROM cells, steps GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM met""",
}
