"""The thin registered queries of this subpackage: each reads whole tables and applies one operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm.filter_audit import audit_filters
from quillmesh.llm.hdc_language import language_of_documents
from quillmesh.llm.html_trees import extract_pages
from quillmesh.llm.infill import fim_documents
from quillmesh.llm.line_crf import quality_rules
from quillmesh.llm.metric_join import jaccard_components
from quillmesh.llm.packing import pack_power_of_two
from quillmesh.llm.quality_trees import quality_of_documents
from quillmesh.llm.recompression import deduplicated_documents
from quillmesh.llm.sentencepiece_fst import encode_documents
from quillmesh.llm.sharding import shard_documents
from quillmesh.llm.telephony import store_audio
from quillmesh.llm.warc_store import archive_pages
from quillmesh.storage import table


def op1_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op2_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), shards=8)


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_audio(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op5_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_hdc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_of_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op8_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_power_of_two(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_fst": op1_sentencepiece_fst,
    "op2_html_trees": op2_html_trees,
    "op3_stratified_shards": op3_stratified_shards,
    "op4_telephony_audio": op4_telephony_audio,
    "op5_warc_store": op5_warc_store,
    "op6_hdc_language": op6_hdc_language,
    "op7_quality_trees": op7_quality_trees,
    "op8_power_packing": op8_power_packing,
    "op9_line_crf": op9_line_crf,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_recompression": op11_recompression,
    "op12_infill": op12_infill,
    "op13_filter_audit": op13_filter_audit,
}
#: DuckDB SQL where it can express a query: digests and smallest ids of equal payloads; shingle sets joined by their shingles;
#: windows numbered by their words; lists of tokens cut at hashed places; the fate of each document in each order of filters.
ORACLES: dict[str, str] = {
    "op5_warc_store": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM q""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS both_sizes, count(*) AS n FROM items a JOIN items b ON b.x = a.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT a, b FROM shared WHERE 100 * n >= 85 * (both_sizes - n)), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT a AS doc_id, b AS other FROM ways UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(least(s.doc_id, coalesce(r.least_id, s.doc_id)) AS BIGINT) AS component_id FROM sets s LEFT JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id""",
    "op11_recompression": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        wins AS (SELECT doc_id, i AS start, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
        again AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY x ORDER BY doc_id, start) AS n FROM wins) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS i FROM again),
        words AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_infill": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
        h AS (SELECT doc_id, t, w, len(w) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT doc_id, n, form, t, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid, coalesce(array_to_string(w[b + 1:n], ''), '') AS suf FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (SELECT doc_id, part, (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b, (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce((doc_id > min(doc_id) OVER (PARTITION BY t))::INT, 0) AS e FROM d),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        base AS (SELECT part, a, b, c, d, e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p JOIN letters q ON q.x <> p.x JOIN letters r ON r.x NOT IN (p.x, q.x) JOIN letters s ON s.x NOT IN (p.x, q.x, r.x) JOIN letters u ON u.x NOT IN (p.x, q.x, r.x, s.x)),
        fates AS (SELECT part, filter_order, n, good, toxic, a + b + c + d + e AS fails, least(CASE WHEN a = 1 THEN instr(filter_order, 'A') ELSE 6 END, CASE WHEN b = 1 THEN instr(filter_order, 'B') ELSE 6 END, CASE WHEN c = 1 THEN instr(filter_order, 'C') ELSE 6 END, CASE WHEN d = 1 THEN instr(filter_order, 'D') ELSE 6 END, CASE WHEN e = 1 THEN instr(filter_order, 'E') ELSE 6 END) AS gone, a, b, c, d, e FROM base, orders),
        rows AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, n, good, toxic, fails, gone, CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS failed FROM fates, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        counts AS (SELECT part, filter_order, step, filter, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN failed = 1 AND gone < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = 1 AND fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost FROM rows GROUP BY part, filter_order, step, filter)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counts""",
}
