"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.bpe import decode_documents, encode_documents
from skyloom.llm.common import read_table
from skyloom.llm.exact_dedup import exact_dedup
from skyloom.llm.importance import resample
from skyloom.llm.language_model import lm_scores
from skyloom.llm.license_scan import scan_licenses
from skyloom.llm.manifest import lowered, merkle_manifest
from skyloom.llm.mixing import mix_sources
from skyloom.llm.near_dedup import near_duplicates
from skyloom.llm.packing import pack_documents
from skyloom.llm.pii import KINDS, find_pii, span_text
from skyloom.llm.quality_rules import quality_rules
from skyloom.llm.runs import find_runs, with_repeats
from skyloom.llm.url_filter import judge_urls, rule_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), rule_table(spark))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    # a second parameter of the function, even one with a default, would be the position
    of_kind = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select(*columns)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    coded = decode_documents(encode_documents(read_table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_repeats(read_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = found.select("doc_id", "n_words", "runs", longest.alias("top"), listed.alias("listed"), "collapsed")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle_manifest(read_table(spark, sf_dir, "documents"), lowered(F.col("text")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_license_scan": op3_license_scan,
    "op4_url_filter": op4_url_filter,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pii": op7_pii,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_mixing": op13_source_mixing,
}

#: DuckDB has no CRC-32: the checksum of doc_id as text, a bit at a time.
CHECKSUM = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(doc_id::VARCHAR)),
            lambda k: CASE WHEN k % 8 = 0 THEN unicode(substr(doc_id::VARCHAR, (k // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0::BIGINT END)),
            lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"""
LOWER_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_OF_TEXT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op4_url_filter": """
        WITH p AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        m AS (
            SELECT page_id, host, path, r.h || r.p AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC, r.h || r.p DESC) AS n
            FROM p LEFT JOIN r ON (host = r.h OR host LIKE '%.' || r.h) AND starts_with(path, r.p))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1""",
    "op11_periodic_runs": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_OF_TEXT} AS w, {CHECKSUM} AS h FROM documents),
        e AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM d),
        f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
        t AS (
            SELECT r, doc_id, n,
                   CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) ELSE w END AS w
            FROM f),
        x AS (SELECT r, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM t),
        pairs AS (SELECT a.r, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
        islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
        stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY r, q, island),
        runs AS (SELECT r, s, l, min(q) AS q FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY r, s, l),
        dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
        kept AS (SELECT x.r, string_agg(x.word, ' ' ORDER BY x.i) AS words FROM x ANTI JOIN dropped USING (r, i) GROUP BY x.r),
        listed AS (
            SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listing,
                   first({{'s': s, 'l': l, 'q': q}} ORDER BY l DESC, s, q) AS top
            FROM runs GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
               sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
        FROM t LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE
        d AS MATERIALIZED (
            SELECT doc_id, lang, {leaf_sql("text")} AS leaf,
                   CASE WHEN {CHECKSUM} % 3 = 0 THEN {leaf_sql(LOWER_TEXT)} ELSE {leaf_sql("text")} END AS claim
            FROM documents),
        leaves AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS w FROM d),
        up AS (
            SELECT lang, 0 AS level, i, w, leaf AS h FROM leaves
            UNION ALL
            SELECT lang, level + 1, i // 8, (w + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE w > 1 GROUP BY lang, level, i // 8, w),
        subroots AS MATERIALIZED (
            SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS w FROM up WHERE w = 1),
        top AS (
            SELECT 0 AS level, i, w, subroot AS h FROM subroots
            UNION ALL
            SELECT level + 1, i // 8, (w + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE w > 1 GROUP BY level, i // 8, w),
        sides AS MATERIALIZED (
            SELECT false AS top, lang, level, i, h, w, string_agg(h, '' ORDER BY i) OVER (PARTITION BY lang, level, i // 8) AS run,
                   64 * (i % 8) AS at FROM up WHERE w > 1
            UNION ALL
            SELECT true, NULL, level, i, h, w, string_agg(h, '' ORDER BY i) OVER (PARTITION BY level, i // 8), 64 * (i % 8) FROM top WHERE w > 1),
        siblings AS MATERIALIZED (
            SELECT s.top, s.lang, s.level, s.i, s.w, s.at, x.run[1:s.at] AS before, x.run[s.at + 65:] AS after
            FROM sides s JOIN (SELECT top, lang, level, i // 8 AS k, max_by(run, length(run)) AS run FROM sides GROUP BY ALL) x
              ON s.top = x.top AND s.lang IS NOT DISTINCT FROM x.lang AND s.level = x.level AND s.i // 8 = x.k),
        inner_climb AS (
            SELECT doc_id, lang, leaf, i AS own, 0 AS level, i, w, claim AS h, '' AS proof FROM leaves
            UNION ALL
            SELECT c.doc_id, c.lang, c.leaf, c.own, c.level + 1, c.i // 8, (c.w + 7) // 8, sha256(s.before || c.h || s.after), c.proof || s.before || s.after
            FROM inner_climb c JOIN siblings s ON NOT s.top AND c.lang IS NOT DISTINCT FROM s.lang AND c.level = s.level AND c.i = s.i WHERE c.w > 1),
        outer_climb AS (
            SELECT c.doc_id, c.leaf, c.lang, u.subroot, 0 AS level, u.i, u.w, c.h, c.proof
            FROM inner_climb c JOIN subroots u ON c.lang IS NOT DISTINCT FROM u.lang WHERE c.w = 1
            UNION ALL
            SELECT c.doc_id, c.leaf, c.lang, c.subroot, c.level + 1, c.i // 8, (c.w + 7) // 8, sha256(s.before || c.h || s.after), c.proof || s.before || s.after
            FROM outer_climb c JOIN siblings s ON s.top AND c.level = s.level AND c.i = s.i WHERE c.w > 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM outer_climb, (SELECT h AS root FROM top WHERE w = 1) WHERE w = 1""",
    "op13_source_mixing": f"""
        WITH d AS (
            SELECT doc_id, source, len({WORDS_OF_TEXT})::BIGINT AS size, sha256('13:' || coalesce(doc_id::VARCHAR, '-'))[1:16] AS key FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM d GROUP BY source),
        c AS (
            SELECT sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS words,
                   sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free
            FROM s WINDOW before AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
            SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * (SELECT max(words::DOUBLE / free) FROM c)) AS target FROM s),
        b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, coalesce(floor(target + 0.5)::BIGINT // nullif(source_size, 0), 0) AS epochs FROM t),
        p AS (
            SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
        SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS taken, p.source
        FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source""",
}
