"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import byte_bpe, decontaminate, license_scan, line_dedup, near_dedup, pii, quality_gam, quality_rules, sharding, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated"
    )


def proximity_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which the words of a benchmark window lie close together in any order."""
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    found = decontaminate.proximity_matches(index, table(spark, sf_dir, "benchmark"))
    return found.where("n_hit > 0").select("doc_id", "n_words", "n_hit", F.array_join(F.array_sort("items"), ",").alias("items"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).drop("ids")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_dedup.line_report(table(spark, sf_dir, "documents"))
    numbers = [F.size(c).cast("long").alias(f"n_{c}") for c in ("exact", "near")]
    return report.select("doc_id", "n_lines", *numbers, *(F.concat_ws(",", F.col(c).cast("array<string>")).alias(f"{c}_lines") for c in ("exact", "near")))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shards_by_bytes(table(spark, sf_dir, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    counts = map(count, ("email", "ip", "card", "phone"))
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_order_minhash": op4_order_minhash,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_histogram_shards": op7_histogram_shards,
    "op8_url_filter": op8_url_filter,
    "op9_pii": op9_pii,
    "op10_quality_gam": op10_quality_gam,
    "proximity_passages": proximity_passages,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    i AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 13 THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda k: w[k:k + 12]) END) AS win FROM b),
    n AS (SELECT DISTINCT len(win) AS n FROM i), c AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n),
    h AS (SELECT doc_id, item_id, s, n FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM c) JOIN (SELECT item_id, array_to_string(win, ' ') AS k FROM i) USING (k)),
    p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM h) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(found, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
