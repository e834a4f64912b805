"""One query per operator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    fill_in_middle, filter_audit, host_rules, license_scan, mixing, packing, pii_crf, positive_unlabelled, simhash_balls,
    site_style_tree, substring_dedup, token_counts, weighted_sampling)
from tidemark.llm.common import table

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.compared(table(spark, sf_dir, "documents"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.spans(table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judged(table(spark, sf_dir, "documents"))
    m = F.col(out.columns[-1])
    return out.select(
        "doc_id", *[m[x].alias(x) for x in host_rules.MEASURES if x != "n_lines"],
        m["base_failed"].alias("base_failed"), m["kept"].alias("kept"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).drop("copies")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_balls.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents")).drop("found")


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_style_tree.extracted(table(spark, sf_dir, "pages"))
    text, n_chars = out.columns[-2:]
    return out.select("page_id", "url", F.col(text).alias("text"), F.col(n_chars).alias("n_chars"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positive_unlabelled.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transformed(table(spark, sf_dir, "documents"))
    f = F.col(out.columns[-1])
    return out.select(
        "doc_id", *[f[x].alias(x) for x in fill_in_middle.FIELDS if x != "output"],
        F.sha2(f["output"], 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(f["output"], f["form"]), 256).alias("restored_sha256"))
