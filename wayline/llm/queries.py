"""Named queries over the corpus operators and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import (bestfit_packing, bpe_automaton, crf_quality, exact_topk, license_scan, log_templates, ngram_jaccard, periodic_runs, pii_bootstrap, ranked_scan,
                         token_counts, url_rules, vp_search)
from wayline.llm.common import table


#: Recall against brute force is 1.0 on embeddings of 64 components, and 0.99 at 6.
VP_FACTOR = 4.0


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.search(table(spark, sf_dir, "embeddings"), factor=VP_FACTOR)


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.find(table(spark, sf_dir, "documents"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_automaton.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bestfit_packing.pack(docs, near=bestfit_packing.near_copies(docs))


def op6_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_quality.score(docs, crf_quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_templates.dedup(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op13_ranked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_scan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_vp_search, op3_pii_bootstrap, op4_bpe_automaton, op5_bestfit_packing, op6_crf_quality,
                                 op7_log_templates, op8_exact_topk, op9_url_rules, op10_ngram_jaccard, op11_token_counts, op12_periodic_runs, op13_ranked_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op7_log_templates": log_templates.oracle(), "op8_exact_topk": exact_topk.oracle(),
            "op9_url_rules": url_rules.oracle(), "op13_ranked_scan": ranked_scan.oracle()}
