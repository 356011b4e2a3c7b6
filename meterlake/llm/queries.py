"""The registered queries of this package, over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, jaccard, kneser_ney, langid, lines, oracles, packing, periodic, quality, spelling, substring, token_files, toxicity, url_cascade

DOCS = "documents"
NGRAM_ORDER = 3  # two words of context


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, DOCS), _read(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_read(spark, sf_dir, DOCS))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(_read(spark, sf_dir, DOCS))


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_cascade.judge_urls(pages, url_cascade.keys_with_labels(pages))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, DOCS), _read(spark, sf_dir, "benchmark")).drop("text_key")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, DOCS))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_read(spark, sf_dir, DOCS))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, DOCS), _read(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(_read(spark, sf_dir, DOCS))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.perplexity_scores(_read(spark, sf_dir, DOCS), order=NGRAM_ORDER)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(_read(spark, sf_dir, DOCS))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(_read(spark, sf_dir, DOCS))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_read(spark, sf_dir, DOCS))


_ALL = (op1_quality_rules, op2_substring_dedup, op3_token_files, op4_url_cascade, op5_decontaminate, op6_pack, op7_language_id, op8_toxicity, op9_jaccard_join, op10_kneser_ney, op11_periodic_runs, op12_spelling_variants, op13_line_dedup)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING,
    "op4_url_cascade": oracles.URLS,
    "op5_decontaminate": oracles.CONTAMINATION,
    "op9_jaccard_join": oracles.JACCARD,
    "op11_periodic_runs": oracles.RUNS,
    "op12_spelling_variants": oracles.VARIANTS,
    "op13_line_dedup": oracles.LINES,
}
