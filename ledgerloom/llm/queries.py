"""The queries opN_<name>: each operator on its whole table, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, hash_forest, html_text, infill, lattice_lm, media, near_dedup, packing, pii, quality, secrets, url_templates, whitening
from ledgerloom.session import load


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(load(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(load(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(load(spark, sf_dir, "documents"))


def op7_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(load(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(load(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(load(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


#: Host, path and verdict of the rules that every url is held against.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(load(spark, sf_dir, "pages"), URL_RULES)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_html_text": op2_html_text,
    "op3_lattice_lm": op3_lattice_lm,
    "op4_secrets": op4_secrets,
    "op6_packing": op6_packing,
    "op5_media": op5_media,
    "op7_hash_forest": op7_hash_forest,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_pii": op10_pii,
    "op11_infill": op11_infill,
    "op12_whitening": op12_whitening,
    "op13_url_templates": op13_url_templates,
}
_ORACLES: dict[str, str] = {"op11_infill": infill.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
