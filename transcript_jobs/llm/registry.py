"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transcript_jobs.llm import (
    fill_in_middle,
    hard_negatives,
    html_text,
    merkle,
    mixing,
    near_dups,
    packing,
    preferences,
    quality_model,
    quality_rules,
    sharding,
    token_files,
    toxicity,
)
from transcript_jobs.llm.common import table

_MODULES = {
    "op1_packing": packing,
    "op2_near_dups": near_dups,
    "op3_html_text": html_text,
    "op4_preferences": preferences,
    "op5_toxicity": toxicity,
    "op6_sharding": sharding,
    "op7_merkle": merkle,
    "op8_mixing": mixing,
    "op9_quality_model": quality_model,
    "op10_quality_rules": quality_rules,
    "op11_hard_negatives": hard_negatives,
    "op12_fill_in_middle": fill_in_middle,
    "op13_token_files": token_files,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def fixed_capacity_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few shards of 4 MB as best fit decreasing finds."""
    return sharding.pack_capacity(table(spark, sf_dir, "documents"), 4 << 20)


#: Further results of the operators: name -> (query, SQL or None).
_MORE = {
    "preference_turns": (preferences.turns, preferences.TURNS_SQL),
    "quality_rule_ablation": (quality_rules.ablation_query, quality_rules.ABLATION_SQL),
    "fixed_capacity_shards": (fixed_capacity_shards, None),
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()} | {"pipeline": pipeline} | {name: q for name, (q, _) in _MORE.items()}


def oracle_sql() -> dict:
    return {name: m.SQL for name, m in _MODULES.items() if m.SQL} | {name: sql for name, (_, sql) in _MORE.items() if sql}
