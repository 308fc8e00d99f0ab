"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

# All at once: where a dependency of one is missing, the whole subpackage is, and the entry leaves it out.
from tessella.llm import alignment, bpe, divergence, jaccard, licenses, neighbours, packing, pii, quality, secrets, substring, suffixes, trie

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
    "op5_pii": pii.op5_pii,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_packing": packing.op10_packing,
    "op11_alignment": alignment.op11_alignment,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_trie_bpe": trie.op13_trie_bpe,
}
_SQL = {"op3_substring_dedup": substring.SQL, "op6_suffix_dedup": suffixes.SQL, "op8_quality_rules": quality.SQL, "op12_source_divergence": divergence.SQL}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return _QUERIES | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
