"""A training corpus from raw documents: five stages over one table.

Each stage works on all rows that the one before it kept, and its decisions take effect:
texts that the quality rules reject go, one document of each group of near copies stays,
passages that occur elsewhere are cut out, secrets are blanked, and what is left is packed.
All but the last return the columns of documents.

Null and empty texts fail the quality rules and go; repeated rows are copies of each other, of which
one stays; ties between copies go to the smaller doc_id; very long texts are worked on whole. Further
columns are kept, whatever their names, up to the last stage. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import common, jaccard, packing, quality, secrets, substring

STAGES = [
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("substring dedup", substring.stage),
    ("secret scans", secrets.stage),
    ("packing", packing.stage),
]

#: Tokenising has no SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's rows are written as Parquet in the shared folder and read again.

    What a stage has written on its way goes with the rows it began with, once its own are written.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with common.spent(spark):
            docs = common.materialise(stage(spark, docs, sf_dir))
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
