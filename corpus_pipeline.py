"""A corpus pipeline over `documents`: language, exact copies, near copies, benchmark passages, packing.

Every stage takes any table with the columns doc_id, text, lang and source. Columns may be null, ids and rows may
repeat; decisions are made for rows, not for ids. All stages but the last return the columns they are given, extra
ones and those of any name included. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetwright.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixture_pack
from fleetwright.llm.common import ROW_GROUP_BYTES, new_folder
from fleetwright.llm.queries import TOKENIZER, table
from fleetwright.llm.tokens import public_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null and empty ones included; all rows stay where no row names a language."""
    return language_id.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space the one of the least id stays; a null text is empty."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the one of the least id stays, one without an id only if there is no other; all wordless rows stay."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose text holds ten words of a benchmark item in a row; a null text holds none."""
    return decontaminate.drop_contaminated_rows(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in full sequences; a null text is its end token alone, a null source one of its own."""
    return mixture_pack.pack(docs, public_path(TOKENIZER), end_id=2)


STAGES = [
    ("1 language", keep_known_languages),
    ("3 exact dedup", drop_exact_copies),
    ("6 near copies", drop_near_copies),
    ("10 benchmark decontamination", drop_contaminated),
    ("8 packing", pack),
]

# Language identification and tokenizing cannot be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; returns the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        docs = spark.read.parquet(path)
    return docs
