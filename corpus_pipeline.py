"""A corpus-cleaning pipeline: the stages of STAGES applied in order to `documents`.

Every stage works on all that its predecessor kept, and all but the last return the columns of `documents`; n_chars
follows the text. Language ID drops documents without a letter or whose language is uncertain; line dedup removes
repeated lines and drops a document only if nothing but repeated lines was in it; near-dedup keeps the first document of
each group of documents linked by a Jaccard similarity of NEAR percent; decontamination drops documents that hold
benchmark passages; packing gives the pieces and their places.

Verdicts fall on rows. Language ID and decontamination judge each row by its text alone, whatever its doc_id, a null one
too. Near-dedup tells rows apart that have no doc_id or share one: they come in order of doc_id (null last) and of a
digest of their texts, and one of equal rows stays. Line dedup leaves rows without a doc_id as they are. Ties go to the
smallest doc_id. An empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from emberlog.llm import shared as S

#: Least calibrated probability of the predicted language.
LANGUAGE_SCORE = 0.3
#: Least Jaccard similarity, in percent, of near copies by word shingles; op2's own contract is 85.
NEAR = 80


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs), LANGUAGE_SCORE)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & (F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")) == "")
    out = out.filter(~F.coalesce(emptied, F.lit(False)))
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.first_of_each(docs, NEAR)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, S.read(spark, sf_dir, "benchmark"))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", stage_language),
    ("line_dedup", stage_lines),
    ("near_dedup", stage_near),
    ("decontaminate", stage_decontaminate),
    ("pack", stage_pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on `documents`; what each stage keeps is written as a table in the shared folder."""
    docs = S.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = S.table(docs)
    return docs
