"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``. A stage drops what its operator rejects and
keeps all else as it is; rows with a null id or text pass every filter. Repeated rows (same id and text) are judged alike:
both go or both stay, in near_dup too, which compares texts of different rows by their ids. An empty table gives an empty table of the same columns.

A stage carries a row's columns through its operator in one structure, so that none can clash with what the operator adds, whatever it is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.llm.common import Scratch, table
from strandset.llm.decontaminate import contamination, judged
from strandset.llm.near_dup import near_duplicates
from strandset.llm.packing import pack
from strandset.llm.repeats import without_repeats
from strandset.llm.toxicity import fit
from strandset.llm.toxicity import toxicity as scored


ROW = "__row"


def _carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ROW): all columns of a row in ROW beside those that operators read."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(_carried(docs), model, keep=(ROW,)).where("predicted = 0").select(f"{ROW}.*")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated passages; n_chars follows where it is given."""
    clean = without_repeats(_carried(docs), keep=(ROW,))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return clean.select(*[new.get(c, F.col(ROW)[c]).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of test items."""
    found = judged(contamination(_carried(docs), table(spark, sf_dir, "benchmark"), keep=(ROW,)))
    return found.where("not contaminated").select(f"{ROW}.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4,096 ids."""
    return pack(docs, ids=True)


STAGES = [("toxicity", toxicity), ("near_dup", near_dup), ("repeats", repeats), ("decontaminate", decontaminate), ("packing", packing)]

#: The first stage applies a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
