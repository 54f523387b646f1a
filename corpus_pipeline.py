"""The corpus pipeline: toxic documents go, repeated lines go, one of each near-duplicate group stays,
contaminated documents go, and what is left is encoded.

Each stage is a function of (spark, docs, sf_dir); the result of one, written as Parquet and read
again, is the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimpsar.llm import bpe, decontaminate, line_dedup, near_duplicates, toxicity
from glimpsar.llm.common import col, fresh, small_or_hashed, stored

_LONG = 1 << 63


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a toxicity score below 0.5.

    Every row is judged by its own text, also without an id or with one that others have.  Null and empty texts
    stay.  Other columns pass, whatever their names.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, clauses = fresh(docs.columns, "score", "clauses")
    scored = toxicity.with_scores(docs, model, names=(score, clauses))
    return scored.where(col(score) < 0.5).select(*map(col, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; ``n_chars`` follows the text.

    Rows that share an id are one document, and those without an id the last one.  Null texts become empty ones.  Other
    columns pass, whatever their names.
    """
    kept = line_dedup.dedup_lines(docs, counts=tuple(fresh(docs.columns, "n_lines", "n_dropped"))).select(*map(col, docs.columns))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def _own_ids(docs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``docs`` and a number ``name`` for each: its id, if no other row has that.  Also whether that holds for all.

    Rows without an id or with a repeated one get numbers beyond all ids (below, if there is no room), made of their
    id and text, so that rows which repeat both share one.
    """
    counted = docs.select(col("doc_id").cast("long").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    low, high, odd = counted.agg(F.min("id"), F.max("id"), F.count_if((F.col("n") > 1) | F.col("id").isNull())).first()
    if not odd:
        return docs.withColumn(name, col("doc_id").cast("long")), True
    low, high = (0, 0) if high is None else (low, high)
    above, below = _LONG - 1 - high, low + _LONG
    room, start = (above, high + 1) if above >= min(below, 1 << 62) else (below, -_LONG)
    made = F.lit(start) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(min(room, 1 << 62)))
    [repeated] = fresh([*docs.columns, name], "repeated")
    several = small_or_hashed(stored(counted.where("n > 1 and id is not null").select(F.col("id").alias(repeated)), "pipeline-repeated"), 16)
    joined = docs.join(several, col("doc_id").cast("long") == col(repeated), "left")
    return joined.withColumn(name, F.when(col("doc_id").isNull() | col(repeated).isNotNull(), made).otherwise(col("doc_id").cast("long"))).drop(col(repeated)), False


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each near-duplicate group.

    Rows without an id, or with one that others have, come after all others, and of rows that repeat id and text one
    stays.  Null and empty texts are copies of each other.  Other columns pass, whatever their names.
    """
    number, gone = fresh(docs.columns, "number", "gone")
    own, alone = _own_ids(docs, number)
    found = near_duplicates.near_duplicates(own, id_col=number)
    others = small_or_hashed(stored(found.where("doc_id <> class_id").select(F.col("doc_id").alias(gone)), "pipeline-gone"), 16)
    kept = own.join(others, col(number) == col(gone), "left_anti")
    return (kept if alone else _once(kept, number)).select(*map(col, docs.columns))


def _once(docs: DataFrame, number: str) -> DataFrame:
    """One row of each number.  Rows that share one are few, so all others stay where they are."""
    [repeated] = fresh(docs.columns, "repeated")
    several = stored(docs.groupBy(col(number)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(col(number).alias(repeated)), "pipeline-several")
    small = small_or_hashed(several, 16)
    same = col(number) == col(repeated)
    return docs.join(small, same, "left_anti").unionByName(docs.join(small, same, "left_semi").dropDuplicates([number]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose text no twentieth part is benchmark passages.

    Every row is judged by its own text, also without an id or with one that others have.  Null and empty texts
    stay.  Other columns pass, whatever their names.
    """
    names = fresh(docs.columns, "n_words", "n_hit", "items", "spans")
    found = decontaminate.with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names=tuple(names))
    return found.where(~decontaminate.contaminated(*names[:2])).select(*map(col, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Neither learned scores nor byte pair encoding can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
