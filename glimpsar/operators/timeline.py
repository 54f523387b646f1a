"""The answer as a timeline: ordering, gaps, last sighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.media import days_between, span_text

#: A gap is drawn if the object was out of sight for longer than this.
GAP_DAYS = 21


def ordered(key: str, *ties: str):
    """Oldest first; undated sightings come last, and ties keep the given order."""
    return Window.partitionBy(key).orderBy(F.col("taken_at").asc_nulls_last(), *ties)


def last_seen(matches: DataFrame, key: str = "object_id", tie: str = "photo_id") -> DataFrame:
    """The latest dated sighting, the first in order among equals; without any date the last of the timeline."""
    rank = Window.partitionBy(key).orderBy(
        F.col("taken_at").desc_nulls_last(),
        F.when(F.col("taken_at").isNotNull(), F.col(tie)).asc_nulls_last(),
        F.col(tie).desc(),
    )
    return matches.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")


def with_gaps(matches: DataFrame, key: str = "object_id", tie: str = "photo_id") -> DataFrame:
    """Days since the sighting before (0 if either is undated), whether and how long the gap is drawn, and its text."""
    before = F.lag("taken_at").over(ordered(key, tie))
    days = F.coalesce(days_between(F.col("taken_at"), before), F.lit(0.0))
    df = matches.withColumn("days", days)
    drawn = F.col("days") > GAP_DAYS
    height = F.least(F.lit(72.0), 14 + (F.log2(F.when(drawn, F.col("days"))) - 4.4) * 12)
    return df.withColumn("gap_px", F.when(drawn, height)).withColumn("gap_text", F.when(drawn, span_text(F.col("days"))))


def with_year_breaks(matches: DataFrame, key: str = "object_id", tie: str = "photo_id") -> DataFrame:
    """Marks dated sightings whose year differs from the sighting before, or that follow none or an undated one."""
    before = F.year(F.lag("taken_at").over(ordered(key, tie)))
    year = F.year("taken_at")
    return matches.withColumn("year", year).withColumn("new_year", year.isNotNull() & (before.isNull() | (before != year)))


def summary(matches: DataFrame, key: str = "object_id") -> DataFrame:
    out = matches.groupBy(key).agg(F.count(F.lit(1)).alias("sightings"), F.min("taken_at").alias("first"), F.max("taken_at").alias("last"), F.count("taken_at").alias("dated"))
    return out.select(key, "sightings", "first", "last", F.when(F.col("dated") > 1, days_between(F.col("last"), F.col("first"))).otherwise(0.0).alias("arc_days"))


def several_text(most: Column, first: Column, photos: Column) -> Column:
    """A sentence for an object that is in one photo more than once."""
    others = F.when(photos > 1, F.concat(F.lit(", and more than once in "), (photos - 1).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("Seen "), most.cast("string"), F.lit(" times in "), first, others, F.lit(": the matches need not be one and the same thing."))
