"""How good the answers are: precision at k, gate sweeps, accept rates, recall against known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.gate import accept, inlier_fraction

# The grids of the sweep and the cut-offs of precision at k.
THRESHOLDS = (4, 5, 6, 8, 10, 12, 15, 20, 30, 60, 100)
FRACTIONS = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6)
CUTOFFS = (5, 7, 10, 20)


def precision_at_k(pairs: DataFrame, order: list, key: str = "query_id", cutoffs=CUTOFFS) -> DataFrame:
    """Labels among the first k of each query's ranking, over all queries."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    # The filter is on the number itself, so that only the first rows of each query are sorted and kept.
    top = pairs.withColumn("number", number).where(F.col("number") <= max(cutoffs)).select("label", (F.col("number") - 1).alias("rank"))
    counts = top.groupBy("label", "rank").agg(F.count(F.lit(1)).alias("n"))  # a few rows for each rank
    grid = top.sparkSession.createDataFrame([(k,) for k in cutoffs], "k int")
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    out = grid.join(counts, F.col("rank") < F.col("k"), "left").groupBy("k").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), of("same").alias("same"), of("same_class").alias("same_class"), of("unrelated").alias("unrelated")
    )
    return out.select("k", (F.col("same") / F.greatest("n", F.lit(1))).alias("precision"), "same_class", "unrelated")


def gate_sweep(pairs: DataFrame, positives: Column | None = None) -> DataFrame:
    """True and false positives, precision, recall and F1 for every threshold and fraction; empty cells included.

    Pairs are counted by (label, inliers, matches) first: the grid meets distinct values, not pairs.
    """
    spark = pairs.sparkSession
    scored = pairs.where(F.col("label") != "twin")
    counts = scored.groupBy("label", "inliers", "raw_matches").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(t, f) for f in FRACTIONS for t in THRESHOLDS], "threshold int, fraction double")
    kept = (F.col("inliers") >= F.col("threshold")) & (inlier_fraction(F.col("inliers"), F.col("raw_matches")) >= F.col("fraction"))
    of = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))
    cells = F.broadcast(grid).join(counts, kept).groupBy("threshold", "fraction").agg(of("same").alias("tp"), of("same_class").alias("fp_same_class"), of("unrelated").alias("fp_unrelated"))
    total = scored.agg(F.count_if(F.col("label") == "same").alias("positives"))
    # A row per cell of the grid, and one of totals.
    full = grid.join(F.broadcast(cells), ["threshold", "fraction"], "left").fillna(0, ["tp", "fp_same_class", "fp_unrelated"]).crossJoin(F.broadcast(total))
    wrong = F.col("fp_same_class") + F.col("fp_unrelated")
    precision = F.col("tp") / F.greatest(F.col("tp") + wrong, F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("positives"), F.lit(1))
    out = full.withColumn("precision", precision).withColumn("recall", recall)
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))
    return out.select("threshold", "fraction", "tp", "fp_same_class", "fp_unrelated", "precision", "recall", f1.alias("f1"))


def best_gate(sweep: DataFrame) -> DataFrame:
    """Without false positives the best recall, then the smaller fraction, then threshold; otherwise the best F1."""
    clean = (F.col("precision") >= 1.0) & (F.col("tp") > 0)
    ranked = sweep.withColumn("clean", clean).orderBy(
        F.desc("clean"), F.when(clean, F.col("recall")).otherwise(F.col("f1")).desc(), "fraction", "threshold"
    )
    return ranked.limit(1).select("threshold", "fraction", "recall", "f1", "clean")


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted values: the upper one of two middle ones."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def inlier_distribution(pairs: DataFrame, column: str = "inliers") -> DataFrame:
    """Smallest, upper median and largest per label, from counts of distinct values rather than lists of all rows."""
    counts = pairs.groupBy("label", column).agg(F.count(F.lit(1)).alias("n"))
    by_value = Window.partitionBy("label").orderBy(column)
    whole = Window.partitionBy("label")
    placed = counts.withColumn("upto", F.sum("n").over(by_value)).withColumn("total", F.sum("n").over(whole))
    middle = F.floor(F.col("total") / 2)
    return placed.groupBy("label").agg(
        F.min(column).alias("least"), F.min(F.when(F.col("upto") > middle, F.col(column))).alias("median"), F.max(column).alias("most")
    )


def feedback_lift(verified: DataFrame, candidates: DataFrame, suite: Column) -> DataFrame:
    """What confirming brings: every query is judged twice, with its first exemplar and with one more for each confirmed photo.

    ``verified`` has ``query_id``, ``photo_id``, ``exemplar_no`` (from 1), ``inliers`` and ``raw_matches``; ``candidates`` all (query, photo)
    with their ``kind``.  The user confirms the true matches of the first run.  In the second, a photo is judged
    by its best exemplar: most inliers, the earlier one of equals.
    """
    key = ["query_id", "photo_id"]
    passed = F.coalesce(accept(F.col("inliers"), F.col("raw_matches")), F.lit(False))
    first = verified.where("exemplar_no = 1").select(*key, passed.alias("hit"))
    one = candidates.join(first, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    seeds = one.where((F.col("kind") == "true") & F.col("hit")).groupBy("query_id").agg(F.count(F.lit(1)).alias("confirmed"))
    known = verified.join(seeds, "query_id", "left").where((F.col("exemplar_no") <= 1 + F.coalesce("confirmed", F.lit(0))) & (F.col("inliers") > 0))
    best = known.groupBy(*key).agg(F.max_by(F.struct("inliers", "raw_matches"), F.struct("inliers", -F.col("exemplar_no"))).alias("b")).select(*key, "b.*")
    both = one.join(best.select(*key, passed.alias("after")), key, "left").withColumn("after", F.coalesce("after", F.lit(False)))
    true = F.col("kind") == "true"
    return both.groupBy(suite.alias("suite")).agg(
        F.count_if(true & F.col("hit")).alias("before"), F.count_if(true & F.col("after")).alias("after"), F.count_if(~true & F.col("hit")).alias("false_positives_before"),
        F.count_if(~true & F.col("after")).alias("false_positives_after"), F.count_if(true).alias("total"),
    )
