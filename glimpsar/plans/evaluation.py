"""Queries of the evaluation: precision, sweeps, accept rates, recall and what feedback brings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gate as G
from ..operators import evaluation as E
from . import fixtures as X
from .registry import query

_GATE = "(inliers >= 30 OR (inliers >= 6 AND CAST(inliers AS DOUBLE) / greatest(raw_matches, 1) >= CAST(0.45 AS DOUBLE)))"


@query("precision_at_k", X.sql("f_pairs", """
r AS (SELECT label, row_number() OVER (PARTITION BY query_id ORDER BY recall_score DESC, photo_id, pair_id, pair_no, inliers) - 1 AS rank FROM f_pairs), k AS (SELECT CAST(unnest([5, 7, 10, 20]) AS INT) AS k)
SELECT k, CAST(count(*) FILTER (WHERE label = 'same') AS DOUBLE) / greatest(count(label), 1) AS precision, count(*) FILTER (WHERE label = 'same_class') AS same_class, count(*) FILTER (WHERE label = 'unrelated') AS unrelated
FROM k LEFT JOIN r ON rank < k GROUP BY k"""))
def precision_at_k(spark, sf_dir):
    return E.precision_at_k(X.pairs(spark, sf_dir), [F.desc("recall_score"), "photo_id", "pair_id", "pair_no", "inliers"])


_SWEEP = """
th AS (SELECT CAST(unnest([4, 5, 6, 8, 10, 12, 15, 20, 30, 60, 100]) AS INT) AS threshold), fr AS (SELECT CAST(unnest([0, 0.2, 0.3, 0.4, 0.5, 0.6]) AS DOUBLE) AS fraction), grid AS (SELECT * FROM th, fr),
n AS (SELECT label, inliers, raw_matches, count(*) AS n FROM f_pairs WHERE label <> 'twin' GROUP BY label, inliers, raw_matches), total AS (SELECT count(*) AS positives FROM f_pairs WHERE label = 'same'),
c AS (SELECT threshold, fraction, CAST(coalesce(sum(n) FILTER (WHERE label = 'same'), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (WHERE label = 'same_class'), 0) AS BIGINT) AS fp_same_class, CAST(coalesce(sum(n) FILTER (WHERE label = 'unrelated'), 0) AS BIGINT) AS fp_unrelated
      FROM grid LEFT JOIN n ON inliers >= threshold AND CAST(inliers AS DOUBLE) / greatest(raw_matches, 1) >= fraction GROUP BY threshold, fraction),
p AS (SELECT c.*, CAST(tp AS DOUBLE) / greatest(tp + fp_same_class + fp_unrelated, 1) AS precision, CAST(tp AS DOUBLE) / greatest(positives, 1) AS recall FROM c, total),
sweep AS (SELECT *, 2 * precision * recall / greatest(precision + recall, CAST(1e-9 AS DOUBLE)) AS f1 FROM p)"""


@query("gate_sweep", X.sql("f_pairs", _SWEEP + " SELECT threshold, fraction, tp, fp_same_class, fp_unrelated, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM sweep"))
def gate_sweep(spark, sf_dir):
    out = E.gate_sweep(X.pairs(spark, sf_dir))
    return out.select("threshold", "fraction", "tp", "fp_same_class", "fp_unrelated", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("best_gate", X.sql("f_pairs", _SWEEP + """
SELECT threshold, fraction, round(recall, 9) AS recall, round(f1, 9) AS f1, precision >= 1 AND tp > 0 AS clean FROM sweep
ORDER BY precision >= 1 AND tp > 0 DESC, CASE WHEN precision >= 1 AND tp > 0 THEN recall ELSE f1 END DESC, fraction, threshold LIMIT 1"""))
def best_gate(spark, sf_dir):
    return E.best_gate(E.gate_sweep(X.pairs(spark, sf_dir))).select("threshold", "fraction", F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"), "clean")


@query("per_class_accept", X.sql("f_pairs", f"""
SELECT label, count(*) AS candidates, count(*) FILTER (WHERE {_GATE}) AS accepted, round(CAST(count(*) FILTER (WHERE {_GATE}) AS DOUBLE) / count(*), 9) AS rate FROM f_pairs GROUP BY label"""))
def per_class_accept(spark, sf_dir):
    accepted = F.count_if(G.accept(F.col("inliers"), F.col("raw_matches")))
    return X.pairs(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("candidates"), accepted.alias("accepted"), F.round(accepted / F.count(F.lit(1)), 9).alias("rate"))


@query("inlier_distribution", X.sql("f_pairs", """
l AS (SELECT label, list_sort(list(inliers)) AS v FROM f_pairs GROUP BY label) SELECT label, v[1] AS least, v[CAST(floor(len(v) / 2) AS INT) + 1] AS median, v[len(v)] AS most FROM l"""))
def inlier_distribution(spark, sf_dir):
    return E.inlier_distribution(X.pairs(spark, sf_dir))


#: Truth of a query: the photos of the same tenth.  A pair's line number is the exemplar that the photo was compared with.
_KIND = "CASE WHEN photo_id % 10 = query_id % 10 THEN 'true' WHEN photo_id % 10 < 5 THEN 'same_class' ELSE 'other' END"
_EVAL = f"""
got AS (SELECT query_id % 10 AS suite, query_id, photo_id, max(CASE WHEN {_GATE} THEN 1 ELSE 0 END) AS hit FROM f_pairs GROUP BY query_id, photo_id),
lab AS (SELECT *, {_KIND} AS kind FROM got)"""


def _kind():
    own = F.col("photo_id") % 10
    return F.when(own == F.col("query_id") % 10, "true").when(own < 5, "same_class").otherwise("other")


@query("eval_recall", X.sql("f_pairs", _EVAL + """
SELECT suite, count(*) FILTER (WHERE kind = 'true') AS positives, count(*) FILTER (WHERE kind = 'true' AND hit = 1) AS tp, count(*) FILTER (WHERE kind = 'same_class' AND hit = 1) AS fp_same_class, count(*) FILTER (WHERE kind = 'other' AND hit = 1) AS fp_other,
  round(CAST(count(*) FILTER (WHERE kind = 'true' AND hit = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE kind = 'true'), 0), 9) AS recall FROM lab GROUP BY suite"""))
def eval_recall(spark, sf_dir):
    got = X.pairs(spark, sf_dir).groupBy("query_id", "photo_id").agg(F.max(G.accept(F.col("inliers"), F.col("raw_matches")).cast("int")).alias("hit"))
    lab = got.withColumn("suite", F.col("query_id") % 10).withColumn("kind", _kind())
    of = lambda kind: F.count_if((F.col("kind") == kind) & (F.col("hit") == 1))
    positives = F.count_if(F.col("kind") == "true")
    return lab.groupBy("suite").agg(
        positives.alias("positives"), of("true").alias("tp"), of("same_class").alias("fp_same_class"), of("other").alias("fp_other"), F.round(of("true") / F.nullif(positives, F.lit(0)), 9).alias("recall")
    )


@query("feedback_lift", X.sql("f_pairs", f"""
v AS (SELECT query_id, photo_id, CAST(pair_no AS BIGINT) AS exemplar_no, max(inliers) AS inliers, arg_max(raw_matches, inliers * 10000 + raw_matches) AS raw_matches FROM f_pairs GROUP BY query_id, photo_id, pair_no),
c AS (SELECT DISTINCT query_id, photo_id, {_KIND} AS kind FROM f_pairs),
one AS (SELECT c.*, coalesce({_GATE}, false) AS hit FROM c LEFT JOIN v ON c.query_id = v.query_id AND c.photo_id = v.photo_id AND v.exemplar_no = 1),
seeds AS (SELECT query_id, count(*) AS confirmed FROM one WHERE kind = 'true' AND hit GROUP BY query_id),
best AS (SELECT query_id, photo_id, inliers, raw_matches FROM (SELECT v.*, row_number() OVER (PARTITION BY v.query_id, v.photo_id ORDER BY inliers DESC, exemplar_no) AS n FROM v LEFT JOIN seeds s ON v.query_id = s.query_id WHERE exemplar_no <= 1 + coalesce(confirmed, 0) AND inliers > 0) WHERE n = 1),
two AS (SELECT o.*, coalesce({_GATE}, false) AS after FROM one o LEFT JOIN best b ON o.query_id = b.query_id AND o.photo_id = b.photo_id)
SELECT query_id % 10 AS suite, count(*) FILTER (WHERE kind = 'true' AND hit) AS before, count(*) FILTER (WHERE kind = 'true' AND after) AS after, count(*) FILTER (WHERE kind <> 'true' AND hit) AS false_positives_before,
  count(*) FILTER (WHERE kind <> 'true' AND after) AS false_positives_after, count(*) FILTER (WHERE kind = 'true') AS total FROM two GROUP BY query_id % 10"""))
def feedback_lift(spark, sf_dir):
    """Two runs: with what was drawn (exemplar 1) alone, and with an exemplar more for each true match of the first run."""
    key = ["query_id", "photo_id"]
    best = F.max(F.struct("inliers", "raw_matches")).alias("b")
    v = X.pairs(spark, sf_dir).groupBy(*key, F.col("pair_no").cast("long").alias("exemplar_no")).agg(best).select(*key, "exemplar_no", "b.*")
    return E.feedback_lift(v, v.select(*key).distinct().withColumn("kind", _kind()), F.col("query_id") % 10)
