"""Queries of the offset estimator. Stand-in: customers are recordings with three sources of evidence and six windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import offsets as of
from parley.plans.registry import query, table

SOURCES = ("annotation", "canary", "conversation_annotation")


def _examples(spark, d):
    k = F.col("k")
    true = (k * 7 % 41 - 20) / 10.0
    source = lambda i, n: F.struct(F.lit(n).alias("source"), F.when(k % (i + 3) == 0, (k * 3 % 51 - 25) / 8.0).otherwise(true).alias("shift"), ((k * (i + 2) % 13 + 1) / 128.0).alias("improvement"), (k * (i + 5) % 9 / 512.0).alias("joint"))
    window = lambda i: F.struct(F.lit(SOURCES[i % 2]).alias("source"), F.lit(60.0 * i).alias("start"), F.when(k % 5 == 0, true + i * 0.5).otherwise(true).alias("shift"), (k * (i + 3) % 17 / 256.0).alias("improvement"), (k * (i + 1) % 7 / 256.0).alias("joint"))
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return x.select("k", (k % 2 == 0).alias("full"), F.array(*[source(i, n) for i, n in enumerate(SOURCES)]).alias("sources"), F.array(*[window(i) for i in range(6)]).alias("windows"), F.when(k % 4 > 0, true).otherwise(0.0).alias("label"), (k * 11 % 5).cast("int").alias("fold"))


#: Sources and windows as rows, one configuration after the other.
PREDICTED = f"""kk AS (SELECT c_custkey AS k, (c_custkey * 7 % 41 - 20) / 10.0::DOUBLE AS tr, c_custkey % 2 = 0 AS is_full FROM customer),
so AS (SELECT k, tr, is_full, i, n AS source, CASE WHEN k % (i + 3) = 0 THEN (k * 3 % 51 - 25) / 8.0::DOUBLE ELSE tr END AS shift, (k * (i + 2) % 13 + 1) / 128.0::DOUBLE AS im, k * (i + 5) % 9 / 512.0::DOUBLE AS jo FROM kk, (VALUES (0, '{SOURCES[0]}'), (1, '{SOURCES[1]}'), (2, '{SOURCES[2]}')) v(i, n)),
wi AS (SELECT k, i, i % 2 AS source, CASE WHEN k % 5 = 0 THEN tr + i * 0.5::DOUBLE ELSE tr END AS shift, k * (i + 3) % 17 / 256.0::DOUBLE AS im, k * (i + 1) % 7 / 256.0::DOUBLE AS jo FROM kk, (SELECT unnest(range(6)) AS i)),
ss AS (SELECT k, source FROM (SELECT k, source, row_number() OVER (PARTITION BY k ORDER BY sum(im + 2 * jo) DESC, source DESC) AS p FROM wi GROUP BY k, source) WHERE p = 1), se AS (SELECT wi.*, row_number() OVER (PARTITION BY wi.k ORDER BY i) AS r FROM wi JOIN ss USING (k, source)),
cf AS (SELECT * FROM (SELECT unnest([0.4, 0.8, 1.2])::DOUBLE AS ll) a, (SELECT unnest([0.02, 0.03, 0.05])::DOUBLE AS li) b, (SELECT unnest([0.0, 0.008, 0.015])::DOUBLE AS lj) c, (SELECT unnest([1, 2]) AS ls) d, (SELECT unnest(['all_sources', 'zero_shift']) AS fb) e),
va AS (SELECT k, li, lj, any_value(shift) FILTER (r = 1) AS first, count(*) FILTER (im >= li AND jo >= lj) >= 2 AND max(shift) FILTER (im >= li AND jo >= lj) - min(shift) FILTER (im >= li AND jo >= lj) >= 1.5 AS vary FROM se, (SELECT DISTINCT li, lj FROM cf) GROUP BY k, li, lj),
st AS (SELECT * FROM so WHERE NOT is_full OR source != 'conversation_annotation'), me AS (SELECT st.*, cf.*, abs(shift) >= ll AND im >= li AND jo >= lj AS ok, greatest(0.001, im + 2 * jo) AS w FROM st, cf), nn AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY k, ll, li, lj, ls, fb) < ls AS few FROM me),
us AS (SELECT *, sum(w) OVER (PARTITION BY k, ll, li, lj, ls, fb ORDER BY shift, w, i ROWS UNBOUNDED PRECEDING) AS acc, sum(w) OVER (PARTITION BY k, ll, li, lj, ls, fb) / 2 AS half FROM nn WHERE few OR ok),
md AS (SELECT k, ll, li, lj, ls, fb, any_value(few) AS few, any_value(is_full) AS is_full, min(shift) FILTER (acc >= half) AS shift FROM us GROUP BY k, ll, li, lj, ls, fb),
pr AS (SELECT md.k, md.ll, md.li, md.lj, ls, fb, CASE WHEN few AND fb = 'zero_shift' THEN 0.0::DOUBLE ELSE round(round_even(CASE WHEN is_full AND vary THEN first ELSE shift END / 0.1::DOUBLE, 0) * 0.1::DOUBLE, 1) END AS prediction FROM md JOIN va ON va.k = md.k AND va.li = md.li AND va.lj = md.lj)"""

FIRST = of.GRID[17]


@query(f"WITH {PREDICTED} SELECT k, prediction FROM pr WHERE ll = {FIRST['least_lag']} AND li = {FIRST['least_improvement']} AND lj = {FIRST['least_joint']} AND ls = {FIRST['least_sources']} AND fb = '{FIRST['fallback']}'")
def predict_offset(spark, d):
    return of.predict(_examples(spark, d), "k", FIRST)


EVALUATED = f"""{PREDICTED}, er AS (SELECT pr.*, k * 11 % 5 AS fold, abs(prediction - CASE WHEN k % 4 > 0 THEN (k * 7 % 41 - 20) / 10.0::DOUBLE ELSE 0.0 END) AS e FROM pr), tn AS (SELECT f AS fold, ll, li, lj, ls, fb, round(sqrt(avg(e * e)), 9) AS rmse, round(avg(e), 9) AS mae, max(e) AS top, -avg((e <= 0.1)::INTEGER) AS near FROM er, (SELECT unnest(range(5)) AS f) WHERE fold != f GROUP BY ALL),
ch AS (SELECT * FROM tn QUALIFY row_number() OVER (PARTITION BY fold ORDER BY rmse, mae, round(top, 9), near, ll, li, lj, ls, fb) = 1)"""


@query(f"""WITH {EVALUATED} SELECT ch.fold::INTEGER AS fold, ch.ll AS least_lag, ch.li AS least_improvement, ch.lj AS least_joint, ch.ls AS least_sources, ch.fb AS fallback, round(any_value(rmse), 6) AS train_rmse, round(any_value(mae), 6) AS train_mae, round(sqrt(avg(e * e)), 6) AS test_rmse, round(avg(e), 6) AS test_mae
FROM ch JOIN er ON er.fold = ch.fold AND er.ll = ch.ll AND er.li = ch.li AND er.lj = ch.lj AND er.ls = ch.ls AND er.fb = ch.fb GROUP BY ALL""")
def offset_evaluation(spark, d):
    folds, _ = of.evaluate(_examples(spark, d), "k")
    return folds.select("fold", *of.CONFIGURATION, *[F.round(c, 6).alias(c) for c in ("train_rmse", "train_mae", "test_rmse", "test_mae")])


@query(f"""WITH {EVALUATED} SELECT er.k, er.fold::INTEGER AS fold, er.prediction, round(e, 6) AS error FROM ch JOIN er ON er.fold = ch.fold AND er.ll = ch.ll AND er.li = ch.li AND er.lj = ch.lj AND er.ls = ch.ls AND er.fb = ch.fb""")
def offset_held_out(spark, d):
    _, samples = of.evaluate(_examples(spark, d), "k")
    return samples.select("k", "fold", "prediction", F.round("error", 6).alias("error"))
