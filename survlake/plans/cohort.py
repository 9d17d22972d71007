"""Queries of the interval, descriptive and non-parametric survival operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import (
    baseline_rows, censoring_weights, combined_endpoint, compare_km_cif, counting_process, cumulative_incidence,
    daily_counts, daily_prevalence, describe_categorical, describe_continuous, expand_days, finegray_expand, freq,
    freq_percent, kaplan_meier, longitudinal_points, missing_profile, nelson_aalen, relevel_event, risk_table,
    survival_response,
)
from ..operators.scan import time_splits
from . import fixtures as fx
from .fixtures import sql_with
from .registry import query

_FLAGS = ["sex", "urgent", "seg_b", "response"]
_VALUES = ["age", "marker", "pulse", "prio"]

_CP_COLS = """id, CAST(visitdt AS VARCHAR) AS visitdt, CAST(post_date AS VARCHAR) AS post_date, time, start_time, end_time,
       CAST(event_numeric AS BIGINT) AS event_numeric, CAST(response AS BIGINT) AS response"""


@query("counting_process", sql_with("cp") + f"SELECT {_CP_COLS} FROM cp")
def cp_query(spark, sf_dir):
    cp = counting_process(fx.analysis(spark, sf_dir), "id", "visitdt", "origin", "final", "status")
    return cp.select("id", "visitdt", "post_date", "time", "start_time", "end_time", "event_numeric", "response")


@query("baseline_rows", sql_with("basal") + f"SELECT {_CP_COLS} FROM basal")
def basal_query(spark, sf_dir):
    return baseline_rows(fx.cp(spark, sf_dir), "id", "status").select(
        "id", "visitdt", "post_date", "time", "start_time", "end_time", "event_numeric", "response")


# --- by day ---------------------------------------------------------------------

_DAYS = "days AS MATERIALIZED (SELECT c.*, unnest(range(start_time, end_time)) AS day FROM cp c)"


@query("expand_days", sql_with("cp", more=_DAYS) + """
SELECT id, start_time, count(*) AS n, CAST(sum(day) AS BIGINT) AS total, min(day) AS first_day, max(day) AS last_day
FROM days GROUP BY id, start_time
""")
def expand_query(spark, sf_dir):
    """Every day row of every interval is built and counted."""
    days = expand_days(fx.cp(spark, sf_dir).select("id", "start_time", "end_time"), "start_time", "end_time")
    return days.groupBy("id", "start_time").agg(
        F.count("*").alias("n"), F.sum("day").alias("total"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"))


@query("daily_prevalence", sql_with("cp", more=_DAYS) + " UNION ALL ".join(
    f"SELECT day, '{c}' AS variable, round(avg({c}) * 100, 6) AS yes_pct FROM days GROUP BY day" for c in _FLAGS))
def prevalence_query(spark, sf_dir):
    return daily_prevalence(fx.cp(spark, sf_dir), _FLAGS)


@query("daily_counts", sql_with("cp", more=_DAYS) + " UNION ALL ".join(
    f"SELECT day, '{c}' AS variable, CASE {c} WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS category, count(*) AS n "
    "FROM days GROUP BY 1, 2, 3" for c in _FLAGS))
def counts_query(spark, sf_dir):
    return daily_counts(fx.cp(spark, sf_dir), _FLAGS)


# --- tables -----------------------------------------------------------------------


@query("freq", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def freq_query(spark, sf_dir):
    return freq(fx.table(spark, sf_dir, "events"), "event_type")


@query("freq_percent", sql_with("basal") + """
SELECT CASE event_numeric WHEN 0 THEN 'Censored' WHEN 1 THEN 'Dead' WHEN 2 THEN 'Transplant' END AS event,
       count(*) AS n, round(round_even(count(*) / sum(count(*)) OVER () * 100, 2), 6) AS percent
FROM basal GROUP BY 1
""")
def freq_percent_query(spark, sf_dir):
    b = fx.basal(spark, sf_dir).withColumn("event", F.when(F.col("event_numeric") == 0, "Censored").when(
        F.col("event_numeric") == 1, "Dead").otherwise("Transplant"))
    return freq_percent(b, "event")


@query("state_counts", sql_with("basal") + """
SELECT 'Initial' AS "from", CAST(event_numeric AS BIGINT) AS event_numeric, count(*) AS n FROM basal GROUP BY 1, 2
""")
def state_counts(spark, sf_dir):
    b = fx.basal(spark, sf_dir).withColumn("from", F.lit("Initial"))
    return freq(b, "from", "event_numeric")


@query("censor_times", sql_with("basal") + "SELECT DISTINCT time FROM basal WHERE event_numeric = 0")
def censor_times(spark, sf_dir):
    return fx.basal(spark, sf_dir).where("event_numeric = 0").select("time").distinct().orderBy("time")


@query("missing_profile", sql_with("visits", "cp") + " UNION ALL ".join(
    f"SELECT '{t}' AS stage, '{c}' AS variable, round(avg(CASE WHEN {e} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing FROM {t}"
    for t in ("visits", "cp") for c, e in (("marker", "marker"), ("pulse", "nullif(pulse, -99)"), ("prio", "prio"))))
def missing_query(spark, sf_dir):
    cols = ["marker", "pulse", "prio"]
    before = fx.visits(spark, sf_dir).withColumn("pulse", F.nullif("pulse", F.lit(-99)))
    before = missing_profile(before, cols, scale=100.0).withColumn("stage", F.lit("visits"))
    after = missing_profile(fx.cp(spark, sf_dir), cols, scale=100.0).withColumn("stage", F.lit("cp"))
    return before.unionByName(after).select("stage", "variable", "missing")


@query("describe_continuous", sql_with("basal") + " UNION ALL ".join(f"""
SELECT '{c}' AS variable, round((1 - count({c}) / count(*)) * 100, 6) AS missing_pct, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS sd, round(CAST(min({c}) AS DOUBLE), 6) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM basal""" for c in _VALUES))
def continuous_query(spark, sf_dir):
    return describe_continuous(fx.basal(spark, sf_dir), _VALUES)


@query("describe_continuous_lines", " UNION ALL ".join(f"""
SELECT '{c}' AS variable, round((1 - count({c}) / count(*)) * 100, 6) AS missing_pct, round(avg({c}), 5) AS mean,
  round(stddev_samp({c}), 5) AS sd, round(min({c}), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median,
  round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")))
def continuous_lines(spark, sf_dir):
    d = describe_continuous(fx.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return d.withColumns({"mean": F.round("mean", 5), "sd": F.round("sd", 5)})


@query("describe_categorical", sql_with("basal") + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, round(coalesce(sum({c}), 0) / count(*) * 100, 6) AS yes_pct, "
    f"round((1 - count({c}) / count(*)) * 100, 6) AS missing_pct FROM basal" for c in _FLAGS))
def categorical_query(spark, sf_dir):
    return describe_categorical(fx.basal(spark, sf_dir), _FLAGS)


@query("longitudinal_points", sql_with("cp") + " UNION ALL ".join(
    f"SELECT id, start_time AS time, '{c}' AS variable, round(CAST({c} AS DOUBLE), 6) AS value FROM cp UNION ALL "
    f"SELECT id, time, '{c}', round(CAST({c} AS DOUBLE), 6) FROM "
    "(SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY id ORDER BY start_time DESC) = 1)"
    for c in ("marker", "pulse", "prio")))
def points_query(spark, sf_dir):
    return longitudinal_points(fx.cp(spark, sf_dir), "id", ["marker", "pulse", "prio"])


# --- risk tables and curves ----------------------------------------------------------

# at risk by definition: one comparison per subject and time, collapsed to distinct end times first
_RISK = """
ends AS (SELECT time, count(*) AS n_all, count(*) FILTER (event_numeric = 1) AS d1,
                count(*) FILTER (event_numeric = 2) AS d2, count(*) FILTER (event_numeric = 0) AS c
         FROM basal GROUP BY time),
risk AS (SELECT e.time, e.d1, e.d2, e.d1 + e.d2 AS d, e.c,
                CAST((SELECT sum(n_all) FROM ends x WHERE x.time >= e.time) AS BIGINT) AS n FROM ends e)
"""
_W = "OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_WB = "OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("risk_table", sql_with("basal", more=_RISK) + """
SELECT time, n AS n_risk, d AS n_event, c AS n_censor, d1 AS n_event_1, d2 AS n_event_2 FROM risk
""")
def risk_query(spark, sf_dir):
    resp = survival_response(fx.basal(spark, sf_dir), "time", "event_numeric")
    return risk_table(resp, causes=[1, 2]).drop("n_tied")


@query("risk_table_intervals", sql_with("cp", more="""
t AS (SELECT DISTINCT end_time AS time, response FROM cp WHERE response IS NOT NULL)""") + """
SELECT t.response, t.time, count(*) AS n_risk, count(*) FILTER (c.end_time = t.time AND event_numeric = 2) AS n_event,
       count(*) FILTER (c.end_time = t.time AND event_numeric = 0 AND c.end_time = c.time) AS n_censor
FROM t JOIN cp c ON c.response = t.response AND c.start_time < t.time AND c.end_time >= t.time GROUP BY 1, 2
""")
def risk_intervals(spark, sf_dir):
    resp = survival_response(fx.cp(spark, sf_dir), "end_time", "event_numeric", 2, start="start_time")
    rt = risk_table(resp, ["response"], last=F.col("end_time") == F.col("time"))
    return rt.select(F.col("response").cast("int").alias("response"), "time", "n_risk", "n_event", "n_censor")


@query("kaplan_meier", sql_with("basal", more=_RISK) + f"""
SELECT time, n AS n_risk, d1 AS n_event, c AS n_censor, round(product(1 - d1 / n) {_W}, 6) AS surv FROM risk
""")
def km_query(spark, sf_dir):
    return kaplan_meier(survival_response(fx.basal(spark, sf_dir), "time", "event_numeric", 1))


@query("nelson_aalen", sql_with("basal", more=_RISK) + f"""
SELECT time, n AS n_risk, d AS n_event, round(sum(d / n) {_W}, 6) AS hazard FROM risk
""")
def na_query(spark, sf_dir):
    return nelson_aalen(survival_response(fx.basal(spark, sf_dir), "time", "event_numeric"))


@query("nelson_aalen_efron", sql_with("basal", more=_RISK) + f"""
SELECT time, n AS n_risk, d AS n_event,
       round(sum(coalesce(list_sum(list_transform(range(0, d), lambda l: 1.0::DOUBLE / (n - l))), 0)) {_W}, 6) AS hazard
FROM risk
""")
def na_efron(spark, sf_dir):
    return nelson_aalen(survival_response(fx.basal(spark, sf_dir), "time", "event_numeric"), ties="efron")


@query("nelson_aalen_spells", sql_with("spells", more="""
pts AS (SELECT stop AS t, 0 AS at_start, status AS d FROM spells UNION ALL SELECT start, 1, 0 FROM spells),
g AS (SELECT t, sum(CASE WHEN at_start = 0 THEN 1 ELSE 0 END) AS ends, sum(CASE WHEN at_start = 1 THEN 1 ELSE 0 END) AS starts,
             sum(d) AS d FROM pts GROUP BY t),
r AS (SELECT t, ends, d, sum(ends - starts) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g)
""") + """
SELECT t AS time, CAST(n AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event,
       round(sum(d / n) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS hazard
FROM r WHERE ends > 0
""")
def na_spells(spark, sf_dir):
    """Microsecond times: nearly every row is its own time, so the axis is scanned in chunks."""
    s = fx.spells(spark, sf_dir).withColumns({"begin": F.col("start"), "finish": F.col("stop")})
    resp = survival_response(s, "finish", "status", 1, start="begin")
    return nelson_aalen(resp, splits=time_splits(resp, "surv_stop", per_chunk=5_000))


_CIF = f"""
pre AS (SELECT *, coalesce(product(1 - d / n) {_WB}, 1.0) AS s FROM risk),
cif AS (SELECT time, sum(s * d1 / n) {_W} AS c1, sum(s * d2 / n) {_W} AS c2, sum(s * d / n) {_W} AS cb,
               product(1 - d1 / n) {_W} AS k1, product(1 - d2 / n) {_W} AS k2, product(1 - d / n) {_W} AS kb FROM pre)
"""


@query("cumulative_incidence", sql_with("basal", more=_RISK + "," + _CIF) + """
SELECT time, unnest([1, 2])::BIGINT AS cause, round(unnest([c1, c2]), 6) AS est FROM cif
""")
def cif_query(spark, sf_dir):
    return cumulative_incidence(fx.basal(spark, sf_dir), "time", "event_numeric")


@query("cumulative_incidence_strata", sql_with("basal", more="""
ends AS (SELECT cohort, time, count(*) AS n_all, count(*) FILTER (event_numeric = 1) AS d1,
                count(*) FILTER (event_numeric = 2) AS d2 FROM basal GROUP BY 1, 2),
risk AS (SELECT e.*, d1 + d2 AS d, (SELECT sum(n_all) FROM ends x WHERE x.time >= e.time AND x.cohort = e.cohort) AS n FROM ends e),
pre AS (SELECT *, coalesce(product(1 - d / n) OVER (PARTITION BY cohort ORDER BY time
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS s FROM risk),
cif AS (SELECT cohort, time, sum(s * d1 / n) OVER w AS c1, sum(s * d2 / n) OVER w AS c2 FROM pre
        WINDOW w AS (PARTITION BY cohort ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
""") + "SELECT cohort, time, unnest([1, 2])::BIGINT AS cause, round(unnest([c1, c2]), 6) AS est FROM cif")
def cif_strata(spark, sf_dir):
    return cumulative_incidence(fx.basal(spark, sf_dir), "time", "event_numeric", strata=["cohort"],
                                splits=[300, 900, 1500])


@query("compare_km_cif", sql_with("basal", more=_RISK + "," + _CIF) + """
SELECT unnest(['1 - KM', '1 - KM', '1 - KM', 'CIF', 'CIF', 'CIF']) AS which_est,
       unnest(['Death', 'Transplant', 'Death or transplant', 'Death', 'Transplant', 'Death or transplant']) AS which_event,
       time, round(unnest([1 - k1, 1 - k2, 1 - kb, c1, c2, cb]), 6) + 0.0 AS est FROM cif
""")
def compare_query(spark, sf_dir):
    return compare_km_cif(fx.basal(spark, sf_dir), "time", "event_numeric",
                          {1: "Death", 2: "Transplant"}, "Death or transplant")


@query("endpoint_codes", sql_with("basal") + """
SELECT id, CASE WHEN event_numeric IN (1, 2) THEN 'DeadOrTransplant' ELSE 'Censored' END AS event_both,
       CAST(CASE event_numeric WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS event_code
FROM basal
""")
def endpoint_codes(spark, sf_dir):
    b = fx.basal(spark, sf_dir)
    b = combined_endpoint(b, "event_numeric", [1, 2], "event_both", "DeadOrTransplant", "Censored")
    b = b.withColumn("event", F.when(F.col("event_numeric") == 0, "Censored").when(
        F.col("event_numeric") == 1, "Dead").otherwise("Transplant"))
    return relevel_event(b, "event", "Transplant", ["Censored", "Dead", "Transplant"]).select(
        "id", "event_both", "event_code")


_G = f"""
gw AS (SELECT *, CASE WHEN c > 0 THEN 1 - c / (n - d) ELSE 1.0 END AS fac FROM risk),
g AS (SELECT time, n, d, c, d1, coalesce(product(fac) {_WB}, 1.0) AS g_before, product(fac) {_W} AS g FROM gw)
"""


@query("censoring_weights", sql_with("basal", more=_RISK + "," + _G) + """
SELECT time, n AS n_risk, d AS n_event, c AS n_censor, round(g_before, 6) AS g_before, round(g, 6) AS g FROM g
""")
def weights_query(spark, sf_dir):
    return censoring_weights(fx.basal(spark, sf_dir), "time", "event_numeric")


_CUTS = """,
cuts AS (SELECT time AS lo, g AS gs, lead(time, 1, (SELECT max(time) FROM ends)) OVER (ORDER BY time) AS hi FROM g WHERE c > 0
         UNION ALL SELECT 0, 1.0, (SELECT min(time) FROM g WHERE c > 0)),
kept AS (SELECT * FROM cuts k WHERE EXISTS (SELECT 1 FROM ends e WHERE e.d1 > 0 AND e.time > k.lo AND e.time <= k.hi))
"""


@query("finegray_expand", sql_with("basal", more=_RISK + "," + _G + _CUTS) + """
SELECT id, CAST(0 AS BIGINT) AS fgstart, time AS fgstop, CAST(event_numeric = 1 AS BIGINT) AS fgstatus, 1.0::DOUBLE AS fgwt FROM basal
UNION ALL
SELECT b.id, greatest(k.lo, b.time), k.hi, 0, round(k.gs / g.g_before, 6)
FROM basal b JOIN g ON g.time = b.time JOIN kept k ON k.hi > b.time WHERE b.event_numeric = 2
""")
def expand_finegray(spark, sf_dir):
    b = fx.basal(spark, sf_dir).select("id", "time", "event_numeric")
    return finegray_expand(b, 1, "event_numeric", "time").select("id", "fgstart", "fgstop", "fgstatus", "fgwt")


@query("finegray_expand_intervals", sql_with("basal", more=_RISK + "," + _G + _CUTS) + """
SELECT id, start_time AS fgstart, end_time AS fgstop, CAST(event_numeric = 1 AS BIGINT) AS fgstatus, 1.0::DOUBLE AS fgwt FROM cp
UNION ALL
SELECT c.id, greatest(k.lo, c.end_time), k.hi, 0, round(k.gs / g.g_before, 6)
FROM cp c JOIN g ON g.time = c.end_time JOIN kept k ON k.hi > c.end_time WHERE c.event_numeric = 2
""")
def expand_finegray_intervals(spark, sf_dir):
    """Interval rows: a subject stays with the last covariates after a competing event."""
    cp = fx.cp(spark, sf_dir).select("id", "start_time", "end_time", "time", "event_numeric")
    return finegray_expand(cp, 1, "event_numeric", "end_time", "start_time", "time").select(
        "id", "fgstart", "fgstop", "fgstatus", "fgwt")
