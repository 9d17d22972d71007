"""Queries of the regression, landmark, multi-state and report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import (
    all_models_table, asof_join, assign_states, baseline_rows, combined_endpoint, cox_fit, endpoint_table, expand_transitions,
    finegray_expand, finegray_fit, fit_together, landmark_counts, landmark_cut, landmark_grid, landmark_supermodel,
    probabilities_long, significance_mark, transition_cox, transition_hazards, transition_matrix,
    transition_probabilities,
)
from ..sources.io import materialize
from . import fixtures as fx
from .cox_sql import G_CTE, fit_sql, rounded
from .fixtures import BASE_TERMS, CAUSES, LABELS, MODEL_TERMS, STATES, sql_with
from .registry import query

_SHORT = ["term", "coef", "hr", "lower", "upper", "se"]
_GRID = landmark_grid(100, 2000, 100)
_HORIZON = 1000


# --- SQL of a fit with one 0/1 term ------------------------------------------------------
#
# ``rows`` gives (st, a, b, d, x, id): stratum, start, stop, event, term, subject. The
# risk sets are counted by comparison, then Newton runs as a recursive query.

_TIMES = """
tm AS MATERIALIZED (SELECT st, b AS t, count(*) AS m, sum(x) AS m1 FROM rw WHERE d = 1 GROUP BY 1, 2),
"""
_AT_RISK = """
rk AS MATERIALIZED (SELECT tm.st, tm.t, any_value(m) AS m, any_value(m1) AS m1,
    count(*) FILTER (x = 0) * 1.0::DOUBLE AS n0, count(*) FILTER (x = 1) * 1.0::DOUBLE AS n1
  FROM tm JOIN rw ON rw.st = tm.st AND rw.a < tm.t AND rw.b >= tm.t GROUP BY tm.st, tm.t),
"""
# Fine-Gray: subjects with the other cause stay, weighted by the censoring distribution
_AT_RISK_TAIL = """
rk AS MATERIALIZED (SELECT st, t, any_value(m) AS m, any_value(m1) AS m1,
    sum(CASE WHEN x = 0 THEN w ELSE 0 END) AS n0, sum(CASE WHEN x = 1 THEN w ELSE 0 END) AS n1
  FROM (SELECT tm.*, rw.x, 1.0::DOUBLE AS w FROM tm JOIN rw ON rw.st = tm.st AND rw.a < tm.t AND rw.b >= tm.t
        UNION ALL
        SELECT tm.*, rw.x, gt.g_before / gu.g_before FROM tm JOIN rw ON rw.st = tm.st AND rw.rival AND rw.b < tm.t
        JOIN g gt ON gt.time = tm.t JOIN g gu ON gu.time = rw.b) GROUP BY st, t),
"""
_UNTIE = {
    "breslow": "rx AS MATERIALIZED (SELECT st, t, m * 1.0::DOUBLE AS d, m1 * 1.0::DOUBLE AS d1, n0, n1 FROM rk),",
    "efron": """rx AS MATERIALIZED (SELECT st, t, 1.0::DOUBLE AS d, m1 / m AS d1, n0 - l / m * (m - m1) AS n0, n1 - l / m * m1 AS n1
        FROM (SELECT *, unnest(range(0, m)) AS l FROM rk)),""",
}
_NEWTON = """
it(k, b) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, b + u / i FROM (
    SELECT it.k, it.b, sum(d1 - d * n1 * exp(it.b) / (n0 + n1 * exp(it.b))) AS u,
           sum(d * n0 * n1 * exp(it.b) / ((n0 + n1 * exp(it.b)) * (n0 + n1 * exp(it.b)))) AS i
    FROM it, rx WHERE it.k < 12 GROUP BY it.k, it.b)),
fin AS MATERIALIZED (SELECT any_value(f.b) AS b, sum(d * n0 * n1 * exp(f.b) / ((n0 + n1 * exp(f.b)) * (n0 + n1 * exp(f.b)))) AS i
  FROM (SELECT b FROM it WHERE k = 12) f, rx)
"""
_SANDWICH = """,
res AS (SELECT rw.id, CASE WHEN rw.d = 1 THEN rw.x - any_value(own.n1 * exp(f.b) / (own.n0 + own.n1 * exp(f.b))) ELSE 0 END
    - coalesce(sum(exp(rw.x * f.b) * (rw.x - r.n1 * exp(f.b) / (r.n0 + r.n1 * exp(f.b))) * r.d / (r.n0 + r.n1 * exp(f.b))), 0) AS l
  FROM rw CROSS JOIN fin f LEFT JOIN rx r ON r.st = rw.st AND r.t > rw.a AND r.t <= rw.b
  LEFT JOIN rx own ON own.st = rw.st AND own.t = rw.b
  GROUP BY rw.id, rw.st, rw.a, rw.b, rw.d, rw.x),
meat AS (SELECT sum(s * s) AS v FROM (SELECT id, sum(l) AS s FROM res GROUP BY id))
"""
_Z = "1.959963984540054"
_G_SQL = G_CTE + ","


def _cox_sql(views, rows: str, term: str, ties: str = "breslow", cluster=False, tail=False) -> str:
    body = (_G_SQL if tail else "") + f"rw AS MATERIALIZED ({rows})," + _TIMES \
        + (_AT_RISK_TAIL if tail else _AT_RISK) + _UNTIE[ties] + _NEWTON + (_SANDWICH if cluster else "")
    se = "sqrt(meat.v) / fin.i" if cluster else "1 / sqrt(fin.i)"
    extra = ", round(sqrt(meat.v) / fin.i, 6) AS robust_se" if cluster else ""
    return sql_with(*views, recursive=True, more=body) + f"""
SELECT '{term}' AS term, round(b, 6) AS coef, round(exp(b), 6) AS hr, round(exp(b - {_Z} * {se}), 6) AS lower,
       round(exp(b + {_Z} * {se}), 6) AS upper, round(1 / sqrt(fin.i), 6) AS se{extra}
FROM fin{', meat' if cluster else ''}
"""


def _fit(terms, d, ties, source="cp", a="start_time", b="end_time", st="0", rival="FALSE", views=("cp",),
         pre="", robust=False, tail=False, select=None, ends=None) -> str:
    """Statement for a fit with many terms; ``select`` is what to take from ``out``."""
    rows = (f"SELECT {st} AS st, {a} AS a, {b} AS b, CAST({d} AS INTEGER) AS d, id, {rival} AS rival, "
            + ", ".join(f"CAST({t} AS DOUBLE) AS x{j}" for j, t in enumerate(terms, 1))
            + f" FROM {source} WHERE " + " AND ".join(f"{t} IS NOT NULL" for t in terms))
    more = ",\n".join(part.strip() for part in (pre, G_CTE if tail else "", fit_sql(rows, terms, ties, tail, robust, ends)) if part)
    return sql_with(*views, recursive=True, more=more) + f"SELECT {select or rounded()} FROM out"


def _fine_gray(terms, cause, ties, source="basal", a="0", b="time", event="event_numeric", known_weights=False, **more) -> str:
    ends = f"SELECT id, {a} AS a, {b} AS b, CASE WHEN {event} <> 0 THEN 1 WHEN {b} = time THEN 2 ELSE 0 END AS mark FROM {source}"
    return _fit(terms, f"{event} = {cause}", ties, source=source, a=a, b=b, views=("cp", "basal"),
                rival=f"({event} NOT IN (0, {cause}))", robust=True, tail=True,
                ends=None if known_weights else ends, **more)


def _rows(source, x, d, a="start_time", b="end_time", st="0", rival=""):
    return (f"SELECT {st} AS st, {a} AS a, {b} AS b, CAST({d} AS INTEGER) AS d, {x} AS x, id"
            f"{', ' + rival + ' AS rival' if rival else ''} FROM {source} WHERE {x} IS NOT NULL")


# --- Cox ------------------------------------------------------------------------------------


@query("cox_binary", _cox_sql(["basal"], _rows("basal", "sex", "event_numeric = 1", "0", "time"), "sex"))
def cox_binary(spark, sf_dir):
    return cox_fit(fx.basal(spark, sf_dir), "time", F.col("event_numeric") == 1, ["sex"],
                   ties="breslow").summary().select(*_SHORT)


@query("cox_efron_binary", _cox_sql(
    ["basal"], _rows("basal", "seg_h", "event_numeric > 0", "0", "time"), "seg_h", "efron"))
def cox_efron_binary(spark, sf_dir):
    return cox_fit(fx.basal(spark, sf_dir), "time", F.col("event_numeric") > 0, ["seg_h"]).summary().select(*_SHORT)


@query("cox_counting_binary", _cox_sql(["cp"], _rows("cp", "response", "event_numeric = 2"), "response", "efron"))
def cox_counting_binary(spark, sf_dir):
    return cox_fit(fx.cp(spark, sf_dir), "end_time", F.col("event_numeric") == 2, ["response"],
                   start="start_time").summary().select(*_SHORT)


@query("cox_strata_binary", _cox_sql(
    ["cp"], _rows("cp", "response", "event_numeric = 1", st="cohort"), "response"))
def cox_strata_binary(spark, sf_dir):
    return cox_fit(fx.cp(spark, sf_dir), "end_time", F.col("event_numeric") == 1, ["response"], start="start_time",
                   ties="breslow", strata=["cohort"]).summary().select(*_SHORT)


@query("cox_cluster_binary", _cox_sql(
    ["cp"], _rows("cp", "response", "event_numeric > 0"), "response", cluster=True))
def cox_cluster_binary(spark, sf_dir):
    return cox_fit(fx.cp(spark, sf_dir), "end_time", F.col("event_numeric") > 0, ["response"], start="start_time",
                   ties="breslow", cluster="id").summary().select(*_SHORT, "robust_se")


@query("cox_spells_binary", sql_with("spells", recursive=True, more="""
rw AS MATERIALIZED (SELECT 0 AS st, start AS a, stop AS b, status AS d, CAST(event_type = 'error' AS INTEGER) AS x FROM spells),
e AS (SELECT t, sum(s * (1 - x)) AS n0, sum(s * x) AS n1, sum(d) AS m, sum(d * x) AS m1 FROM (
        SELECT b AS t, 1 AS s, d, x FROM rw UNION ALL SELECT a, -1, 0, x FROM rw) GROUP BY t),
rk AS (SELECT 0 AS st, t, m, m1, sum(n0) OVER w * 1.0::DOUBLE AS n0, sum(n1) OVER w * 1.0::DOUBLE AS n1 FROM e
       WINDOW w AS (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rx AS MATERIALIZED (SELECT st, t, m * 1.0::DOUBLE AS d, m1 * 1.0::DOUBLE AS d1, n0, n1 FROM rk WHERE m > 0),
""" + _NEWTON) + f"""
SELECT 'after_error' AS term, round(b, 6) AS coef, round(exp(b), 6) AS hr, round(exp(b - {_Z} / sqrt(i)), 6) AS lower,
       round(exp(b + {_Z} / sqrt(i)), 6) AS upper, round(1 / sqrt(i), 6) AS se FROM fin
""")
def cox_spells(spark, sf_dir):
    """Repeated events on a microsecond axis: nearly every row is its own risk-set time."""
    s = fx.spells(spark, sf_dir).withColumn("after_error", (F.col("event_type") == "error").cast("int"))
    return cox_fit(s, "stop", "status", ["after_error"], start="start", ties="breslow").summary().select(*_SHORT)


@query("cox_multi", _fit(MODEL_TERMS, "event_numeric = 1", "efron"))
def cox_multi(spark, sf_dir):
    return cox_fit(fx.cp(spark, sf_dir), "end_time", F.col("event_numeric") == 1, MODEL_TERMS,
                   start="start_time").summary()


@query("cox_cluster", _fit(MODEL_TERMS, "event_numeric > 0", "breslow", robust=True))
def cox_cluster(spark, sf_dir):
    return cox_fit(fx.cp(spark, sf_dir), "end_time", F.col("event_numeric") > 0, MODEL_TERMS, start="start_time",
                   ties="breslow", cluster="id").summary()


@query("cox_weighted", _fine_gray(["age", "sex", "marker"], 1, "efron", known_weights=True))
def cox_weighted(spark, sf_dir):
    """The expanded Fine-Gray table, fitted as an ordinary weighted model."""
    b, release = materialize(fx.basal(spark, sf_dir))      # read by the curve, the events and the rows: built once
    try:
        table = finegray_expand(b, 1, "event_numeric", "time")
        return cox_fit(table, "fgstop", "fgstatus", ["age", "sex", "marker"], start="fgstart", weight="fgwt",
                       cluster="id").summary()
    finally:
        release()


@query("cox_degenerate", sql_with("cp", more="""
use AS (SELECT *, CAST(event_numeric = 1 AS INTEGER) AS died, 7 AS same, 2 * response + 1 AS twice FROM cp WHERE response IS NOT NULL),
told AS (SELECT count(DISTINCT same) = 1 AS constant, corr(response, twice) > 1 - 1e-12 AS repeated,
    min(died) FILTER (event_numeric = 1) > max(died) FILTER (event_numeric <> 1) AS separated FROM use)
""") + """
SELECT unnest(['died', 'same', 'response', 'twice']) AS term,
       CAST(unnest([FALSE, constant, FALSE, repeated]) AS BIGINT) AS aliased, CAST(NOT separated AS BIGINT) AS converged FROM told
""")
def cox_degenerate(spark, sf_dir):
    """A term that separates events from the rest, a constant one and one that repeats another."""
    cp = fx.cp(spark, sf_dir).withColumns({
        "died": (F.col("event_numeric") == 1).cast("int"), "same": F.lit(7), "twice": 2 * F.col("response") + 1})
    s = cox_fit(cp, "end_time", F.col("event_numeric") == 1, ["died", "same", "response", "twice"], start="start_time").summary()
    return s.select("term", F.col("coef").isNull().alias("aliased"), "converged")


@query("baseline_hazard", sql_with("cp", more="""
t AS (SELECT response, end_time AS time, count(*) AS m FROM cp WHERE event_numeric = 1 AND response IS NOT NULL GROUP BY 1, 2),
r AS (SELECT t.response, t.time, any_value(m) AS m, count(*) AS n FROM t
      JOIN cp c ON c.response = t.response AND c.start_time < t.time AND c.end_time >= t.time GROUP BY 1, 2)
""") + """
SELECT CAST(response AS BIGINT) AS response, time,
       round(sum(list_sum(list_transform(range(0, m), lambda l: 1.0::DOUBLE / (n - l))))
         OVER (PARTITION BY response ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS hazard
FROM r
""")
def baseline_hazard(spark, sf_dir):
    return cox_fit(fx.cp(spark, sf_dir), "end_time", F.col("event_numeric") == 1, [], start="start_time",
                   strata=["response"]).baseline_hazard()


# --- Fine-Gray --------------------------------------------------------------------------------


@query("finegray_binary", _cox_sql(
    ["basal"], _rows("basal", "sex", "event_numeric = 1", "0", "time", rival="event_numeric = 2"), "sex", tail=True))
def finegray_binary(spark, sf_dir):
    return finegray_fit(fx.basal(spark, sf_dir), "time", "event_numeric", 1, ["sex"], ties="breslow",
                        robust=False).summary().select(*_SHORT)


@query("finegray_timevarying_binary", _cox_sql(
    ["basal"], _rows("cp", "response", "event_numeric = 2", rival="event_numeric = 1"), "response", "efron", tail=True))
def finegray_timevarying_binary(spark, sf_dir):
    return finegray_fit(fx.cp(spark, sf_dir), "end_time", "event_numeric", 2, ["response"], start="start_time",
                        final="time", robust=False).summary().select(*_SHORT)


@query("finegray_fit", _fine_gray(BASE_TERMS, 1, "breslow"))
def finegray_query(spark, sf_dir):
    return finegray_fit(fx.basal(spark, sf_dir), "time", "event_numeric", 1, BASE_TERMS, id="id",
                        ties="breslow").summary()


@query("finegray_fit_timevarying", _fine_gray(
    MODEL_TERMS, 1, "efron", source="cp", a="start_time", b="end_time"))
def finegray_timevarying(spark, sf_dir):
    return finegray_fit(fx.cp(spark, sf_dir), "end_time", "event_numeric", 1, MODEL_TERMS, start="start_time",
                        final="time", id="id").summary()


@query("subdistribution_hazard", sql_with("basal", more=_G_SQL + """
t AS (SELECT response, end_time AS time, count(*) AS m FROM cp WHERE event_numeric = 1 AND response IS NOT NULL GROUP BY 1, 2),
r AS (SELECT response, time, any_value(m) AS m, sum(w) AS n FROM (
        SELECT t.*, 1.0::DOUBLE AS w FROM t JOIN cp c ON c.response = t.response AND c.start_time < t.time AND c.end_time >= t.time
        UNION ALL
        SELECT t.*, gt.g_before / gu.g_before FROM t JOIN cp c ON c.response = t.response AND c.event_numeric = 2 AND c.end_time < t.time
        JOIN g gt ON gt.time = t.time JOIN g gu ON gu.time = c.end_time) GROUP BY 1, 2)
""") + """
SELECT CAST(response AS BIGINT) AS response, time,
       round(sum(list_sum(list_transform(range(0, m), lambda l: 1.0::DOUBLE / (n - l))))
         OVER (PARTITION BY response ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS hazard
FROM r
""")
def subdistribution_hazard(spark, sf_dir):
    return finegray_fit(fx.cp(spark, sf_dir), "end_time", "event_numeric", 1, [], start="start_time", final="time",
                        strata=["response"]).baseline_hazard()


# --- landmarks ----------------------------------------------------------------------------------

_STACK_SQL = f"""
lm AS (SELECT unnest(range({_GRID[0]}, {_GRID[-1] + 1}, {_GRID[1] - _GRID[0]})) AS "LM"),
stack AS MATERIALIZED (SELECT "LM", "LM" AS "LM1", "LM" * "LM" AS "LM2", id, start_time,
    {', '.join(MODEL_TERMS)}, least(time, "LM" + {_HORIZON}) AS time,
    CASE WHEN time > "LM" + {_HORIZON} THEN 0 ELSE status END AS status
  FROM cp JOIN lm ON start_time < "LM" AND "LM" <= end_time AND time > "LM")
"""


_LM_FIT = {"source": "stack", "a": '"LM"', "b": "time", "pre": _STACK_SQL, "robust": True}
_LM_STRATA = {"terms": MODEL_TERMS, "d": "status = 1", "ties": "breslow", "st": '"LM"', **_LM_FIT}
_LM_POLY = {"terms": [*MODEL_TERMS, "LM1", "LM2"], "d": "status = 1", "ties": "breslow", **_LM_FIT}


def _stack(spark, sf_dir):
    return landmark_cut(fx.cp(spark, sf_dir), _GRID, _HORIZON, "status")


@query("landmark_cut", sql_with("cp", more=_STACK_SQL) + """
SELECT "LM", id, start_time, CAST(response AS BIGINT) AS response, time, CAST(status AS BIGINT) AS status,
       "LM" AS "Tstart", "LM" AS "LM1", "LM" * "LM" AS "LM2" FROM stack
""")
def cut_query(spark, sf_dir):
    return _stack(spark, sf_dir).select("LM", "id", "start_time", "response", "time", "status", "Tstart", "LM1", "LM2")


@query("landmark_cut_right", sql_with("cp", more=_STACK_SQL) + f"""
SELECT "LM", id, start_time, least(time, "LM" + {_HORIZON}) AS time,
       CAST(CASE WHEN time > "LM" + {_HORIZON} THEN 0 ELSE event_numeric END AS BIGINT) AS event_numeric
FROM cp JOIN lm ON start_time <= "LM" AND "LM" < end_time
""")
def cut_right(spark, sf_dir):
    """Inclusive cut, and the interval's own event code as status."""
    stack = landmark_cut(fx.cp(spark, sf_dir), _GRID, _HORIZON, "event_numeric", closed="right")
    return stack.select("LM", "id", "start_time", "time", "event_numeric")


@query("asof_join", sql_with("cp", more=_STACK_SQL) + """
SELECT "LM", id, start_time, round(marker, 6) AS marker FROM cp JOIN lm ON start_time < "LM"
QUALIFY row_number() OVER (PARTITION BY id, "LM" ORDER BY start_time DESC) = 1
""")
def asof_query(spark, sf_dir):
    cp = fx.cp(spark, sf_dir).select("id", "start_time", "marker")
    return asof_join(cp, _GRID, "id", "start_time")


@query("landmark_counts", sql_with("cp", more=_STACK_SQL) + """
SELECT "LM", CAST(response AS BIGINT) AS response, count(*) AS n FROM stack GROUP BY 1, 2
""")
def landmark_counts_query(spark, sf_dir):
    return landmark_counts(_stack(spark, sf_dir), "response")


@query("landmark_supermodel_binary", _cox_sql(
    ["cp"], """SELECT "LM" AS st, "LM" AS a, time AS b, CAST(status = 1 AS INTEGER) AS d, response AS x, id
    FROM stack WHERE response IS NOT NULL""", "response", cluster=True).replace(
        "rw AS MATERIALIZED", _STACK_SQL.strip() + ",\nrw AS MATERIALIZED", 1))
def landmark_binary(spark, sf_dir):
    return landmark_supermodel(_stack(spark, sf_dir), ["response"], F.col("status") == 1, "id").summary().select(
        *_SHORT, "robust_se")


@query("landmark_supermodel", _fit(**_LM_STRATA))
def supermodel_query(spark, sf_dir):
    return landmark_supermodel(_stack(spark, sf_dir), MODEL_TERMS, F.col("status") == 1, "id").summary()


@query("landmark_supermodel_poly", _fit(**_LM_POLY))
def supermodel_poly(spark, sf_dir):
    return landmark_supermodel(_stack(spark, sf_dir), MODEL_TERMS, F.col("status") == 1, "id", form="poly").summary()


# --- multi-state -----------------------------------------------------------------------------------

_STATE_SQL = """
st AS (SELECT *, CASE WHEN marker >= 1.5 THEN 'Non-responding' WHEN marker < 1.5 THEN 'Responding' END AS "from" FROM cp),
nx AS (SELECT *, coalesce(CASE event_numeric WHEN 1 THEN 'Dead' WHEN 2 THEN 'Transplant' END,
                          lead("from") OVER (PARTITION BY id ORDER BY start_time), "from") AS to_event FROM st),
tmat AS (SELECT * FROM (VALUES ('Non-responding', 'Responding', 1), ('Non-responding', 'Transplant', 2),
  ('Non-responding', 'Dead', 3), ('Responding', 'Non-responding', 4), ('Responding', 'Transplant', 5),
  ('Responding', 'Dead', 6)) t("from", "to", trans)),
ms AS MATERIALIZED (SELECT nx.*, "to", trans, CAST("to" = to_event AS INTEGER) AS status2 FROM nx JOIN tmat USING ("from"))
"""
_HAZ_SQL = _STATE_SQL + """,
tt AS (SELECT trans, "from", "to", end_time AS time, count(*) FILTER (status2 = 1) AS d FROM ms GROUP BY 1, 2, 3, 4),
hz AS MATERIALIZED (SELECT tt.trans, tt."from", tt."to", tt.time, any_value(tt.d) AS d, count(*) AS n FROM tt
  JOIN ms ON ms.trans = tt.trans AND ms.start_time < tt.time AND ms.end_time >= tt.time GROUP BY 1, 2, 3, 4)
"""


def _multistate(spark, sf_dir):
    cp = fx.cp(spark, sf_dir)
    state = F.when(F.col("marker") >= fx.THRESHOLD, "Non-responding").when(
        F.col("marker") < fx.THRESHOLD, "Responding")
    end = F.when(F.col("event_numeric") == 1, CAUSES[1]).when(F.col("event_numeric") == 2, CAUSES[2])
    return expand_transitions(assign_states(cp, state, "id", ["start_time"], end), transition_matrix(spark, STATES))


@query("expand_transitions", sql_with("cp", more=_STATE_SQL) + """
SELECT id, start_time, end_time, "from", "to", to_event, CAST(trans AS BIGINT) AS trans, CAST(status2 AS BIGINT) AS status FROM ms
""")
def expand_query(spark, sf_dir):
    return _multistate(spark, sf_dir).select(
        "id", "start_time", "end_time", "from", "to", "to_event", "trans", "status")


@query("transition_counts", sql_with("cp", more=_STATE_SQL) + """
SELECT "from", to_event, count(*) AS n FROM nx WHERE "from" IS NOT NULL GROUP BY 1, 2
""")
def transition_counts(spark, sf_dir):
    rows = _multistate(spark, sf_dir).where(F.col("to").isin("Dead"))
    return rows.groupBy("from", "to_event").agg(F.count("*").alias("n"))


@query("transition_hazards", sql_with("cp", more=_HAZ_SQL) + """
SELECT CAST(trans AS BIGINT) AS trans, "from", "to", time, n AS n_risk, d AS n_event,
       round(sum(d / n) OVER (PARTITION BY trans ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS hazard
FROM hz
""")
def hazards_query(spark, sf_dir):
    return transition_hazards(_multistate(spark, sf_dir))


def _probability_sql(from_time):
    return sql_with("cp", recursive=True, more=_HAZ_SQL + f""",
da AS MATERIALIZED (SELECT row_number() OVER (ORDER BY time) AS k, * FROM (SELECT time,
    sum(CASE trans WHEN 1 THEN d / n ELSE 0 END) AS a1, sum(CASE trans WHEN 2 THEN d / n ELSE 0 END) AS a2,
    sum(CASE trans WHEN 3 THEN d / n ELSE 0 END) AS a3, sum(CASE trans WHEN 4 THEN d / n ELSE 0 END) AS a4,
    sum(CASE trans WHEN 5 THEN d / n ELSE 0 END) AS a5, sum(CASE trans WHEN 6 THEN d / n ELSE 0 END) AS a6
  FROM hz WHERE d > 0 AND time > {from_time} GROUP BY time)),
pr(k, src, p1, p2, p3, p4) AS (
  SELECT 0::BIGINT, s.src, s.p1, s.p2, 0.0::DOUBLE, 0.0::DOUBLE
  FROM (VALUES ('Non-responding', 1.0::DOUBLE, 0.0::DOUBLE), ('Responding', 0.0::DOUBLE, 1.0::DOUBLE)) s(src, p1, p2)
  UNION ALL
  SELECT da.k, pr.src, p1 * (1 - a1 - a2 - a3) + p2 * a4, p2 * (1 - a4 - a5 - a6) + p1 * a1,
         p3 + p1 * a2 + p2 * a5, p4 + p1 * a3 + p2 * a6
  FROM pr JOIN da ON da.k = pr.k + 1)
""") + """
SELECT da.time, round(unnest([p3, p4]), 6) AS prob, src AS "from", unnest(['Transplant', 'Death']) AS outcome
FROM pr JOIN da ON da.k = pr.k
"""

@query("transition_probabilities", _probability_sql(0))
def probabilities_query(spark, sf_dir):
    probs = transition_probabilities(transition_hazards(_multistate(spark, sf_dir)), STATES)
    return probabilities_long(probs, ["Transplant", "Dead"], ["Non-responding", "Responding"], {"Dead": "Death"})


@query("transition_probabilities_restarted", _probability_sql(180))
def probabilities_restarted(spark, sf_dir):
    """From a landmark on, with the axis cut although it is short: blocks of chunks and the chunks of a block."""
    hazards = transition_hazards(_multistate(spark, sf_dir))
    probs = transition_probabilities(hazards, STATES, from_time=180, splits=[200, 260, 330, 400, 500, 650, 800, 1000, 1300])
    return probabilities_long(probs, ["Transplant", "Dead"], ["Non-responding", "Responding"], {"Dead": "Death"})


@query("transition_cox_binary", _cox_sql(
    ["cp"], "SELECT 0 AS st, start_time AS a, end_time AS b, status2 AS d, sex AS x, id FROM ms WHERE trans = 1",
    "sex").replace("rw AS MATERIALIZED", _STATE_SQL.strip() + ",\nrw AS MATERIALIZED", 1))
def transition_cox_binary(spark, sf_dir):
    return transition_cox(_multistate(spark, sf_dir), ["sex"], [1])[1].summary().select(*_SHORT)


def _transition_fit(trans, **more) -> str:
    return _fit(BASE_TERMS, "status2 = 1", "breslow", source=f"(SELECT * FROM ms WHERE trans = {trans})", pre=_STATE_SQL, **more)


@query("transition_cox", " UNION ALL ".join(
    f"SELECT {t}::BIGINT AS trans, * FROM ({_transition_fit(t)})" for t in (3, 6, 2, 5, 1)))
def transition_cox_query(spark, sf_dir):
    """Models of the five reported transitions."""
    rows, release = materialize(_multistate(spark, sf_dir))
    models = transition_cox(rows, BASE_TERMS, [3, 6, 2, 5, 1])
    release()
    out = None
    for trans, model in models.items():
        part = model.summary().withColumn("trans", F.lit(trans))
        out = part if out is None else out.unionByName(part)
    return out


# --- reports ---------------------------------------------------------------------------------------


def _side_by_side(blocks: dict[str, str]) -> str:
    cols = ", ".join(f"max({c}) FILTER (ep = '{ep}') AS {ep}_{c}" for ep in blocks for c in ("hr", "lower", "upper"))
    stacked = " UNION ALL ".join(f"SELECT '{ep}' AS ep, * FROM ({sql})" for ep, sql in blocks.items())
    return f"SELECT term, {cols} FROM ({stacked}) GROUP BY term"


@query("endpoint_table", _side_by_side({
    ep: _fit(MODEL_TERMS, d, "efron") for ep, d in {
        "death": "event_numeric = 1", "transplant": "event_numeric = 2", "either": "event_numeric > 0"}.items()}))
def endpoint_query(spark, sf_dir):
    """Cause-specific time-varying models of the three endpoints, side by side."""
    cp, release = materialize(fx.cp(spark, sf_dir))
    event = F.col("event_numeric")

    def fit(hit):
        return lambda: cox_fit(cp, "end_time", hit, MODEL_TERMS, start="start_time")

    models = fit_together({"death": fit(event == 1), "transplant": fit(event == 2), "either": fit(event > 0)})
    release()
    return endpoint_table(models)


@query("endpoint_table_finegray", _side_by_side({
    "death": _fine_gray(BASE_TERMS, 1, "breslow"), "transplant": _fine_gray(BASE_TERMS, 2, "breslow"),
    "either": _fine_gray(BASE_TERMS, 1, "breslow", event="CAST(event_numeric > 0 AS INTEGER)")}))
def endpoint_finegray(spark, sf_dir):
    """Subdistribution models of the three endpoints on first-visit covariates."""
    b, release = materialize(combined_endpoint(fx.basal(spark, sf_dir), "event_numeric", [1, 2], "either"))

    def fit(event, cause):
        return lambda: finegray_fit(b, "time", event, cause, BASE_TERMS, id="id", ties="breslow")

    models = fit_together({"death": fit("event_numeric", 1), "transplant": fit("event_numeric", 2),
                           "either": fit("either", 1)})
    release()
    return endpoint_table(models)


@query("endpoint_table_basal", _side_by_side({
    ep: _fit(BASE_TERMS, d, "efron", source="basal", a="0", b="time", views=("basal",)) for ep, d in {
        "death": "event_numeric = 1", "transplant": "event_numeric = 2", "either": "event_numeric > 0"}.items()}))
def endpoint_basal(spark, sf_dir):
    """Cause-specific models of the three endpoints on first-visit covariates."""
    b, release = materialize(fx.basal(spark, sf_dir))
    event = F.col("event_numeric")

    def fit(hit):
        return lambda: cox_fit(b, "time", hit, BASE_TERMS)

    models = fit_together({"death": fit(event == 1), "transplant": fit(event == 2), "either": fit(event > 0)})
    release()
    return endpoint_table(models)


_VARYING = {"source": "cp", "a": "start_time", "b": "end_time"}


@query("endpoint_table_finegray_timevarying", _side_by_side({
    "death": _fine_gray(MODEL_TERMS, 1, "efron", **_VARYING), "transplant": _fine_gray(MODEL_TERMS, 2, "efron", **_VARYING),
    "either": _fine_gray(MODEL_TERMS, 1, "efron", event="CAST(event_numeric > 0 AS INTEGER)", **_VARYING)}))
def endpoint_finegray_varying(spark, sf_dir):
    """Subdistribution models of the three endpoints on time-varying covariates."""
    cp, release = materialize(combined_endpoint(fx.cp(spark, sf_dir), "event_numeric", [1, 2], "either"))

    def fit(event, cause):
        return lambda: finegray_fit(cp, "end_time", event, cause, MODEL_TERMS, start="start_time", final="time", id="id")

    models = fit_together({"death": fit("event_numeric", 1), "transplant": fit("event_numeric", 2),
                           "either": fit("either", 1)})
    release()
    return endpoint_table(models)


_LM_HITS = {"death": "status = 1", "transplant": "status = 2", "either": "status > 0"}


def _landmark_table(spark, sf_dir, form):
    stack, release = materialize(_stack(spark, sf_dir))

    def fit(hit):
        return lambda: landmark_supermodel(stack, MODEL_TERMS, F.expr(hit), "id", form=form)

    models = fit_together({ep: fit(hit) for ep, hit in _LM_HITS.items()})
    release()
    return endpoint_table(models)


@query("landmark_table", _side_by_side({ep: _fit(**_LM_STRATA | {"d": hit}) for ep, hit in _LM_HITS.items()}))
def landmark_table(spark, sf_dir):
    """Super-models with a baseline per landmark, the three endpoints side by side."""
    return _landmark_table(spark, sf_dir, "strata")


@query("landmark_table_poly", _side_by_side({ep: _fit(**_LM_POLY | {"d": hit}) for ep, hit in _LM_HITS.items()}))
def landmark_table_poly(spark, sf_dir):
    """Super-models with terms of the landmark time, the three endpoints side by side."""
    return _landmark_table(spark, sf_dir, "poly")


_TEXT = "printf('%.2f', round_even(hr, 2)) || CASE WHEN p < 0.05 THEN '*' ELSE '' END"


@query("significance_mark", _fit(
    BASE_TERMS, "event_numeric = 1", "efron", source="basal", a="0", b="time", views=("basal",),
    select=f"term, round(hr, 6) AS hr, round(p, 6) AS p, CAST(p < 0.05 AS BIGINT) AS significant, {_TEXT} AS text"))
def significance_query(spark, sf_dir):
    s = cox_fit(fx.basal(spark, sf_dir), "time", F.col("event_numeric") == 1, BASE_TERMS).summary()
    return significance_mark(s).select("term", "hr", "p", "significant", "text")


def _all_models_sql() -> str:
    pick = f"term, {_TEXT} AS text"
    blocks = {
        "basal_subdistribution": _fine_gray(BASE_TERMS, 1, "breslow", select=pick),
        "basal_cause_specific": _fit(BASE_TERMS, "event_numeric = 1", "efron", source="basal", a="0", b="time",
                                     views=("basal",), select=pick),
        "varying_subdistribution": _fine_gray(MODEL_TERMS, 1, "efron", source="cp", a="start_time", b="end_time",
                                              select=pick),
        "varying_cause_specific": _fit(MODEL_TERMS, "event_numeric = 1", "efron", select=pick),
        "landmark_1": _fit(**_LM_STRATA, select=pick),
        "landmark_2": _fit(**_LM_POLY, select=pick),
        "from_non_responding": _transition_fit(3, select=pick),
        "from_responding": _transition_fit(6, select=pick),
    }
    cols = ", ".join(f"coalesce(max(text) FILTER (model = '{m}'), '') AS {m}" for m in blocks)
    stacked = " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({sql})" for m, sql in blocks.items())
    label = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
    return f"SELECT term, CASE term {label} ELSE term END AS label, {cols} FROM ({stacked}) GROUP BY term"


@query("all_models_table", _all_models_sql())
def all_models(spark, sf_dir):
    """Every model of the first outcome, one row per term; the cohort is built once."""
    cp, release = materialize(fx.cp(spark, sf_dir))
    basal = baseline_rows(cp, "id", "status")
    death = F.col("event_numeric") == 1
    stack = landmark_cut(cp, _GRID, _HORIZON, "status")
    state = F.when(F.col("marker") >= fx.THRESHOLD, "Non-responding").when(
        F.col("marker") < fx.THRESHOLD, "Responding")
    end = F.when(death, CAUSES[1]).when(F.col("event_numeric") == 2, CAUSES[2])
    multi = expand_transitions(assign_states(cp, state, "id", ["start_time"], end), transition_matrix(spark, STATES))

    def transition(number):
        return lambda: transition_cox(multi, BASE_TERMS, [number])[number]

    models = fit_together({
        "basal_subdistribution": lambda: finegray_fit(
            basal, "time", "status", 1, BASE_TERMS, id="id", ties="breslow"),
        "basal_cause_specific": lambda: cox_fit(basal, "time", F.col("status") == 1, BASE_TERMS),
        "varying_subdistribution": lambda: finegray_fit(
            cp, "end_time", "event_numeric", 1, MODEL_TERMS, start="start_time", final="time", id="id"),
        "varying_cause_specific": lambda: cox_fit(cp, "end_time", death, MODEL_TERMS, start="start_time"),
        "landmark_1": lambda: landmark_supermodel(stack, MODEL_TERMS, F.col("status") == 1, "id"),
        "landmark_2": lambda: landmark_supermodel(stack, MODEL_TERMS, F.col("status") == 1, "id", form="poly"),
        "from_non_responding": transition(3),
        "from_responding": transition(6),
    })
    release()
    return all_models_table(models, labels=LABELS)
