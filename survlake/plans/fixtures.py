"""A cohort built from the order tables, in Spark and as SQL text.

A customer is a subject, an order day a visit. Each view below has a Spark
builder and, under the same name in ``SQL``, the query that defines it for the
oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import wall_micros
from ..operators.longitudinal import baseline_rows, counting_process, locf
from ..operators.scan import hour_chunk, next_value
from ..sources.io import read_table

# fixed values of the fixture
PULSE_UNKNOWN = -99          # sentinel of the pulse measure
THRESHOLD = 1.5              # response: marker below this
LINES_PER_TASK = 500_000     # lines reshaped by one task
MODEL_TERMS = ["age", "sex", "response", "marker", "pulse", "prio", "urgent", "seg_b", "seg_f", "seg_h", "seg_m"]
BASE_TERMS = [t for t in MODEL_TERMS if t != "response"]
LABELS = {
    "age": "Age (yr)", "sex": "Sex", "response": "Response to treatment", "marker": "Marker (mg/dL)",
    "pulse": "Pulse (bpm)", "prio": "Priority", "urgent": "Urgent", "seg_b": "Segment - Building",
    "seg_f": "Segment - Furniture", "seg_h": "Segment - Household", "seg_m": "Segment - Machinery",
    "LM1": "s", "LM2": "s^2",
}
STATES = {
    "Non-responding": ["Responding", "Transplant", "Dead"],
    "Responding": ["Non-responding", "Transplant", "Dead"],
    "Transplant": [],
    "Dead": [],
}
CAUSES = {1: "Dead", 2: "Transplant"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject and day, the smallest order key wins.

    ``min_by`` on numbers is a hash aggregate that combines before the shuffle:
    a subject with very many orders sends one row per day and map task, and at
    most one row per day is left.
    """
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("visitdt"), key, "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(0).alias("code"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"))
    picked = o.groupBy("id", "visitdt").agg(F.min(key).alias("visit_key"), *[
        F.min_by(c, key).alias(c) for c in ("code", "prio", "o_totalprice")])
    key = F.col("visit_key")
    return picked.select(
        "id", "visitdt", "visit_key", "code",
        F.when(key % 7 != 0, F.floor(F.col("o_totalprice") / 10) / 10000).alias("marker"),
        F.when(key % 11 == 0, PULSE_UNKNOWN).otherwise((key % 97).cast("int")).alias("pulse"), "prio")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    seg = {"b": "BUILDING", "f": "FURNITURE", "h": "HOUSEHOLD", "m": "MACHINERY"}
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") % 2 == 0, "A").otherwise("B").alias("cohort"),
        (F.floor("c_acctbal") / 100).alias("age"),
        (F.col("c_nationkey") % 2).alias("sex"),
        *[(F.col("c_mktsegment") == v).cast("int").alias(f"seg_{k}") for k, v in seg.items()])


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits after carry-forward, with origin, final date and final status."""
    v = visits(spark, sf_dir)
    v = locf(v, "id", ["visitdt"], ["marker", "pulse"], sentinels={"pulse": [PULSE_UNKNOWN]})
    # same partitioning and order as the carry-forward: no further shuffle
    whole = Window.partitionBy("id").orderBy("visitdt").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    out = v.withColumns({
        "origin": F.first("visitdt").over(whole), "final": F.last("visitdt").over(whole),
        "status": F.last("code").over(whole)})
    out = out.withColumns({
        "response": (F.col("marker") < THRESHOLD).cast("int"),
        "urgent": (F.col("prio") <= 2).cast("int")})
    return out.join(subjects(spark, sf_dir), "id", "left")


def cp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting_process(analysis(spark, sf_dir), "id", "visitdt", "origin", "final", "status")


def basal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_rows(cp(spark, sf_dir), "id", "status")


def treatment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment spans: start is the ship date, the end is open for line 7."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    begin = F.to_date("l_shipdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("id"), begin.alias("tr_start"),
        F.when(F.col("l_linenumber") != 7, F.date_add(begin, F.col("l_linenumber") * 10)).alias("tr_end"),
        F.col("l_returnflag").alias("indication"), F.col("l_linenumber").alias("line"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with ``qty_1 … qty_7`` and ``net_price_1 … net_price_7``.

    A task holds the orders of about so many lines, however large the table is: the
    rows are dealt by order into as many parts (the count reads file footers only).
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_quantity", "l_extendedprice")
    parts = max(spark.sparkContext.defaultParallelism, -(-li.count() // LINES_PER_TASK))
    return li.repartition(parts, "id").groupBy("id").agg(*[
        F.max(F.when(F.col("l_linenumber") == i, F.col(c))).alias(f"{name}_{i}")
        for name, c in (("qty", "l_quantity"), ("net_price", "l_extendedprice")) for i in range(1, 8)])


def vials(spark: SparkSession, sf_dir: str, event_type: str, out: str) -> DataFrame:
    """Sample list: events of one type per user and day."""
    return (table(spark, sf_dir, "events").where(F.col("event_type") == event_type)
            .groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias(out)))


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between a user's events in microseconds; the event is a purchase at the end.

    Users are few and their events many, so neighbours are found in hour chunks.
    """
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    e = next_value(e, "user_id", ["ts", "event_id"], {"next_ts": "ts", "next_type": "event_type"},
                   hour_chunk("ts"))
    return e.where(F.col("next_ts").isNotNull()).select(
        F.col("user_id").alias("id"), "event_type",
        wall_micros("ts").alias("start"), wall_micros("next_ts").alias("stop"),
        (F.col("next_type") == "purchase").cast("int").alias("status")).where(F.col("start") < F.col("stop"))


# --- the same views for the oracle ----------------------------------------

_VIEWS = {
    "visits": """
  SELECT o.o_custkey AS id, k.visitdt, o.o_orderkey AS visit_key,
         CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS code,
         CASE WHEN o.o_orderkey % 7 <> 0 THEN floor(o.o_totalprice / 10) / 10000 END AS marker,
         CASE WHEN o.o_orderkey % 11 = 0 THEN -99 ELSE o.o_orderkey % 97 END AS pulse,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS prio
  FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS visitdt, min(o_orderkey) AS k
        FROM orders GROUP BY 1, 2) k
  JOIN orders o ON o.o_orderkey = k.k AND o.o_custkey = k.o_custkey""",
    "subjects": """
  SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS cohort,
         floor(c_acctbal) / 100 AS age, c_nationkey % 2 AS sex,
         CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS seg_b, CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS seg_f,
         CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS seg_h, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS seg_m
  FROM customer""",
    "filled": """
  SELECT id, visitdt, visit_key, code, prio,
         last_value(marker IGNORE NULLS) OVER w AS marker,
         last_value(nullif(pulse, -99) IGNORE NULLS) OVER w AS pulse
  FROM visits WINDOW w AS (PARTITION BY id ORDER BY visitdt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "analysis": """
  SELECT f.*, e.origin, e.final, e.status, CAST(f.marker < 1.5 AS INTEGER) AS response,
         CAST(f.prio <= 2 AS INTEGER) AS urgent, s.cohort, s.age, s.sex, s.seg_b, s.seg_f, s.seg_h, s.seg_m
  FROM filled f
  JOIN (SELECT id, min(visitdt) AS origin, max(visitdt) AS final, arg_max(code, visitdt) AS status
        FROM filled GROUP BY id) e USING (id)
  LEFT JOIN subjects s USING (id)""",
    "cp": """
  SELECT *, date_diff('day', origin, final) AS time, date_diff('day', origin, visitdt) AS start_time,
         date_diff('day', origin, post_date) AS end_time,
         CASE WHEN post_date = final THEN status ELSE 0 END AS event_numeric
  FROM (SELECT *, coalesce(lead(visitdt) OVER (PARTITION BY id ORDER BY visitdt), final) AS post_date
        FROM analysis) WHERE visitdt <> final""",
    "basal": """
  SELECT * REPLACE (status AS event_numeric) FROM cp
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY start_time) = 1""",
    "treatment": """
  SELECT o_custkey AS id, CAST(l_shipdate AS DATE) AS tr_start,
         CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) + 10 * l_linenumber END AS tr_end,
         l_returnflag AS indication, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "wide": "\n  SELECT l_orderkey AS id, " + ", ".join(
        f"max(CASE WHEN l_linenumber = {i} THEN {c} END) AS {n}_{i}"
        for n, c in (("qty", "l_quantity"), ("net_price", "l_extendedprice")) for i in range(1, 8))
    + "\n  FROM lineitem GROUP BY 1",
    "spells": """
  SELECT id, event_type, start, stop, CAST(next_type = 'purchase' AS INTEGER) AS status
  FROM (SELECT user_id AS id, event_type, epoch_us(ts) AS start,
               epoch_us(lead(ts) OVER w) AS stop, lead(event_type) OVER w AS next_type
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  WHERE stop IS NOT NULL AND start < stop""",
}
_NEEDS = {
    "filled": ["visits"], "analysis": ["filled", "subjects"], "cp": ["analysis"], "basal": ["cp"],
}


def sql_with(*views: str, recursive: bool = False, more: str = "") -> str:
    """``WITH`` clause that defines the given views and what they need."""
    order: list[str] = []

    def add(name):
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    parts = [f"{n} AS MATERIALIZED ({_VIEWS[n]})" for n in order]
    if more:
        parts.append(more.strip())
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
