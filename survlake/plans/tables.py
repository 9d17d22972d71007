"""Queries of the table operators: columns, filters, joins, reshape."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import (
    FIRST_TOKEN,     any_by_subject, any_flag, apply_labels, check_unique, dedupe_by_key, diagnostic_visit, drop_work,
    final_event_date, first_match_rows, first_per_group, flag_when, gather, interval_join,
    last_per_group, le_missing_low, locf, long_to_wide, lookup_neighbor, lt_missing_low, merge_full,
    merge_left, merge_left_many, neighbor_visits, nullify, override, read_table, recode, rename_all,
    response_label, round_even, select_numbered, select_prefix, try_number, union_cohorts,
    treatment_onsets, vanished_subjects, wide_to_long, write_table,
)
from ..operators.reshape import number_visits
from ..operators.scan import day_chunk, hour_chunk
from . import fixtures as fx
from .fixtures import sql_with, table
from .registry import query

# fixed values: codes and labels of the fixture
PRIORITY_CODES = {"1-URGENT": "P1", "2-HIGH": "P2", "3-MEDIUM": "P3"}
LINE_VISITS = {1: "IN", 2: "D8", 3: "AD0", 4: "AD8", 5: "FU", 6: "FU"}
STATUS_LABELS = {"F": "Dead", "P": "Transplant", "O": "Censored"}

LINEITEM_SCHEMA = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp")


# --- scans, sinks, projections ------------------------------------------------


@query("scan_filter_project", """
SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS visit, round(l_quantity, 6) AS qty,
       round(l_extendedprice, 6) AS price, 'A' AS tag, 1 AS sampled
FROM lineitem
WHERE l_shipdate >= DATE '1999-01-01' AND l_returnflag IN ('A', 'R') AND l_linenumber NOT IN (6, 7)
  AND l_quantity <= 25 AND l_linestatus = 'F'
""")
def scan_filter_project(spark, sf_dir):
    li = read_table(spark, f"{sf_dir}/lineitem.parquet", LINEITEM_SCHEMA)
    li = li.where((F.col("l_shipdate") >= "1999-01-01") & F.col("l_returnflag").isin("A", "R")
                  & ~F.col("l_linenumber").isin(6, 7) & (F.col("l_quantity") <= 25)
                  & (F.col("l_linestatus") == "F"))
    li = rename_all(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), {
        "l_orderkey": "id", "l_linenumber": "visit", "l_quantity": "qty", "l_extendedprice": "price"})
    return li.withColumns({"tag": F.lit("A"), "sampled": F.lit(1)})


@query("select_columns", sql_with("wide") + """
SELECT id, net_price_1, net_price_2, net_price_3, net_price_4, net_price_5, net_price_6, net_price_7,
       qty_1, qty_2, qty_3 FROM wide
""")
def select_columns(spark, sf_dir):
    w = fx.wide(spark, sf_dir)
    return merge_left(select_prefix(w, ["id"], ["net_price_"]), select_numbered(w, ["id"], "qty_", 3), ["id"])


@query("write_read_roundtrip", """
SELECT c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS c_name
FROM customer
""")
def write_read_roundtrip(spark, sf_dir):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared}/roundtrip-{spark.sparkContext.applicationId}"
    c = table(spark, sf_dir, "customer").withColumn(
        "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_name")))
    write_table(c, f"{path}/parquet")
    write_table(read_table(spark, f"{path}/parquet"), f"{path}/csv", "csv")
    back = read_table(spark, f"{path}/csv", c.schema, "csv", null_mark="")
    back.createOrReplaceTempView("roundtrip_work")
    drop_work(spark, "roundtrip_work")
    return back


@query("override_record", sql_with("subjects") + """
SELECT id, cohort, CAST(CASE WHEN age < 0 THEN 1 ELSE sex END AS BIGINT) AS sex,
       CASE WHEN age < 0 THEN 0.0 ELSE round(age, 6) END AS age
FROM subjects
""")
def override_record(spark, sf_dir):
    s = fx.subjects(spark, sf_dir).select("id", "cohort", "sex", "age")
    fixes = s.where("age < 0").select("id", F.lit(1).alias("sex"), F.lit(0.0).alias("age"))
    return override(s, fixes, ["id"], ["sex", "age"])


@query("recode_labels", """
SELECT l.l_orderkey AS id, CAST(l.l_linenumber AS BIGINT) AS visit_code,
       CASE l.l_linenumber WHEN 1 THEN 'IN' WHEN 2 THEN 'D8' WHEN 3 THEN 'AD0' WHEN 4 THEN 'AD8'
                           WHEN 5 THEN 'FU' WHEN 6 THEN 'FU' END AS visit,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'P1' WHEN '2-HIGH' THEN 'P2' WHEN '3-MEDIUM' THEN 'P3'
                              ELSE o.o_orderpriority END AS prio,
       CASE o.o_orderstatus WHEN 'F' THEN 'Dead' WHEN 'P' THEN 'Transplant' WHEN 'O' THEN 'Censored' END AS label,
       CASE l.l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS yes_no, n.n_name AS nation
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
""")
def recode_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                                  F.col("n_name").alias("nation"))
    df = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    df = merge_left(df, names, ["c_nationkey"])
    df = recode(df, "l_linenumber", LINE_VISITS, default="null", out="visit")
    df = recode(df, "o_orderpriority", PRIORITY_CODES, out="prio")
    df = recode(df, "l_linestatus", {"F": 1, "O": 0}, default="null", out="yes_no")
    df = apply_labels(df, "o_orderstatus", STATUS_LABELS)
    return df.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("visit_code"),
                     "visit", "prio", "label", "yes_no", "nation")


@query("null_rules", sql_with("visits") + """
SELECT id, CAST(visitdt AS VARCHAR) AS visitdt, pulse_clean, pulse_filled, low, not_above, raised,
       any_high, kept, in_range
FROM (
  SELECT id, visitdt, CAST(nullif(pulse, -99) AS BIGINT) AS pulse_clean,
         CAST(coalesce(nullif(pulse, -99), 0) AS BIGINT) AS pulse_filled,
         CAST((marker IS NULL AND nullif(pulse, -99) IS NOT NULL)
              OR coalesce(marker * 50 < nullif(pulse, -99), FALSE) AS BIGINT) AS low,
         CAST(marker IS NULL OR coalesce(marker * 50 <= nullif(pulse, -99), FALSE) AS BIGINT) AS not_above,
         CAST(marker >= 1.5 AS BIGINT) AS raised,
         CAST(coalesce(marker > 4, FALSE) OR coalesce(nullif(pulse, -99) > 90, FALSE) AS BIGINT) AS any_high,
         CAST(NOT (prio = 5 AND marker IS NULL AND nullif(pulse, -99) IS NULL) AS BIGINT) AS kept,
         CAST(coalesce(prio <= nullif(pulse, -99) AND nullif(pulse, -99) <= 50, FALSE) AS BIGINT) AS in_range,
         code
  FROM visits)
WHERE code <> 0 AND (pulse_clean IS NULL OR pulse_clean <> 13)
""")
def null_rules(spark, sf_dir):
    v = nullify(fx.visits(spark, sf_dir).withColumn("pulse_clean", F.col("pulse")), ["pulse_clean"], [-99])
    scaled = F.col("marker") * 50
    clean = F.col("pulse_clean")
    v = v.withColumns({
        "pulse_filled": F.coalesce(clean, F.lit(0)),
        "low": lt_missing_low(scaled, clean).cast("int"),
        "not_above": le_missing_low(scaled, clean).cast("int"),
        "raised": flag_when(F.col("marker") >= 1.5),
        "any_high": any_flag((F.col("marker") > 4).cast("int"), (clean > 90).cast("int")),
        "kept": (~F.coalesce((F.col("prio") == 5) & F.col("marker").isNull() & clean.isNull(),
                             F.lit(False))).cast("int"),
        "in_range": F.coalesce(clean.between(F.col("prio"), 50), F.lit(False)).cast("int"),
    })
    return v.where((F.col("code") != 0) & (clean.isNull() | (clean != 13))).select(
        "id", "visitdt", "pulse_clean", "pulse_filled", "low", "not_above", "raised",
        "any_high", "kept", "in_range")


@query("derived_measures", """
SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS line, round(l_quantity * 1.5 + l_linenumber * 0.5, 6) AS volume,
       CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount * 100, 6) END AS ratio_pct,
       CAST(l_linenumber * l_linenumber AS BIGINT) AS line_sq,
       date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days,
       l_returnflag || '-' || l_linestatus AS pair, regexp_replace(o_orderpriority, '^[0-9]-', '') AS prio_text,
       round(round_even(l_quantity / 4, 1), 6) AS quarter
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def derived_measures(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("id"), n.alias("line"), (q * 1.5 + n * 0.5).alias("volume"),
        F.try_divide("l_tax", "l_discount").alias("_r"), (n * n).alias("line_sq"),
        F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long").alias("days"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("pair"),
        F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("prio_text"),
        round_even(q / 4, 1).alias("quarter")).withColumn("ratio_pct", F.col("_r") * 100).drop("_r")


@query("type_conversion", """
SELECT event_id, round(try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), 6) AS num,
       round(try_cast(event_type AS DOUBLE), 6) AS not_num, CAST(CAST(round(value) AS BIGINT) AS VARCHAR) AS txt
FROM events
""")
def type_conversion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("num"),
        F.col("event_type").alias("not_num"),
        F.format_string("%d", F.round("value").cast("long")).alias("txt"))
    return try_number(e, ["num", "not_num"])


# --- joins -------------------------------------------------------------------

_VIAL_SQL = """a AS (SELECT user_id AS id, CAST(ts AS DATE) AS day, count(*) AS n_15 FROM events
      WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT user_id AS id, CAST(ts AS DATE) AS day, count(*) AS n_5 FROM events
      WHERE event_type = 'purchase' GROUP BY 1, 2),
inv AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.day, b.day) AS day, coalesce(n_15, 0) AS n_15,
               coalesce(n_5, 0) AS n_5
        FROM a FULL JOIN b ON a.id = b.id AND a.day = b.day)"""


def _inventory(spark, sf_dir):
    a = fx.vials(spark, sf_dir, "click", "n_15")
    b = fx.vials(spark, sf_dir, "purchase", "n_5")
    inv = merge_full(a, b, ["id", "day"], unique=True).fillna(0, ["n_15", "n_5"])
    return inv.withColumns({"total_ml": F.col("n_15") * 1.5 + F.col("n_5") * 0.5, "sampled": F.lit(1)})


@query("sample_inventory", f"""WITH {_VIAL_SQL}
SELECT id, CAST(day AS VARCHAR) AS day, n_15, n_5, round(CAST(n_15 * 1.5 + n_5 * 0.5 AS DOUBLE), 6) AS total_ml, 1 AS sampled,
       CASE WHEN n_15 + n_5 > 1 THEN 'many' ELSE 'one' END AS amount
FROM inv
""")
def sample_inventory(spark, sf_dir):
    inv = _inventory(spark, sf_dir)
    return inv.withColumn("amount", F.when(F.col("n_15") + F.col("n_5") > 1, "many").otherwise("one"))


@query("merge_full_overwrite", """
WITH a AS (SELECT l_orderkey AS id, max(l_quantity) AS v, count(*) AS na FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_orderkey AS id, max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS v, count(*) AS nb
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, round(CASE WHEN b.id IS NOT NULL THEN b.v ELSE a.v END, 6) AS v, na, nb
FROM a FULL JOIN b ON a.id = b.id
""")
def merge_full_overwrite(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    a = li.where("l_returnflag = 'A'").groupBy("id").agg(F.max("l_quantity").alias("v"), F.count("*").alias("na"))
    b = li.where("l_returnflag = 'R'").groupBy("id").agg(
        F.max(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("v"), F.count("*").alias("nb"))
    return merge_full(a, b, ["id"], unique=True)


@query("check_unique", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS count
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def unique_keys(spark, sf_dir):
    return check_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("attach_measures", sql_with("visits", "subjects", more="""
m AS (SELECT l_orderkey AS visit_key, sum(l_quantity) AS qty, max(l_discount) AS disc FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey AS visit_key, max(l_tax) AS tax, count(*) AS lines FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
""") + """
SELECT v.id, CAST(v.visitdt AS VARCHAR) AS visitdt, v.visit_key, u.cohort, round(u.age, 6) AS age,
       CAST(u.sex AS BIGINT) AS sex, round(m.qty, 6) AS qty, round(m.disc, 6) AS disc, round(s.tax, 6) AS tax, s.lines
FROM visits v LEFT JOIN subjects u USING (id) LEFT JOIN m USING (visit_key) LEFT JOIN s USING (visit_key)
""")
def attach_measures(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "visit_key")
    m = li.groupBy("visit_key").agg(F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("disc"))
    s = li.where("l_linestatus = 'F'").groupBy("visit_key").agg(
        F.max("l_tax").alias("tax"), F.count("*").alias("lines"))
    v = fx.visits(spark, sf_dir).select("id", "visitdt", "visit_key")
    return merge_left_many(v, [
        (fx.subjects(spark, sf_dir), ["id"], ["cohort", "age", "sex"]),
        (m, ["visit_key"], ["qty", "disc"]),
        (s, ["visit_key"], ["tax", "lines"]),
    ])


@query("diagnosis_flags", sql_with("wide") + """
SELECT id, visit, 'Yes' AS flagged FROM (
  SELECT id, unnest(['1','2','3','4','5','6','7']) AS visit, unnest([qty_1, qty_2, qty_3, qty_4, qty_5, qty_6, qty_7]) AS v
  FROM wide) WHERE v >= 45 AND visit <> '1'
""")
def diagnosis_flags(spark, sf_dir):
    w = fx.wide(spark, sf_dir)
    long = wide_to_long(w, ["id"], [f"qty_{i}" for i in range(1, 8)])
    return long.where((F.col("value") >= 45) & (F.col("visit") != "1")).select(
        "id", "visit", F.lit("Yes").alias("flagged"))


@query("prev_next_visit", sql_with("visits") + """
SELECT id, CAST(visitdt AS VARCHAR) AS visitdt, lag(visit_key) OVER w AS prev_visit_key,
       lead(visit_key) OVER w AS post_visit_key, round(lag(marker) OVER w, 6) AS prev_marker,
       round(lead(marker) OVER w, 6) AS post_marker
FROM visits WINDOW w AS (PARTITION BY id ORDER BY visitdt)
""")
def prev_next_visit(spark, sf_dir):
    v = fx.visits(spark, sf_dir)
    near = neighbor_visits(v, "id", ["visitdt"], ["visit_key"])
    near = lookup_neighbor(near, v, "id", "prev_visit_key", "visit_key", ["marker"], "prev_")
    near = lookup_neighbor(near, v, "id", "post_visit_key", "visit_key", ["marker"], "post_")
    return near.select("id", "visitdt", "prev_visit_key", "post_visit_key", "prev_marker", "post_marker")


@query("neighbor_events", """
SELECT event_id, lag(event_type) OVER w AS prev_event_type, lead(event_type) OVER w AS post_event_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def neighbor_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    near = neighbor_visits(e, "user_id", ["ts", "event_id"], ["event_type"], chunk=hour_chunk("ts"))
    return near.select("event_id", "prev_event_type", "post_event_type")


@query("interval_join", sql_with("visits", "treatment") + """
SELECT v.id, v.visit_key, CAST(v.visitdt AS VARCHAR) AS visitdt, CAST(t.tr_start AS VARCHAR) AS tr_start,
       CAST(t.tr_end AS VARCHAR) AS tr_end, t.indication, CAST(t.line AS BIGINT) AS line
FROM visits v JOIN treatment t ON v.id = t.id AND t.tr_start <= v.visitdt AND v.visitdt <= t.tr_end
""")
def interval_query(spark, sf_dir):
    v = fx.visits(spark, sf_dir).select("id", "visit_key", "visitdt")
    return interval_join(v, fx.treatment(spark, sf_dir), "id", "visitdt", "tr_start", "tr_end")


@query("treatment_at_visit", sql_with("visits", "treatment", more="""
hits AS (SELECT v.id, v.visit_key, v.visitdt, t.indication, t.line, t.tr_start
  FROM visits v JOIN treatment t ON v.id = t.id AND coalesce(t.tr_start <= v.visitdt, TRUE)
    AND (t.tr_end IS NULL OR v.visitdt <= t.tr_end))
""") + """
SELECT id, visit_key, CAST(visitdt AS VARCHAR) AS visitdt, indication, CAST(line AS BIGINT) AS line
FROM hits WHERE indication IN ('A', 'R')
QUALIFY row_number() OVER (PARTITION BY id ORDER BY visitdt, line, indication, tr_start) = 1
""")
def treatment_at_visit(spark, sf_dir):
    v = fx.visits(spark, sf_dir).select("id", "visit_key", "visitdt")
    t = fx.treatment(spark, sf_dir).where(F.col("indication").isin("A", "R"))
    hits = interval_join(v, t, "id", "visitdt", "tr_start", "tr_end", open_end="keep", width=90)
    first = first_per_group(hits, "id", ["visitdt", "line", "indication", "tr_start"])
    return first.select("id", "visit_key", "visitdt", "indication", "line")


# protocol order of the first five visits (by number: code); it deliberately differs from date order
_PROTOCOL = {2: "IN", 4: "D8", 1: "AD0", 3: "AD8", 5: "EOS"}


def _calendar(spark, sf_dir):
    cal = number_visits(fx.visits(spark, sf_dir).select("id", "visitdt", (F.col("prio") <= 2).alias("urgent")), "id",
                        ["visitdt"], chunk=day_chunk("visitdt"))
    codes = F.create_map(*[F.lit(x) for k, v in _PROTOCOL.items() for x in (k, v)])
    places = F.create_map(*[F.lit(x) for i, k in enumerate(_PROTOCOL, 1) for x in (k, i)])
    return cal.withColumns({"place": F.coalesce(places[F.col("n")], F.col("n")),
                            "code": F.coalesce(codes[F.col("n")], F.concat(F.lit("V"), F.col("n").cast("string")))})


_CALENDAR_SQL = """
cal AS (SELECT id, visitdt, n, prio, CASE n WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 1 THEN 3 WHEN 3 THEN 4 ELSE n END AS place,
    CASE n WHEN 2 THEN 'IN' WHEN 4 THEN 'D8' WHEN 1 THEN 'AD0' WHEN 3 THEN 'AD8' WHEN 5 THEN 'EOS' ELSE 'V' || n END AS visit
  FROM (SELECT id, visitdt, prio, row_number() OVER (PARTITION BY id ORDER BY visitdt) AS n FROM visits)),
"""


@query("first_match_visit", sql_with("visits", "treatment", more=_CALENDAR_SQL + """
best AS (SELECT t.id, t.tr_start, min(place) AS place FROM (SELECT DISTINCT id, tr_start FROM treatment) t
  JOIN cal c ON c.id = t.id AND c.visitdt >= t.tr_start GROUP BY t.id, t.tr_start)
""") + """
SELECT t.id, CAST(t.tr_start AS VARCHAR) AS onset, c.visit, date_diff('day', t.tr_start, c.visitdt) AS days_from_start
FROM treatment t LEFT JOIN best b ON b.id = t.id AND b.tr_start = t.tr_start
LEFT JOIN cal c ON c.id = b.id AND c.place = b.place
""")
def first_match(spark, sf_dir):
    """Every visit is a row of the calendar; those after the protocol's five come in order of date."""
    cal = _calendar(spark, sf_dir)
    onsets = fx.treatment(spark, sf_dir).select("id", F.col("tr_start").alias("onset"))
    df = first_match_rows(onsets, cal, "id", "onset", "visitdt", "place", "code", chunk=day_chunk)
    return df.select("id", "onset", "visit", F.datediff("matched", "onset").cast("long").alias("days_from_start"))


@query("treatment_at_onset", sql_with("visits", "treatment", more=_CALENDAR_SQL + """
sp AS (SELECT id, tr_start, coalesce(tr_end, tr_start) AS tr_end FROM treatment WHERE indication = 'A' AND tr_start IS NOT NULL),
best AS (SELECT t.id, t.tr_start, min(place) AS place FROM (SELECT DISTINCT id, tr_start FROM sp) t
  JOIN cal c ON c.id = t.id AND c.visitdt >= t.tr_start GROUP BY t.id, t.tr_start)
""") + """
SELECT sp.id, 'onset' AS rule, c.visit, date_diff('day', sp.tr_start, c.visitdt) AS days_from_start,
       date_diff('day', sp.tr_end, c.visitdt) AS days_from_end
FROM sp LEFT JOIN best b ON b.id = sp.id AND b.tr_start = sp.tr_start LEFT JOIN cal c ON c.id = b.id AND c.place = b.place
UNION ALL
SELECT id, 'flag', arg_min(visit, place), NULL, NULL FROM cal WHERE prio <= 2 GROUP BY id
""")
def treatment_at_onset(spark, sf_dir):
    spans = fx.treatment(spark, sf_dir).where("indication = 'A'")
    return treatment_onsets(spans, _calendar(spark, sf_dir), "id", "tr_start", "tr_end", "visitdt", "place", "code",
                            "urgent", day_chunk)


@query("diagnostic_visit", sql_with("visits", more="""
n AS (SELECT id, visitdt, visit_key, marker, lag(marker) OVER w AS prev_marker, lag(visitdt) OVER w AS prev_visitdt,
             lag(visit_key) OVER w AS prev_visit_key
      FROM visits WINDOW w AS (PARTITION BY id ORDER BY visitdt)),
p AS (SELECT *, (marker IS NULL AND prev_marker IS NOT NULL) OR coalesce(prev_marker > marker, FALSE) AS earlier FROM n)
""") + """
SELECT id, CAST(visitdt AS VARCHAR) AS visitdt,
       CAST(CASE WHEN earlier THEN prev_visitdt ELSE visitdt END AS VARCHAR) AS diagnostic_visitdt,
       CASE WHEN earlier THEN prev_visit_key ELSE visit_key END AS diagnostic_visit_key,
       round(CASE WHEN earlier THEN prev_marker ELSE marker END, 6) AS diagnostic_marker
FROM p WHERE CASE WHEN earlier THEN prev_marker ELSE marker END >= 1.5
""")
def diagnostic(spark, sf_dir):
    v = neighbor_visits(fx.visits(spark, sf_dir), "id", ["visitdt"], ["marker", "visitdt", "visit_key"])
    d = diagnostic_visit(v, "marker", "prev_marker", ["visitdt", "visit_key"], 1.5)
    return d.select("id", "visitdt", "diagnostic_visitdt", "diagnostic_visit_key", "diagnostic_marker")


@query("final_event_date", sql_with("analysis", more="""
o AS (SELECT id, visitdt, status, marker, final AS dead_dt, final + 1 AS moved_dt, origin AS end_dt FROM analysis)
""") + """
SELECT id, CAST(visitdt AS VARCHAR) AS visitdt,
       CAST(CASE status WHEN 1 THEN dead_dt WHEN 2 THEN moved_dt WHEN 0 THEN end_dt END AS VARCHAR) AS final_dt,
       CASE WHEN marker >= 1.5 THEN 'No response' WHEN marker < 1.5 THEN 'Response' END AS resolution
FROM o
""")
def final_event(spark, sf_dir):
    a = fx.analysis(spark, sf_dir).select(
        "id", "visitdt", "status", "marker", F.col("final").alias("dead_dt"),
        F.date_add("final", 1).alias("moved_dt"), F.col("origin").alias("end_dt"))
    a = final_event_date(a, "status", {1: "dead_dt", 2: "moved_dt", 0: "end_dt"}, "final_dt")
    return response_label(a, "marker", 1.5, "resolution").select("id", "visitdt", "final_dt", "resolution")


@query("union_cohorts", """
SELECT 'A' AS cohort, c_custkey AS id, round(c_acctbal, 6) AS balance, c_mktsegment AS segment, NULL AS nation
FROM customer
UNION ALL
SELECT 'B', s_suppkey, round(s_acctbal, 6), NULL, CAST(s_nationkey AS BIGINT) FROM supplier
""")
def union_query(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return union_cohorts({"A": a, "B": b}, "cohort")


# --- reshape -------------------------------------------------------------------

_LONG_SQL = """long AS (SELECT id, unnest(['qty','qty','qty','qty','qty','qty','qty','net_price','net_price','net_price',
    'net_price','net_price','net_price','net_price']) AS variable,
  unnest(['1','2','3','4','5','6','7','1','2','3','4','5','6','7']) AS visit,
  unnest([qty_1, qty_2, qty_3, qty_4, qty_5, qty_6, qty_7, net_price_1, net_price_2, net_price_3, net_price_4,
          net_price_5, net_price_6, net_price_7]) AS value
  FROM wide)"""
_WIDE_COLS = [f"{n}_{i}" for n in ("qty", "net_price") for i in range(1, 8)]


@query("wide_to_long", sql_with("wide", more=_LONG_SQL) + "SELECT id, variable, visit, round(value, 6) AS value FROM long")
def to_long(spark, sf_dir):
    return wide_to_long(fx.wide(spark, sf_dir), ["id"], _WIDE_COLS)


_UNITS = {"qty": "pieces", "price": "eur"}


@query("wide_to_long_first_token", sql_with("wide", more=_LONG_SQL) + """
SELECT id, CASE variable WHEN 'qty' THEN 'qty' ELSE 'price' END AS variable, visit, round(value, 6) AS value FROM long
""")
def to_long_first_token(spark, sf_dir):
    """Names like ``qty_3_pieces``: measure, visit, and a rest that is not used."""
    w = fx.wide(spark, sf_dir).select("id", *[F.col(f"{c}_{i}").alias(f"{n}_{i}_{u}") for c, (n, u) in zip(
        ("qty", "net_price"), _UNITS.items()) for i in range(1, 8)])
    return wide_to_long(w, ["id"], w.columns[1:], FIRST_TOKEN)


@query("long_to_wide", sql_with("wide", more=_LONG_SQL) + """
SELECT id, visit, round(max(CASE WHEN variable = 'qty' THEN value END), 6) AS qty,
       round(max(CASE WHEN variable = 'net_price' THEN value END), 6) AS net_price
FROM long GROUP BY id, visit
""")
def to_wide(spark, sf_dir):
    long = wide_to_long(fx.wide(spark, sf_dir), ["id"], _WIDE_COLS)
    return long_to_wide(long, ["id", "visit"], "variable", "value", ["qty", "net_price"])


@query("visit_sequence", sql_with("visits") + """
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY visitdt) AS INTEGER) AS n, visit_key FROM visits
""")
def sequence_query(spark, sf_dir):
    return number_visits(fx.visits(spark, sf_dir), "id", ["visitdt"], chunk=day_chunk("visitdt")).select("id", "n", "visit_key")


@query("gather", """
SELECT o_orderkey, unnest(['o_totalprice', 'o_custkey']) AS variable,
       round(unnest([o_totalprice, CAST(o_custkey AS DOUBLE)]), 6) AS value
FROM orders
""")
def gather_query(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return gather(o, ["o_totalprice", "o_custkey"])


# --- by subject -----------------------------------------------------------------


@query("locf", sql_with("filled") + """
SELECT id, CAST(visitdt AS VARCHAR) AS visitdt, round(marker, 6) AS marker, CAST(pulse AS BIGINT) AS pulse FROM filled
""")
def locf_query(spark, sf_dir):
    v = locf(fx.visits(spark, sf_dir), "id", ["visitdt"], ["marker", "pulse"], sentinels={"pulse": [-99]})
    return v.select("id", "visitdt", "marker", "pulse")


@query("locf_sentinel_after", sql_with("visits") + """
SELECT id, CAST(visitdt AS VARCHAR) AS visitdt,
       CAST(nullif(last_value(pulse IGNORE NULLS) OVER w, -99) AS BIGINT) AS pulse,
       round(last_value(marker IGNORE NULLS) OVER w, 6) AS marker
FROM visits WINDOW w AS (PARTITION BY id ORDER BY visitdt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def locf_after(spark, sf_dir):
    v = locf(fx.visits(spark, sf_dir), "id", ["visitdt"], ["marker", "pulse"], sentinels={"pulse": [-99]},
             sentinel_after=True)
    return v.select("id", "visitdt", "pulse", "marker")


@query("locf_events", """
SELECT event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w, 6) AS last_paid
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def locf_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn(
        "last_paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    e = e.select("event_id", "user_id", "ts", "last_paid")
    e = locf(e, "user_id", ["ts", "event_id"], ["last_paid"], chunk=hour_chunk("ts"))
    return e.select("event_id", "last_paid")


@query("first_per_group", """
SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""")
def first_query(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return first_per_group(e, "user_id", ["ts", "event_id"]).drop("ts")


@query("last_per_group", """
SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def last_query(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return last_per_group(e, "user_id", ["ts", "event_id"]).drop("ts")


@query("dedupe_by_key", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round(l_quantity, 6) AS l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1
""")
def dedupe_query(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return dedupe_by_key(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"]).drop("l_suppkey")


@query("audit_subsets", f"""WITH {_VIAL_SQL}, c AS (SELECT user_id AS id, CAST(ts AS DATE) AS day,
  max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS faulty FROM events GROUP BY 1, 2)
SELECT c.id, CAST(c.day AS VARCHAR) AS day, round(CAST(inv.n_15 * 1.5 + inv.n_5 * 0.5 AS DOUBLE), 6) AS total_ml, c.faulty,
       CASE WHEN inv.id IS NULL OR inv.n_15 * 1.5 + inv.n_5 * 0.5 < 1.5 THEN 1 ELSE 0 END AS low_volume,
       CASE WHEN c.faulty = 1 AND coalesce(inv.n_5, 0) = 0 AND coalesce(inv.n_15, 0) = 0 THEN 1 ELSE 0 END AS untreated
FROM c LEFT JOIN inv ON c.id = inv.id AND c.day = inv.day
WHERE (inv.id IS NULL OR inv.n_15 * 1.5 + inv.n_5 * 0.5 < 1.5)
   OR (c.faulty = 1 AND coalesce(inv.n_5, 0) = 0 AND coalesce(inv.n_15, 0) = 0)
""")
def audit_subsets(spark, sf_dir):
    days = (table(spark, sf_dir, "events")
            .groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("day"))
            .agg(F.max((F.col("event_type") == "error").cast("int")).alias("faulty")))
    df = merge_left(days, _inventory(spark, sf_dir), ["id", "day"], ["n_15", "n_5", "total_ml"])
    none = (F.coalesce("n_5", F.lit(0)) == 0) & (F.coalesce("n_15", F.lit(0)) == 0)
    df = df.withColumns({
        "low_volume": lt_missing_low("total_ml", F.lit(1.5)).cast("int"),
        "untreated": ((F.col("faulty") == 1) & none).cast("int")})
    return df.where("low_volume = 1 OR untreated = 1").select(
        "id", "day", "total_ml", "faulty", "low_volume", "untreated")


@query("any_treatment", sql_with("treatment") + """
SELECT id, CAST(max(CASE WHEN indication = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS any_a,
       CAST(max(CASE WHEN tr_end IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS any_open
FROM treatment GROUP BY id
""")
def any_treatment(spark, sf_dir):
    t = fx.treatment(spark, sf_dir).withColumns({
        "a": (F.col("indication") == "A").cast("int"), "open": F.col("tr_end").isNull().cast("int")})
    return any_by_subject(t, "id", ["a", "open"])


@query("vanished_subjects", sql_with("cp") + """
SELECT id, count(*) AS n_rows FROM analysis WHERE id NOT IN (SELECT id FROM cp) GROUP BY id
""")
def vanished_query(spark, sf_dir):
    """Subjects whose only visit is their final date leave no interval."""
    return vanished_subjects(fx.analysis(spark, sf_dir), fx.cp(spark, sf_dir), "id")
