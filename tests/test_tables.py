import datetime as dt

import pytest
from pyspark.sql import functions as F

import survlake as sv
from survlake.operators import scan
from survlake.operators.scan import carry_forward, day_chunk, next_value, previous_value, running, time_splits

D = dt.date


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


# --- columns and nulls ---------------------------------------------------------


def test_missing_sorts_below_every_number(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None), (1, 2), (2, 2), (3, 2)], "a int, b int")
    got = df.select("a", "b", sv.lt_missing_low("a", "b").alias("lt"), sv.le_missing_low("a", "b").alias("le"),
                    sv.gt_missing_low("a", "b").alias("gt")).collect()
    assert [(r.lt, r.le, r.gt) for r in got] == [
        (True, True, False), (False, False, True), (False, True, False),
        (True, True, False), (False, True, False), (False, False, True)]


def test_recode_keep_null_and_labels(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [r.c for r in sv.recode(df, "c", {"a": "A"}).collect()] == ["A", "z", None]
    assert [r.n for r in sv.recode(df, "c", {"a": 1}, default="null", out="n").collect()] == [1, None, None]
    assert [r.label for r in sv.apply_labels(df, "c", {"a": "Alpha"}).collect()] == ["Alpha", None, None]
    with pytest.raises(ValueError):
        sv.recode(df, "c", {}, default="drop")


def test_nullify_and_try_number(spark):
    df = spark.createDataFrame([(".",), ("",), (" 4.5",), (None,), ("x",)], "c string")
    assert [r.c for r in sv.nullify(df, ["c"], [".", ""]).collect()] == [None, None, " 4.5", None, "x"]
    assert [r.c for r in sv.try_number(df, ["c"]).collect()] == [None, None, 4.5, None, None]


def test_override_replaces_even_with_null(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, v int")
    fix = spark.createDataFrame([(2, None), (3, 9)], "id int, v int")
    assert rows(sv.override(df, fix, ["id"], ["v"]), "id", "v") == [(1, 5), (2, None), (3, 9)]


def test_flags(spark):
    df = spark.createDataFrame([(1, None), (None, None), (0, 2)], "a int, b int")
    assert [r.f for r in df.select(sv.any_flag("a", "b").alias("f")).collect()] == [1, 0, 0]
    got = df.select(sv.flag_when(F.col("a") < 1).alias("f")).collect()
    assert [r.f for r in got] == [0, None, 1]


def test_round_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,)], "v double")
    assert [r.v for r in df.select(sv.round_even("v", 2).alias("v")).collect()] == [0.12, 0.38, -0.12]


def test_select_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, q_1 int, q_2 int, r_1 int")
    assert sv.select_prefix(df, ["id"], ["q_"]).columns == ["id", "q_1", "q_2"]
    assert sv.select_numbered(df, ["id"], "q_", 2).columns == ["id", "q_1", "q_2"]
    with pytest.raises(ValueError):
        sv.rename_all(df, {"nope": "x"})


def test_io_roundtrip_and_schema_rule(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    for fmt in ("parquet", "csv", "orc", "json"):
        path = f"{scratch}/{fmt}"
        sv.write_table(df, path, fmt)
        sv.write_table(df, path, fmt)                      # replaces
        assert rows(sv.read_table(spark, path, df.schema, fmt), "id", "s") == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        sv.read_table(spark, f"{scratch}/csv", fmt="csv")
    marked = f"{scratch}/dots"
    spark.createDataFrame([("1", "."), ("2", "x")], "id string, s string").write.option("header", True).csv(marked)
    assert rows(sv.read_table(spark, marked, "id int, s string", "csv", "."), "id", "s") == [(1, None), (2, "x")]


# --- joins ---------------------------------------------------------------------


def test_merge_full_right_side_overwrites(spark):
    a = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "id int, v int, a int")
    b = spark.createDataFrame([(2, None, 2), (3, 30, 2)], "id int, v int, b int")
    assert rows(sv.merge_full(a, b, ["id"]), "id", "v", "a", "b") == [
        (1, 10, 1, None), (2, None, 1, 2), (3, 30, None, 2)]


def _spans(spark):
    return spark.createDataFrame([
        (1, D(2020, 1, 1), D(2020, 1, 10), "closed"), (1, None, D(2020, 1, 3), "no start"),
        (1, D(2020, 1, 5), None, "no end"), (1, D(2020, 2, 1), D(2020, 1, 1), "reversed"),
        (2, D(2000, 1, 1), D(2030, 1, 1), "long"), (3, D(2020, 1, 1), D(2020, 12, 31), "no points")],
        "id int, s date, e date, tag string")


@pytest.mark.parametrize("width", [1, 7, 5000])
def test_interval_join_edges(spark, width):
    points = spark.createDataFrame([
        (1, D(2020, 1, 1)), (1, D(2020, 1, 3)), (1, D(2020, 1, 10)), (1, D(2020, 1, 11)), (1, None),
        (2, D(2019, 6, 1)), (4, D(2020, 1, 1))], "id int, at date")
    got = rows(sv.interval_join(points, _spans(spark), "id", "at", "s", "e", width=width), "id", "at", "tag")
    want = [(1, D(2020, 1, 1), "closed"), (1, D(2020, 1, 1), "no start"), (1, D(2020, 1, 10), "closed"),
            (1, D(2020, 1, 3), "closed"), (1, D(2020, 1, 3), "no start"), (2, D(2019, 6, 1), "long")]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = rows(sv.interval_join(points, _spans(spark), "id", "at", "s", "e", open_end="keep", width=width), "id", "at", "tag")
    extra = [(1, D(2020, 1, 10), "no end"), (1, D(2020, 1, 11), "no end")]
    assert sorted(kept, key=str) == sorted(want + extra, key=str)


def test_interval_join_equals_brute_force(spark, sf_dir):
    from survlake.plans import fixtures as fx
    v = fx.visits(spark, sf_dir).select("id", "visit_key", "visitdt")
    t = fx.treatment(spark, sf_dir)
    got = sv.interval_join(v, t, "id", "visitdt", "tr_start", "tr_end").count()
    vs, ts = v.toPandas(), t.toPandas()
    m = vs.merge(ts, on="id")
    assert got == int(((m.tr_start <= m.visitdt) & (m.visitdt <= m.tr_end)).sum()) > 0


def test_asof_join_open_and_closed(spark):
    df = spark.createDataFrame([(1, 0), (1, 5), (1, 9), (2, 5)], "id int, t int")
    assert rows(sv.asof_join(df, [5, 10], "id", "t"), "LM", "id", "t") == [(10, 1, 9), (10, 2, 5), (5, 1, 0)]
    assert rows(sv.asof_join(df, [5, 10], "id", "t", closed="right"), "LM", "id", "t") == [
        (10, 1, 9), (10, 2, 5), (5, 1, 5), (5, 2, 5)]


def test_first_match_follows_protocol_order(spark):
    df = spark.createDataFrame([
        (D(2020, 1, 5), D(2020, 1, 9), D(2020, 1, 6)),     # both fit: protocol order wins over date
        (D(2020, 1, 8), D(2020, 1, 7), D(2020, 1, 8)),     # only the second fits, on the day itself
        (D(2020, 1, 9), D(2020, 1, 7), None), (None, D(2020, 1, 7), D(2020, 1, 8))],
        "onset date, a date, b date")
    got = sv.first_match_visit(df, "onset", {"A": "a", "B": "b"}, offsets={"days": "onset"})
    assert [(r.visit, r.days) for r in got.collect()] == [("A", 4), ("B", 0), (None, None), (None, None)]


# --- reshape --------------------------------------------------------------------


def test_name_patterns(spark):
    from survlake.operators.reshape import FIRST_TOKEN
    df = spark.createDataFrame([(1, 7.0, 8.0)], "id int, tr_alb_W1 double, tr_alb_R2 double")
    assert rows(sv.wide_to_long(df, ["id"], df.columns[1:]), "variable", "visit", "value") == [
        ("tr_alb", "R2", 8.0), ("tr_alb", "W1", 7.0)]
    df = spark.createDataFrame([(1, 7.0)], "id int, creat_IN double")
    assert rows(sv.wide_to_long(df, ["id"], ["creat_IN"], FIRST_TOKEN), "variable", "visit") == [("creat", "IN")]


def test_visit_sequence_and_long_to_wide(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 1, "z")], "id int, t int, v string")
    assert rows(sv.visit_sequence(df, "id", ["t"], "v", 2), "id", "v1", "v2") == [(1, "a", "b"), (2, "z", None)]
    assert rows(sv.long_to_wide(df, ["id"], "v", "t", ["a", "z"]), "id", "a", "z") == [(1, 1, None), (2, None, 1)]


# --- by subject -----------------------------------------------------------------


def _visits(spark):
    return spark.createDataFrame([
        (1, D(2020, 1, 1), None, 70), (1, D(2020, 1, 3), 2.0, -99), (1, D(2021, 6, 4), None, None),
        (1, D(2023, 1, 9), 1.0, -99), (2, D(2020, 1, 1), 1.0, -99), (2, D(2023, 5, 1), None, None),
        (None, D(2020, 1, 1), 4.0, 1), (None, D(2022, 1, 1), None, None)],
        "id int, d date, m double, hr int")


@pytest.mark.parametrize("chunk", [None, "year"])
def test_locf_and_sentinels(spark, chunk, monkeypatch):
    monkeypatch.setattr(scan, "ROWS_PER_KEY", 2)
    key = None if chunk is None else day_chunk("d", 90)
    df = _visits(spark)
    got = rows(sv.locf(df, "id", ["d"], ["m", "hr"], {"hr": [-99]}, chunk=key).where("id is not null"), "id", "d", "m", "hr")
    assert got == sorted([
        (1, D(2020, 1, 1), None, 70), (1, D(2020, 1, 3), 2.0, 70), (1, D(2021, 6, 4), 2.0, 70),
        (1, D(2023, 1, 9), 1.0, 70), (2, D(2020, 1, 1), 1.0, None), (2, D(2023, 5, 1), 1.0, None)], key=str)
    after = sv.locf(df, "id", ["d"], ["hr"], {"hr": [-99]}, sentinel_after=True, chunk=key)
    assert [r[1] for r in rows(after.where("id = 1"), "d", "hr")] == [70, None, None, None]
    assert sv.locf(df, "id", ["d"], ["m"], chunk=key).where("id is null").agg(F.sum("m")).first()[0] == 8.0


@pytest.mark.parametrize("limit, hint", [(100, 2 ** 20), (0, 2 ** 20), (100, 0)])
def test_chunked_scans_equal_plain_windows(spark, monkeypatch, limit, hint):
    # one subject holds most rows; limit 0 makes every subject "hot", hint 0 forbids the broadcast
    monkeypatch.setattr(scan, "ROWS_PER_KEY", limit)
    monkeypatch.setattr(scan, "BROADCAST_BYTES", hint)
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, 0).otherwise(F.col("id") % 11).cast("int").alias("who"),
        F.col("id").alias("k"), F.date_add(F.lit(D(2020, 1, 1)), (F.col("id") * 7 % 1501).cast("int")).alias("d"),
        F.when(F.hash("id") % 5 == 0, F.col("id")).alias("x"))
    order, chunk = ["d", "k"], day_chunk("d", 30)
    for fn in (next_value, previous_value):
        a = rows(fn(df, "who", order, {"o": "k", "p": "d"}), "k", "o", "p")
        assert a == rows(fn(df, "who", order, {"o": "k", "p": "d"}, chunk), "k", "o", "p")
    assert rows(carry_forward(df, "who", order, ["x"]), "k", "x") == rows(
        carry_forward(df, "who", order, ["x"], chunk), "k", "x")


def test_running_totals_in_chunks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("s"), F.col("id").alias("t"),
                                 (F.col("id") * 37 % 11).alias("v"), (1 - F.col("id") % 7 / 10).alias("f"))
    out = {"a": ("sum", "v"), "b": ("sum_before", "v"), "c": ("sum_from", "v"), "d": ("sum_after", "v"),
           "e": ("product", "f"), "g": ("product_before", "f")}
    plain = rows(running(df, ["s"], "t", out), "s", "t", *out)
    cut = rows(running(df, ["s"], "t", out, [50, 51, 200, 460]), "s", "t", *out)
    assert len(plain) == 500
    for p, c in zip(plain, cut):
        assert p == pytest.approx(c, rel=1e-12)
    first = [r for r in plain if r[1] < 3]
    assert all(r[3] == 0 and r[7] == 1.0 for r in first)


def test_time_splits_balance_distinct_times(spark):
    # a third of the rows share one time
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).cast("long").alias("t"))
    assert time_splits(df, "t", 100_000) == []
    cuts = time_splits(df, "t", 1000)
    assert 4 <= len(cuts) <= 7 and cuts == sorted(cuts)


def test_first_last_dedupe(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, "c"), (2, None, "n"), (2, 5, "z")], "id int, t int, v string")
    assert rows(sv.first_per_group(df, "id", ["t", "v"]), "id", "v") == [(1, "a"), (2, "n")]
    assert rows(sv.last_per_group(df, "id", ["t", "v"]), "id", "v") == [(1, "b"), (2, "z")]
    assert rows(sv.dedupe_by_key(df, ["id", "t"], ["v"]), "id", "t", "v") == [
        (1, 1, "a"), (1, 2, "b"), (2, None, "n"), (2, 5, "z")]


def test_rank_picks_are_limited_before_the_shuffle(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    plan = sv.first_per_group(e, "user_id", ["ts", "event_id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_counting_process_rules(spark):
    final = D(2020, 1, 11)
    df = spark.createDataFrame([
        (1, D(2020, 1, 1), final, 1), (1, D(2020, 1, 4), final, 1), (1, final, final, 1),   # event moves back
        (2, final, final, 2),                                                             # vanishes
        (3, D(2020, 1, 1), final, 2)], "id int, d date, final date, status int").withColumn("origin", F.lit(D(2020, 1, 1)))
    cp = sv.counting_process(df, "id", "d", "origin", "final", "status")
    assert rows(cp, "id", "start_time", "end_time", "time", "event_numeric") == [
        (1, 0, 3, 10, 0), (1, 3, 10, 10, 1), (3, 0, 10, 10, 2)]
    assert rows(sv.baseline_rows(cp, "id", "status"), "id", "start_time", "event_numeric") == [(1, 0, 1), (3, 0, 2)]


def test_expand_days(spark):
    df = spark.createDataFrame([(1, 0, 3), (2, 5, 5), (3, 5, 4)], "id int, s int, e int")
    assert rows(sv.expand_days(df, "s", "e"), "id", "day") == [(1, 0), (1, 1), (1, 2)]


def test_diagnostic_visit_missing_rules(spark):
    df = spark.createDataFrame([
        (1, 1.0, 2.0), (2, None, 1.6), (3, 1.7, None), (4, 1.6, 1.6), (5, None, None), (6, 1.4, 1.45)],
        "id int, m double, prev_m double").withColumns({"v": F.lit("now"), "prev_v": F.lit("before")})
    got = sv.diagnostic_visit(df, "m", "prev_m", ["v"], 1.5)
    assert rows(got, "id", "diagnostic_v", "diagnostic_m") == [
        (1, "before", 2.0), (2, "before", 1.6), (3, "now", 1.7), (4, "now", 1.6)]


def test_union_and_final_date_and_labels(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, id int")
    assert rows(sv.union_cohorts({"A": a, "B": b}, "cohort"), "cohort", "id", "a", "b") == [
        ("A", 1, "x", None), ("B", 2, None, "y")]
    d = spark.createDataFrame([(0, 1, 2, 3), (1, 1, 2, 3), (2, 1, 2, 3), (9, 1, 2, 3)], "s int, c int, d int, t int")
    assert [r.o for r in sv.final_event_date(d, "s", {1: "d", 2: "t", 0: "c"}, "o").collect()] == [1, 2, 3, None]
    m = spark.createDataFrame([(1.5,), (1.4,), (None,)], "m double")
    assert [r.r for r in sv.response_label(m, "m", 1.5, "r").collect()] == ["No response", "Response", None]


# --- descriptives ------------------------------------------------------------------


def test_describe_small_and_null_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (10.0, None), (None, None)], "a double, b double")
    got = {r.variable: r for r in sv.describe_continuous(df, ["a", "b"]).collect()}
    assert (got["a"].q1, got["a"].median, got["a"].q3) == (1.75, 3.0, 5.5)
    assert got["a"].missing_pct == pytest.approx(20) and got["b"].missing_pct == 100
    assert got["b"].mean is None and got["b"].q1 is None


def test_quartiles_are_exact_at_any_size(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 101, 20_011):
        x = np.round(rng.normal(size=n) * 100, 1)
        df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
        r = sv.describe_continuous(df, ["x"]).first()
        assert [r.q1, r.median, r.q3] == pytest.approx(list(np.quantile(x, [.25, .5, .75])), abs=1e-9)


def test_order_statistics_by_refined_ranges(spark, monkeypatch):
    import numpy as np
    from survlake.operators import describe
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000), np.full(4000, 7.5),
                        [np.inf, -np.inf, 0.0]])
    y = np.where(np.arange(len(x)) % 3 == 0, np.nan, np.round(x, 1))      # ties; nan is a null here
    df = spark.createDataFrame([(float(a), None if np.isnan(b) else float(b)) for a, b in zip(x, y)], "x double, y double").repartition(5)
    counts = {"x": len(x), "y": int((~np.isnan(y)).sum())}
    ranks = {c: [0, 1, n // 4, n // 4 + 1, n // 2, 3 * n // 4, n - 2, n - 1] for c, n in counts.items()}
    want = {"x": np.sort(x), "y": np.sort(y[~np.isnan(y)])}
    # ranges listed early, late or never; edges that often miss the rank: the counts alone decide
    for few, accuracy in ((2_000, 10_000), (5, 10_000), (0, 20)):
        monkeypatch.setattr(describe, "FEW", few)
        monkeypatch.setattr(describe, "_ACCURACY", accuracy)
        got = describe.order_statistics(df, ranks, counts)
        assert got == {(c, r): want[c][r] for c in ranks for r in ranks[c]}


def test_describe_of_an_empty_table_has_no_row(spark):
    assert sv.describe_continuous(spark.createDataFrame([], "a double"), ["a"]).collect() == []


def test_percentages_by_day_skip_nulls_but_table_does_not(spark):
    df = spark.createDataFrame([(0, 3, 1), (0, 2, None), (1, 3, 0), (7, 8, None), (4, 4, 1)], "start_time int, end_time int, f int")
    assert rows(sv.daily_prevalence(df, ["f"]), "day", "yes_pct") == [(0, 100.0), (1, 50.0), (2, 50.0), (7, None)]
    assert rows(sv.daily_counts(df, ["f"]), "day", "category", "n") == [
        (0, None, 1), (0, "Yes", 1), (1, None, 1), (1, "No", 1), (1, "Yes", 1), (2, "No", 1), (2, "Yes", 1), (7, None, 1)]
    r = sv.describe_categorical(df, ["f"]).first()
    assert r.yes_pct == 40.0 and r.missing_pct == pytest.approx(40.0)


def test_longitudinal_points_close_at_the_final_time(spark):
    df = spark.createDataFrame([(1, 0, 9, 1.0), (1, 4, 9, 2.0)], "id int, start_time int, time int, m double")
    assert rows(sv.longitudinal_points(df, "id", ["m"]), "time", "value") == [(0, 1.0), (4, 2.0), (9, 2.0)]


# --- keys and work tables --------------------------------------------------------


@pytest.mark.parametrize("merge", [
    lambda a, b: sv.merge_full(a, b, ["id"], unique=True), lambda a, b: sv.merge_left(a, b, ["id"], unique=True),
    lambda a, b: sv.lookup_neighbor(a.withColumn("near", F.lit(1)), b.withColumn("visit", F.lit(1)), "id", "near", "visit", ["w"], "p_",
                                    unique=True)])
def test_a_repeated_key_raises_in_the_merge(spark, merge):
    a = spark.createDataFrame([(1, 10), (2, 20)], "id int, v int")
    good = spark.createDataFrame([(1, 5), (None, 6), (None, 7)], "id int, w int")
    assert merge(a, good).where("id is not null").count() == 2
    with pytest.raises(Exception, match="occurs twice"):
        merge(a, good.union(good)).collect()


def test_the_key_check_adds_no_shuffle_to_the_merge(spark, sf_dir):
    o = sv.read_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    c = o.select("o_orderkey", F.lit(1).alias("one"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plans = [sv.merge_left(o, c, ["o_orderkey"], unique=u)._jdf.queryExecution().executedPlan().toString() for u in (False, True)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[0].count("Exchange hashpartitioning") == plans[1].count("Exchange hashpartitioning") == 2


def test_two_visits_on_one_day_raise(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1)), (1, D(2020, 1, 1)), (1, D(2020, 1, 5))], "id int, v date").withColumns(
        {"o": F.lit(D(2020, 1, 1)), "f": F.lit(D(2020, 2, 1)), "s": F.lit(1)})
    assert sv.counting_process(df.distinct(), "id", "v", "o", "f", "s").count() == 2
    with pytest.raises(Exception, match="two visits of one id on one v"):
        sv.counting_process(df, "id", "v", "o", "f", "s").collect()


def test_vanished_subjects(spark):
    before = spark.createDataFrame([(1,), (1,), (2,), (2,), (2,), (None,)], "id int")
    assert rows(sv.vanished_subjects(before, before.where("id = 1"), "id"), "id", "n_rows") == [(2, 3)]
    assert sv.vanished_subjects(before, before, "id").count() == 0


def test_asof_ties_go_by_the_given_order(spark):
    df = spark.createDataFrame([(1, 5, k) for k in (2, 9, 4)], "id int, t int, k int")
    assert rows(sv.asof_join(df, [10], "id", "t", ties=["k"]), "LM", "k") == [(10, 9)]


def test_treatment_onsets(spark):
    cal = spark.createDataFrame([
        (1, D(2020, 1, 10), 2, "W1", True), (1, D(2020, 1, 20), 1, "IN", False), (1, D(2020, 1, 30), 3, "W4", True),
        (2, D(2020, 1, 1), 1, "IN", None)], "id int, d date, r int, v string, f boolean")
    spans = spark.createDataFrame([
        (1, D(2020, 1, 5), None), (1, D(2020, 1, 25), D(2020, 1, 27)), (1, None, D(2020, 1, 2)), (2, D(2020, 2, 1), None)],
        "id int, s date, e date")
    got = sv.treatment_onsets(spans, cal, "id", "s", "e", "d", "r", "v", "f")
    assert set(map(tuple, got.collect())) == {
        (1, "onset", "IN", 15, 15), (1, "onset", "W4", 5, 3), (2, "onset", None, None, None), (1, "flag", "W1", None, None)}


def test_drop_work(spark):
    for name in ("work_a", "work_b"):
        spark.range(1).createOrReplaceTempView(name)
    sv.drop_work(spark, "work_a")
    assert not spark.catalog.tableExists("work_a") and spark.catalog.tableExists("work_b")
    sv.drop_work(spark)
    assert not spark.catalog.tableExists("work_b")
