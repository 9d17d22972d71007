"""Calendars kept as rows, and time axes of every type, with and without chunks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import survlake as sv
from survlake.operators import risk, scan

DAY0 = dt.date(2020, 1, 1)


def visits(rng):
    rows = [(i, DAY0 + dt.timedelta(days=d)) for i in range(12) for d in sorted(rng.sample(range(900), rng.randint(1, 14)))]
    rows += [(99, DAY0 + dt.timedelta(days=d)) for d in range(0, 1500, 3)]   # a subject with most of the rows
    return rows + [(50, None), (None, DAY0)]


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_first_match_over_all_visits(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "ROWS_PER_KEY", limit)
    rng = random.Random(4)
    rows = visits(rng)
    cal = [(i, d, rng.choice([None, *range(60)]), f"c{rng.randint(0, 9)}") for i, d in rows]
    asked = [(k, rng.choice([*range(12), 99, 77]), DAY0 + dt.timedelta(days=rng.randint(0, 1000))) for k in range(300)]
    asked += [(k, i, d) for k, (i, d) in enumerate(rows[:40], 1000)] + [(2000, 3, None), (2001, None, DAY0), (0, 5, DAY0), (0, 5, DAY0)]
    c = spark.createDataFrame(cal, "id int, d date, place int, code string")
    q = spark.createDataFrame(asked, "k int, id int, onset date").withColumn("note", F.lit("x"))
    got = sv.first_match_rows(q, c, "id", "onset", "d", "place", "code", chunk=scan.day_chunk).collect()
    assert len(got) == len(asked)
    for r in got:
        fit = [(p, v, d) for i, d, p, v in cal if i is not None and i == r.id and d and p is not None and r.onset and d >= r.onset]
        want = min(fit)[1:] if fit else (None, None)
        assert (r.visit, r.matched) == want and r.note == "x"


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_visits_are_numbered_without_end(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "ROWS_PER_KEY", limit)
    rows = visits(random.Random(4))
    got = sv.number_visits(spark.createDataFrame(rows, "id int, d date").repartition(5), "id", ["d"], chunk=scan.day_chunk("d")).collect()
    for r in got:
        if r.id is not None and r.d:
            assert r.n == 1 + sum(i == r.id and d is not None and d < r.d for i, d in rows)
    assert max(r.n for r in got) == 500


@pytest.mark.parametrize("kind", ["int", "date", "timestamp", "timestamp_ntz"])
def test_fine_axes_of_every_type(spark, monkeypatch, kind):
    """The same curves whatever the type of the axis, cut into chunks or not."""
    rng = random.Random(9)
    rows = [(rng.randint(0, 400), rng.choice([0, 1, 1, 2])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t int, cause int")
    made = {"int": F.col("t"), "date": F.date_add(F.lit(DAY0), F.col("t")), "timestamp": F.timestamp_seconds(F.col("t") * 61),
            "timestamp_ntz": F.timestamp_seconds(F.col("t") * 61).cast("timestamp_ntz")}
    df = df.withColumn("time", made[kind])

    def curves():
        km = sv.kaplan_meier(sv.survival_response(df, "time", "cause", 1)).orderBy("time").collect()
        cif = sv.cumulative_incidence(df, "time", "cause").orderBy("time", "cause").collect()
        return [r.surv for r in km], [r.est for r in cif]

    whole = curves()
    monkeypatch.setattr(risk, "TIMES_PER_CHUNK", 100)
    monkeypatch.setattr(scan, "TIMES_PER_CHUNK", 100)
    monkeypatch.setattr(risk, "time_splits", lambda d, c: scan.time_splits(d, c, 100))
    assert len(scan.time_splits(df, "time", 100)) == 4
    for a, b in zip(curves(), whole):
        assert a == pytest.approx(b, abs=1e-12)


def test_cut_points_may_be_dates(spark):
    df = spark.createDataFrame([(DAY0 + dt.timedelta(days=d),) for d in range(6)], "d date")
    got = scan.split_chunk(df, "d", [DAY0 + dt.timedelta(days=2), DAY0 + dt.timedelta(days=4)]).collect()
    assert [r["_chunk"] for r in got] == [0, 0, 1, 1, 2, 2]


def test_only_the_last_grids_stay_cached(spark):
    for i in range(risk.HELD + 3):
        resp = sv.survival_response(spark.createDataFrame([(1 + i, 1), (2, 0)], "t int, c int"), "t", "c", 1)
        sv.kaplan_meier(resp).collect()
    assert len(risk._held) <= risk.HELD
