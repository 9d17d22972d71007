"""Spans are dealt over half their bins; open and very long ones are clipped to the points."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

import survlake as sv
from survlake.operators.joins import deal_spans

DAY = date(2020, 1, 1)


def test_a_span_goes_to_every_second_bin(spark):
    days = spark.range(30).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("s")).withColumn("e", F.date_add("s", 29))
    assert deal_spans(days, F.col("s"), F.col("e"), 30).count() == 30      # two bins each, but for one


def test_interval_join_of_all_kinds_of_spans(spark):
    r = random.Random(3)

    def day(lo, hi):
        return None if r.random() < 0.15 else DAY + timedelta(r.randint(lo, hi))
    points = [(r.choice([1, 1, 1, 2, None]), n, day(-200, 400)) for n in range(150)]
    spans = [(r.choice([1, 1, 2, 3, None]), n, day(-9000, 500) if n % 5 == 0 else day(-200, 400), None) for n in range(120)]
    spans = [(i, n, s, day(-200, 9000) if n % 7 == 0 or s is None else s + timedelta(r.randint(-5, 80))) for n, (i, _, s, _) in enumerate(spans)]
    p = spark.createDataFrame(points, "id int, p int, at date")
    q = spark.createDataFrame(spans, "id int, q int, s date, e date")
    for mode in ("drop", "keep"):
        want = sorted((n, m) for i, n, at in points for j, m, s, e in spans if i is not None and i == j and at is not None
                      and (s is None or s <= at) and (mode == "keep" if e is None else at <= e))
        for width in (1, 30):
            got = sv.interval_join(p, q, "id", "at", "s", "e", open_end=mode, width=width)
            assert got.columns == ["id", "p", "at", "q", "s", "e"]
            assert sorted((x["p"], x["q"]) for x in got.collect()) == want
