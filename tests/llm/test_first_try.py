"""The first try compares the sketches that the fingerprints hold."""

import random

from pyspark.sql import functions as F

from survlake.llm import iblt


def test_written_sketches_subtract_to_the_sketch_of_the_difference(spark):
    r = random.Random(11)
    some = [[r.getrandbits(63) - (1 << 62) for _ in range(n)] for n in (300, 40, 0)]
    rows = [(a, b) for a in some for b in (some[0][:30] + some[1], some[2])]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    at = F.least(iblt.width(F.col("a")), iblt.width(F.col("b")))
    got = df.select(iblt.subtract(F.col("a"), F.col("b"), at).alias("x"),
                    iblt.subtract_sketches(iblt.own_sketch(F.col("a")), iblt.own_sketch(F.col("b")), at).alias("y"))
    assert all(x == y for x, y in got.collect())


def test_peeling_ends_when_a_round_finds_nothing(spark):
    keys = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.xxhash64(i))
    end = spark.range(1).select(iblt.peel(iblt.sketch(keys, F.lit(3)), F.lit(3)).alias("s")).first()["s"]
    assert end["over"] and len(end["cells"]) == 24 and end["only_a"] == 0
