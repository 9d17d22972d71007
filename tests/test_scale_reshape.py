"""Reshaping holds one row per key, not one per value, and moves rows once."""

import survlake as sv


def test_reshaping_there_and_back_moves_rows_once(spark, capsys):
    df = spark.createDataFrame([(i, 1.0 * i, None, 2.0, 3) for i in range(20)], "id int, a_1 double, a_2 double, b_1 double, b_2 int")
    long = sv.wide_to_long(df.repartition(3, "id"), ["id"], ["a_1", "a_2", "b_1", "b_2"])
    assert long.schema["value"].dataType.typeName() == "double"
    back = sv.long_to_wide(long, ["id", "visit"], "variable", "value", ["a", "b"])
    assert sorted(map(tuple, back.where("id = 7").collect())) == [(7, "1", 7.0, 2.0), (7, "2", None, 3.0)]
    back.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_names_not_listed_keep_their_keys(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 6), (3, "a", 1), (3, "a", 4), (None, "a", 2)], "id int, v string, t int")
    assert sorted(map(tuple, sv.long_to_wide(df, ["id"], "v", "t", ["a"]).collect()), key=str) == [(1, None), (2, None), (3, 4), (None, 2)]
