"""op6: a text's digests and sketch are made once, and peeling does not compare all digests with all."""

import time

from pyspark.sql import functions as F

from survlake.llm import iblt


def test_columns_made_of_the_text_come_with_the_next_row(spark):
    texts = {i: (None if i % 7 == 0 else "" if i % 5 == 0 else f"Text {i}. " * (i % 4 + 1)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for size in (16 << 20, 40):  # one range, and many
        rows = iblt.with_next(docs, ["text"], size, {"own": lambda t: F.struct(iblt.digests(t).alias("d"), F.length(t).alias("n"))}).collect()
        own = {r["doc_id"]: r["own"] for r in rows}
        assert len(rows) == 60 and all(r["next"]["text"] == (texts[(r["doc_id"] - 1) % 60] or "") for r in rows)
        assert all(r["next"]["own"] == own[(r["doc_id"] - 1) % 60] for r in rows)


def test_peeling_takes_time_in_proportion(spark):
    def seconds(n):
        keys = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.xxhash64(i))
        # the keys come as a column, so that nothing is worked out when planning
        rows = spark.createDataFrame([(n,)], "n int").select("n", keys.alias("k"))
        rows = rows.select(iblt.peel(iblt.sketch(F.col("k"), iblt.power(F.col("n") * 2)), iblt.power(F.col("n") * 2)).alias("s"))
        begun = time.perf_counter()
        end = rows.first()["s"]
        assert end["only_a"] == n and end["only_b"] == 0 and end["cells"] == []
        return time.perf_counter() - begun
    seconds(100)
    assert seconds(30000) < 5 * seconds(3000) + 10  # by pairs: 100 times


def test_sums_of_runs_of_any_length(spark):
    cells = [(p, (-1) ** (p + i), 1000 * p + i, 77 * p + i) for p in range(6) for i in range(p)] + [(9, 1, 5, 6), (9, -1, 5, 6)]
    got = spark.createDataFrame([(cells,)], f"c {iblt.CELLS}").select(iblt.fold(F.col("c")).alias("f")).first()["f"]
    want = []
    for p in range(6):
        at = [c for c in cells if c[0] == p]
        sums = [sum(c[1] for c in at), 0, 0]
        for c in at:
            sums[1:] = sums[1] ^ c[2], sums[2] ^ c[3]
        want += [(p, *sums)] if any(sums) else []
    assert [tuple(c) for c in got] == want
