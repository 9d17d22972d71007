"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue: its documents in a shuffled order (a hash of id and round), then all
of them again in another, as often as ``repeats`` allows. A document's virtual finish time is
the number of words its source has given up to and with it, divided by the source's target, so
all sources reach their target at time 1. The global order is by finish time, found by a range
sort; the mix is that order cut where the total budget is spent. All documents that finish
by time 1 fit into the budget; what is left of it goes to the next in line.

Running sums over a global order stay distributed: rows are range-sorted into partitions,
summed within each, written, and one small row per partition (and source) carries the sum
on. A source of any size spreads over partitions. Text is read once, for its number of words.

Targets: sources in order of code point, null last, weigh ``weights`` in turn and share
``share`` of all words; a target stops at ``repeats`` times its source's words and the excess
is shared out again by weight until no target is above.

Defined results: null text has size 0 and takes 0, as do empty texts; null is a source like
others; repeated rows are documents of their own, equal ones in any order; a null doc_id is
shuffled as the text 'null'; without words all targets are 0; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survlake.llm.tables import ship, stored, tidy

BROADCAST_BYTES = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"


def running_total(rows: DataFrame, order: Sequence[Column], value: str, out: str, within: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row in the global ``order`` (per ``within``, which leads it).

    Written once, so that the partitions a carry belongs to stay as they are.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at, by = rows.columns.index(value), rows.columns.index(within) if within else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, key, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            v = b.column(at).to_numpy()
            k = np.zeros(len(v), np.int64) if by is None else b.column(by).to_numpy()
            if not len(v):
                continue
            run_ = np.cumsum(v)
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            length = np.diff(np.append(head, len(v)))
            before = run_[head] - v[head]
            local = run_ - np.repeat(before, length)
            if k[0] == key:
                local[:length[0]] += total
            key, total = k[-1], local[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64()), pa.array(np.full(len(v), piece, np.int32))],
                                             names=[*b.schema.names, "_local", "_piece"])

    local = stored(sorted_.mapInArrow(tidy(run), f"{kinds}, _local long, _piece int"))
    keys = ["_piece", *([within] if within else [])]
    ends = local.groupBy(*keys).agg(F.max("_local").alias("_sum"))
    earlier = Window.partitionBy(*keys[1:]).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
    return _small_join(local, carry, keys).withColumn(out, F.col("_local") + F.col("_carry")).drop("_local", "_piece", "_carry")


def _small_join(rows: DataFrame, side: DataFrame, keys: list[str], text: str | None = None, salts: int = 64) -> DataFrame:
    """Left join with a side of one row per key: broadcast where its counted bytes are few, else salted against hot keys."""
    side = stored(side)
    size = side.agg(F.count(F.lit(1)) * 64 + (F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else 0)).first()[0]
    named = side.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(named), same, "left").drop(*[f"_key_{k}" for k in keys])
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    wide = named.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(wide, [*same, F.col("_salt") == F.col("_with")], "left").drop(*[f"_key_{k}" for k in keys], "_salt", "_with")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """source, number, source_size, target for rows (source, size)."""
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(grouped, [F.asc_nulls_last("source")], "_one", "number")
    turn = F.create_map(*[F.lit(x) for i, w in enumerate(weights) for x in (i, float(w))])
    ranked = stored(ranked.select("source", "source_size", "number", turn[((F.col("number") - 1) % len(weights)).cast("int")].alias("w")))
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * repeats
    capped, full, weight = -1, 0, 0.0
    level = F.lit(0.0)
    while True:  # numbers only come to the driver: how many are at their cap, their words, the weight of the rest
        at_cap = F.lit(False) if capped < 0 else level > cap
        r = ranked.agg(F.sum(at_cap.cast("long")).alias("n"), F.sum(F.when(at_cap, cap).otherwise(0)).alias("c"),
                       F.sum(F.when(at_cap, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if r["n"] is None or r["n"] == capped:
            break
        capped, full, weight = r["n"], r["c"], r["w"]
        level = F.lit(budget - full) * F.col("w") / F.lit(weight) if weight else cap + F.lit(1.0)
    return ranked.select("source", "number", "source_size", F.least(level, cap.cast("double")).alias("target"))


def schedule(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per document and round: row, doc_id, source, size, source_size, target, round, finish, position (words
    up to and with it in the global order), taken (is it in the mix?). ``row`` tells repeated rows apart."""
    ship(docs.sparkSession)
    sizes = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source",
                               F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    goal = targets(sizes.select("source", "size"), weights, share, repeats)
    rows = _small_join(sizes, goal, ["source"], "source")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn("round", F.explode(F.array(*[F.lit(i) for i in range(1, repeats + 1)])))
    rows = rows.withColumn("_draw", F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), F.col("round").cast("string"))), 1, 15), 16, 10).cast("long"))
    tie = [F.asc("_draw"), F.asc_nulls_last("doc_id"), F.asc("size"), F.asc("row")]
    queue = running_total(rows, [F.asc("number"), F.asc("round"), *tie], "size", "_given", within="number")
    timed = queue.withColumn("finish", F.when(F.col("target") > 0, F.col("_given") / F.col("target")).otherwise(F.lit(0.0)))
    order = [F.asc("finish"), F.asc("number"), F.asc("round"), *tie]
    placed = running_total(timed, order, "size", "position")
    budget = goal.agg(F.sum("target")).first()[0] or 0.0
    taken = (F.col("finish") <= 1.0) | (F.col("position") <= F.lit(budget))
    return placed.select("row", "doc_id", "source", "size", "source_size", "target", "round", "finish", "position", taken.alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    plan = schedule(docs, weights, share, repeats)
    return plan.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken")).drop("row")
