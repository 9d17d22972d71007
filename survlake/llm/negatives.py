"""Hard-negative mining by a vertical scan of columnar blocks with shrinking candidate sets.

Vectors become whole numbers, floor(scale · x), and are packed where they are read into
blocks: one column per dimension with its minimum and maximum, rows in order of label. For
an anchor the dimensions are read in the order of its descending magnitude, a few at a time.
What the dimensions still to come can add lies between sums of their minimum and maximum
contributions, so each candidate's score is bounded from both sides; candidates that cannot
be among the results any more leave the bitmap, and the score of those that stay to the last
dimension is exact. Two such scans: first an anchor's positives (best rows of its label),
then, for the windows that their scores open, the best rows of other labels in each window.

Anchors (every row whose id is divisible by ``every``) meet all rows in cells: a stripe of
anchors, bounded in bytes and held by the task, times a part of the blocks, streamed past
it. A stripe's best so far raises the bounds as blocks pass. Cells give a few rows per
anchor and are merged by grouping; neither anchors nor blocks go through the driver.

Defined results: rows with a null label, a null vector or a null or non-finite component
take no part. Shorter vectors count as filled up with zeros. Rows are told apart as rows:
repeated rows are different rows, each its own anchor or partner; order among equal scores
is by vec_id, null last (null ids are never anchors). An anchor without positives, or a
positive without negatives in its window, gives no rows; nor does an empty table. Further
columns of the table are ignored. Scores that do not fit 63 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survlake.llm.tables import ship, stored, tidy

STEP = 8              # dimensions between two looks at the bounds
NO_ID = np.iinfo(np.int64).max
BLOCK = ("base long, n int, dims int, ids array<long>, labels array<long>, data binary")
ANCHOR = "uid long, vec_id long, label long, dims int, data binary"


def whole_vectors(rows: DataFrame, scale: int, every: int, modulus: int, classes: int) -> DataFrame:
    """vec_id, label (moved on for every ``modulus``-th id), values as whole numbers."""
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % modulus == 0, (label + 1) % classes).otherwise(label)
    return rows.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """The rows as columnar blocks, made in the scan's tasks; row i of a block is number base + i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = TaskContext.get().partitionId() << 40, []

        def emit(t: pa.Table) -> pa.RecordBatch:
            nonlocal base
            lengths = np.array(t["v"].combine_chunks().value_lengths(), np.int64)
            dims, n = int(lengths.max()), t.num_rows
            x = np.zeros((n, dims), np.int64)
            x[np.arange(dims) < lengths[:, None]] = t["v"].combine_chunks().flatten().to_numpy()
            label = t["label"].to_numpy()
            by = np.argsort(label, kind="stable")
            ids = t["vec_id"].take(pa.array(by)).combine_chunks()
            out = pa.RecordBatch.from_arrays([
                pa.array([base]), pa.array([n], pa.int32()), pa.array([dims], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                pa.array([label[by].tolist()], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(x[by].T).tobytes()], pa.binary())],
                names=["base", "n", "dims", "ids", "labels", "data"])
            base += n
            return out

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= block_rows:
                t = pa.Table.from_batches(held)
                for lo in range(0, t.num_rows - block_rows + 1, block_rows):
                    yield emit(t.slice(lo, block_rows))
                held = t.slice(t.num_rows - t.num_rows % block_rows).to_batches()
        t = pa.Table.from_batches(held) if held else None
        if t is not None and t.num_rows:
            yield emit(t)

    return rows.mapInArrow(tidy(run), BLOCK)


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """uid, vec_id, label, dims and vector of the rows whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], np.int64).reshape(r["dims"], r["n"])
                at = [i for i, k in enumerate(r["ids"]) if k is not None and k % every == 0]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["base"] + i for i in at], pa.int64()), pa.array([r["ids"][i] for i in at], pa.int64()),
                    pa.array([r["labels"][i] for i in at], pa.int64()), pa.array([r["dims"]] * len(at), pa.int32()),
                    pa.array([x[:, i].tobytes() for i in at], pa.binary())], names=["uid", "vec_id", "label", "dims", "data"])

    return blocks.mapInArrow(run, ANCHOR)


class Block:
    """Columns of a block, their ranges, and where each label's rows stand."""

    def __init__(self, row: dict, dims: int, most: int):
        x = np.frombuffer(row["data"], np.int64).reshape(row["dims"], row["n"])
        if row["dims"] < dims:
            x = np.concatenate([x, np.zeros((dims - row["dims"], row["n"]), np.int64)])
        peak = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        limit = peak * most * max(len(x), 1)
        if limit >= 1 << 63:
            raise ValueError("inner products of these vectors do not fit 63 bits")
        self.cols = x.astype(np.float64) if limit < 1 << 53 else x   # whole numbers either way
        self.low, self.high = self.cols.min(axis=1), self.cols.max(axis=1)
        self.labels = np.array(row["labels"], np.int64)
        self.ids = np.array([NO_ID if k is None else k for k in row["ids"]], np.int64)
        self.base = row["base"]

    def same(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist())


class Best:
    """The ``keep`` best (score, id, row number) seen so far."""

    def __init__(self, keep: int):
        self.keep, self.rows = keep, np.zeros((3, 0), np.int64)

    def floor(self) -> float:
        return float(self.rows[0, -1]) if self.rows.shape[1] >= self.keep else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        full = np.concatenate([self.rows, np.stack([score.astype(np.int64), ids, uid])], axis=1)
        self.rows = full[:, np.lexsort((full[2], full[1], -full[0]))[:self.keep]]


def scan(vector: np.ndarray, block: Block, candidates: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidates whose score may lie in [least, most], and their scores, reading one dimension after the other.

    The candidates are judged after every ``STEP`` dimensions by what the rest can still add.
    """
    vector = vector.astype(block.cols.dtype)
    order = np.argsort(-np.abs(vector), kind="stable")
    a, b = vector[order] * block.low[order], vector[order] * block.high[order]
    lowest = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0)
    highest = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0)
    part = np.zeros(len(candidates), block.cols.dtype)
    for at in range(0, len(order), STEP):
        d = order[at:at + STEP]
        part = part + vector[d] @ block.cols[d[:, None], candidates[None, :]]
        done = min(at + STEP, len(order))
        stay = (part + highest[done] >= least) & (part + lowest[done] <= most)
        if not stay.all():
            candidates, part = candidates[stay], part[stay]
        if not len(candidates):
            break
    return candidates, part


def _positives(anchor: dict, block: Block, state: dict, keep: int) -> None:
    best = state.setdefault((anchor["uid"], None), Best(keep))
    lo, hi = block.same(anchor["label"])
    rows = np.arange(lo, hi)
    rows = rows[rows + block.base != anchor["uid"]]
    if len(rows):
        got, score = scan(anchor["v"], block, rows, best.floor(), np.inf)
        if len(got):
            best.add(score, block.ids[got], got + block.base)


def _negatives(anchor: dict, block: Block, state: dict, keep: int) -> None:
    open_ = [(-(-4 * p // 5), p, state.setdefault((anchor["uid"], p), Best(keep))) for p in anchor["windows"] if p >= 0]
    if not open_:
        return
    lo, hi = block.same(anchor["label"])
    rows = np.concatenate([np.arange(lo), np.arange(hi, len(block.labels))])
    if not len(rows):
        return
    least = min(max(low, best.floor()) for low, _, best in open_)
    got, score = scan(anchor["v"], block, rows, least, max(p for _, p, _ in open_))
    for low, p, best in open_:
        inside = (score >= max(low, best.floor())) & (score <= p)
        if inside.any():
            best.add(score[inside], block.ids[got[inside]], got[inside] + block.base)


def meet(anchors: DataFrame, blocks: DataFrame, keep: int, judge, stripes: int, parts: int) -> DataFrame:
    """uid, opened (the window's positive score, null for positives), score, id, row: each cell's best, ``keep`` per key."""
    stripe = F.pmod(F.xxhash64("uid"), F.lit(stripes))
    part = F.pmod(F.xxhash64("base"), F.lit(parts))
    windows = F.col("windows") if "windows" in anchors.columns else F.lit(None).cast("array<long>")
    left = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"), stripe.alias("_s"), "uid", "label", "dims",
                          "data", windows.alias("windows")).select(
        (F.col("_s") * parts + F.col("_p")).alias("cell"), F.lit(0).alias("kind"), "uid", "label", "dims", "data", "windows",
        F.lit(1).alias("n"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("labels"))
    right = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("_s"), part.alias("_p"), "*").select(
        (F.col("_s") * parts + F.col("_p")).alias("cell"), F.lit(1).alias("kind"), F.col("base").alias("uid"),
        F.lit(None).cast("long").alias("label"), "dims", "data", F.lit(None).cast("array<long>").alias("windows"), "n", "ids", "labels")
    rows = left.unionByName(right).repartition(stripes * parts, "cell").sortWithinPartitions("cell", "kind", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, state = None, [], {}

        def results() -> pa.RecordBatch:
            out = [(u, p, *r) for (u, p), best in state.items() for r in best.rows.T.tolist()]
            u, p, s, k, r = zip(*out) if out else ([],) * 5
            return pa.RecordBatch.from_arrays([
                pa.array(u, pa.int64()), pa.array(p, pa.int64()), pa.array(s, pa.int64()),
                pa.array([None if x == NO_ID else x for x in k], pa.int64()), pa.array(r, pa.int64())],
                names=["uid", "opened", "score", "id", "row"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != cell:
                    yield results()
                    cell, held, state = r["cell"], [], {}
                if r["kind"] == 0:
                    held.append({"uid": r["uid"], "label": r["label"], "windows": r["windows"],
                                 "v": np.frombuffer(r["data"], np.int64)})
                    continue
                if not held:
                    continue
                dims = max([r["dims"], *(len(a["v"]) for a in held)])
                peak = max(int(np.abs(a["v"]).max(initial=0)) for a in held)
                block = Block({**r, "base": r["uid"]}, dims, peak)
                for a in held:
                    if len(a["v"]) < dims:
                        a["v"] = np.concatenate([a["v"], np.zeros(dims - len(a["v"]), np.int64)])
                    judge(a, block, state, keep)
        yield results()

    return rows.mapInArrow(tidy(run), "uid long, opened long, score long, id long, row long")


def _best(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The ``keep`` best of each key over all cells, in order."""
    order = F.struct((-F.col("score")).alias("down"), F.col("id").isNull().alias("none"), "id", "row")
    return found.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(order)), 1, keep).alias("best"))


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, scale: int = 256, every: int = 100, modulus: int = 7,
                   classes: int = 10, block_rows: int = 4096, stripe_bytes: int = 32 << 20, parts: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's first ``positives`` rows of its label open windows: of the rows of other labels whose score is at
    most the positive's and at least four fifths of it, the first ``negatives`` are returned. ``modulus`` and
    ``classes`` say which labels are moved on before.
    """
    spark = rows.sparkSession
    ship(spark)
    blocks = stored(packed(whole_vectors(rows, scale, every, modulus, classes), block_rows))
    anchors = stored(anchors_of(blocks, every))
    size = anchors.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    stripes = max(1, -(-size // stripe_bytes))
    parts = parts or max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism))
    near = stored(_best(meet(anchors, blocks, positives, _positives, stripes, parts), ["uid"], positives))
    opened = near.select("uid", F.array_distinct(F.transform("best", lambda x: -x["down"])).alias("windows"))
    asking = stored(anchors.join(opened, "uid"))
    found = _best(meet(asking, blocks, negatives, _negatives, stripes, parts), ["uid", "opened"], negatives)
    pairs = anchors.select("uid", F.col("vec_id").alias("anchor_id")).join(near, "uid").select(
        "uid", "anchor_id", F.explode("best").alias("p")).select(
        "uid", "anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.down")).alias("positive_score"))
    return (pairs.join(found, (pairs["uid"] == found["uid"]) & (pairs["positive_score"] == found["opened"]))
            .select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "x"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"),
                    "positive_score", (-F.col("x.down")).alias("negative_score")))
