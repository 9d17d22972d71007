"""Multi-state data, transition hazards and Aalen–Johansen probabilities."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import materialize
from .cox import CoxModel, cox_fit, fit_together
from .kernels import chunk_path, chunk_product, prefix_products
from .longitudinal import next_state
from .risk import nelson_aalen, resolve_splits, survival_response
from .scan import TIMES_PER_CHUNK, fits_broadcast, split_chunk


def transition_matrix(spark: SparkSession, states: Mapping[str, Sequence[str]]) -> DataFrame:
    """Numbered transitions ``(from, to, trans)``; ``states`` maps a state to its targets.

    Numbers run by source state, then by target, in the order given.
    """
    rows = [(a, b) for a, targets in states.items() for b in targets]
    return spark.createDataFrame(
        [(a, b, i) for i, (a, b) in enumerate(rows, 1)], "from string, to string, trans int")


def assign_states(cp: DataFrame, state: Column, id: str, order_by: Sequence[str],
                  terminal: Column, chunk: Column | None = None) -> DataFrame:
    """Add ``from`` (null where unknown) and ``to_event``, the state that follows.

    ``terminal`` is the absorbing state reached at the end of the row, or null.
    """
    return next_state(cp.withColumn("from", state), id, order_by, "from", "to_event", terminal, chunk)


def expand_transitions(states: DataFrame, tmat: DataFrame) -> DataFrame:
    """One row per transition a row is at risk for, with ``to, trans, status``.

    One join with the (handful of) transitions instead of a copy of the data per
    target; rows in an unknown or absorbing state have none and drop out. The
    transitions are counted before they are sent to every task.
    """
    out = states.join(F.broadcast(tmat) if fits_broadcast(tmat.count(), 8) else tmat, "from")
    return out.withColumn("status", F.coalesce((F.col("to") == F.col("to_event")).cast("int"), F.lit(0)))


def transition_hazards(rows: DataFrame, start: str = "start_time", stop: str = "end_time",
                       splits="auto") -> DataFrame:
    """Cumulative hazard per transition: ``(trans, from, to, time, n_risk, n_event, hazard)``."""
    resp = survival_response(rows, stop, "status", 1, start=start)
    return nelson_aalen(resp, ["trans", "from", "to"], splits=splits)


def transition_probabilities(hazards: DataFrame, states: Mapping[str, Sequence[str]],
                             from_time: int = 0, splits="auto") -> DataFrame:
    """Aalen–Johansen ``P(from_time, t)``: ``(time, from, to, prob)``.

    Ordered product of ``I + dA(t)`` over the times after ``from_time``. Matrix products are associative, so
    the scan has levels: times are cut into chunks and each chunk's product is taken in its own task; about
    as many chunks make a block as there are blocks, and products before each chunk of a block and before each block
    are taken likewise; each chunk is then replayed from its prefix. Nothing is collected: no task holds more than
    a chunk's times or the square root of the number of chunks.
    """
    names = list(states)
    k = len(names)
    pos = {s: i for i, s in enumerate(names)}
    steps = hazards.where((F.col("n_event") > 0) & (F.col("time") > from_time)).select(
        "time", _position("from", pos).alias("i"), _position("to", pos).alias("j"),
        (F.col("n_event") / F.col("n_risk")).alias("da"))
    steps, _ = materialize(steps)        # distinct times only; read again when the result is
    if splits == "auto" and steps.count() <= TIMES_PER_CHUNK:
        splits = []
    splits = resolve_splits(steps, "time", splits)
    steps = split_chunk(steps, "time", splits, "chunk")
    kinds = ", ".join(f"p{c} double" for c in range(k * k))
    time_type = hazards.schema["time"].dataType.simpleString()
    path_kind = f"time {time_type}, {kinds}"
    if splits:
        path = steps.groupBy("chunk").cogroup(_before_chunks(steps, k, len(splits) + 1).groupBy("chunk")).applyInPandas(
            chunk_path(k), path_kind)
    else:
        alone = chunk_path(k)
        path = steps.groupBy("chunk").applyInPandas(lambda pdf: alone(pdf, pdf[:0]), path_kind)
    return path.select("time", F.explode(F.array(*[
        F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.col(f"p{i * k + j}").alias("prob"))
        for i, a in enumerate(names) for j, b in enumerate(names)])).alias("_s")).select("time", "_s.*")


def _before_chunks(steps: DataFrame, k: int, chunks: int) -> DataFrame:
    """Per chunk the products ``b`` of the blocks before its own and ``p`` of the chunks of its block before it."""
    cells = [f"p{c}" for c in range(k * k)]
    kinds = ", ".join(f"{c} double" for c in cells)
    ends = steps.groupBy("chunk").applyInPandas(chunk_product(k), f"chunk int, {kinds}")
    width = math.isqrt(chunks - 1) + 1
    in_block = ends.select(F.floor(F.col("chunk") / width).cast("int").alias("block"), F.col("chunk").alias("at"), *cells)
    in_block = in_block.groupBy("block").applyInPandas(prefix_products(k), f"block int, at int, {kinds}")
    blocks = in_block.where("at = -1").select(F.lit(0).alias("block"), F.col("block").alias("at"), *cells)
    blocks = blocks.groupBy("block").applyInPandas(prefix_products(k), f"block int, at int, {kinds}").where("at >= 0")
    return in_block.where("at >= 0").withColumnRenamed("at", "chunk").join(
        blocks.select(F.col("at").alias("block"), *[F.col(c).alias(f"b{c[1:]}") for c in cells]), "block")


def _position(col: str, pos: Mapping[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pos.items() for x in kv]), F.col(col))


def probabilities_long(probs: DataFrame, outcomes: Sequence[str], sources: Sequence[str],
                       labels: Mapping[str, str] | None = None) -> DataFrame:
    """Probabilities of the chosen outcomes: ``(time, prob, from, outcome)``, labelled by state."""
    out = probs.where(F.col("to").isin(list(outcomes)) & F.col("from").isin(list(sources)))
    names = F.create_map(*[F.lit(x) for s in {*outcomes, *sources}
                           for x in (s, (labels or {}).get(s, s))])
    return out.select("time", "prob", names[F.col("from")].alias("from"), names[F.col("to")].alias("outcome"))


def transition_cox(rows: DataFrame, terms: Sequence[str], transitions: Sequence[int],
                   start: str = "start_time", stop: str = "end_time", **options) -> dict[int, CoxModel]:
    """Cox model per transition number, Breslow ties, on the rows at risk for it."""
    def fit(trans):
        return lambda: cox_fit(rows.where(F.col("trans") == trans), stop, "status", terms, start=start,
                               ties="breslow", **options)
    return fit_together({t: fit(t) for t in transitions})
