"""Coefficient tables side by side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cox import CoxModel


def stack_summaries(models: Mapping[str, CoxModel], name: str) -> DataFrame:
    """Long table ``(name, term, coef, hr, …)`` of several fits."""
    out = None
    for label, model in models.items():
        part = model.summary().withColumn(name, F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def endpoint_table(models: Mapping[str, CoxModel]) -> DataFrame:
    """One row per term: ``<endpoint>_hr, <endpoint>_lower, <endpoint>_upper``."""
    long = stack_summaries(models, "endpoint")
    return long.groupBy("term").pivot("endpoint", list(models)).agg(
        F.max("hr").alias("hr"), F.max("lower").alias("lower"), F.max("upper").alias("upper"))


def significance_mark(summary: DataFrame, alpha: float = 0.05, digits: int = 2, mark: str = "*") -> DataFrame:
    """Add ``significant`` (0/1) and ``text``: the hazard ratio, marked when ``p < alpha``."""
    hit = F.coalesce(F.col("p") < alpha, F.lit(False))
    return summary.withColumns({
        "significant": hit.cast("int"),
        "text": F.concat(F.format_string(f"%.{digits}f", F.bround("hr", digits)),
                         F.when(hit, mark).otherwise("")),
    })


def all_models_table(models: Mapping[str, CoxModel], alpha: float = 0.05,
                     labels: Mapping[str, str] | None = None) -> DataFrame:
    """Every model side by side, one row per term, blank where a model lacks it."""
    long = significance_mark(stack_summaries(models, "model"), alpha)
    wide = long.groupBy("term").pivot("model", list(models)).agg(F.max("text")).fillna("")
    if labels:
        names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        wide = wide.withColumn("label", F.coalesce(F.try_element_at(names, F.col("term")), F.col("term")))
    return wide
