"""Numpy kernels that run inside Spark tasks, one pass over a task's batches.

The module travels to the workers by value, so they need no copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _emit(total: np.ndarray, offset: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(offset, offset + len(total)), pa.int32()), pa.array(total, pa.float64())],
        ["i", "v"])


def _matrix(batch: pa.RecordBatch, first: int, p: int) -> np.ndarray:
    return np.column_stack([batch.column(first + j).to_numpy(zero_copy_only=False) for j in range(p)]) \
        if p else np.zeros((batch.num_rows, 0))


def cross_product(p: int, offset: int):
    """Σ h x xᵀ over the rows of a task; input columns ``_h, x0 …``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for b in batches:
            x = _matrix(b, 1, p)
            total += (x * b.column(0).to_numpy(zero_copy_only=False)[:, None]).T @ x
        yield _emit(total.ravel(), offset)
    return run


def time_sums(p: int, efron: bool):
    """Log-likelihood, Σ d·x̄ and the outer-product part of the information."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ll, mean, outer = 0.0, np.zeros(p), np.zeros((p, p))
        for b in batches:
            f, b0, a0, lq, lpd = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            ll += float(np.sum(lpd - f * lq))
            if not p:
                continue
            s = _matrix(b, 8 if efron else 5, p)
            mean += (f * b0) @ s
            outer += (s * (f * a0)[:, None]).T @ s
            if efron:
                b1, a1, a2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7))
                e = _matrix(b, 8 + p, p)
                mean -= (f * b1) @ e
                mixed = (s * (f * a1)[:, None]).T @ e
                outer += (e * (f * a2)[:, None]).T @ e - mixed - mixed.T
        yield _emit(np.concatenate([[ll], mean, -outer.ravel()]), 0)
    return run


def _steps(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct times of a chunk, ordered, and the matrix ``I + dA`` of each."""
    times, at = np.unique(pdf["time"].to_numpy(), return_inverse=True)
    steps = np.zeros((len(times), k, k))
    steps[at, pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["da"].to_numpy()
    steps[:, range(k), range(k)] = 1 - steps.sum(axis=2)
    return times, steps


def _running(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """``first`` and its products with ever more of the matrices, one more than there are matrices."""
    out = np.empty((len(steps) + 1, *first.shape))
    out[0] = first
    for n, step in enumerate(steps):
        out[n + 1] = out[n] @ step
    return out


def _columns(matrices: np.ndarray) -> dict[str, np.ndarray]:
    flat = matrices.reshape(len(matrices), -1)
    return {f"p{c}": flat[:, c] for c in range(flat.shape[1])}


def _matrices(pdf: pd.DataFrame, k: int, name: str = "p") -> np.ndarray:
    return pdf[[f"{name}{c}" for c in range(k * k)]].to_numpy().reshape(-1, k, k)


def chunk_product(k: int):
    """The ordered product of one chunk."""
    def run(key, pdf):
        return pd.DataFrame({"chunk": key[0], **_columns(_running(np.eye(k), _steps(pdf, k)[1])[-1:])})
    return run


def prefix_products(k: int):
    """Per block, along ``at``: the product of all matrices before each row; a row at -1 has that of the whole block."""
    def run(key, pdf):
        pdf = pdf.sort_values("at")
        return pd.DataFrame({"block": key[0], "at": [*pdf["at"], -1], **_columns(_running(np.eye(k), _matrices(pdf, k)))})
    return run


def chunk_path(k: int):
    """All products of one chunk, after the product of the blocks and of the chunks before it."""
    def run(pdf, before):
        first = _matrices(before, k, "b")[0] @ _matrices(before, k)[0] if len(before) else np.eye(k)
        times, steps = _steps(pdf, k)
        return pd.DataFrame({"time": times, **_columns(_running(first, steps)[1:])})
    return run
