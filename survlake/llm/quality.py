"""Quality selection by importance resampling over hashed n-grams.

Two generative models are counted: one of target text (documents labelled as good and
not toxic) and one of raw text (all documents). Both are multinomials over ``buckets``
hash buckets of word unigrams and bigrams, with add-``smooth`` counts. A document's log
importance weight is the sum over its n-grams of log(target / raw). Adding Gumbel noise
(a hash of the document's key and ``seed``, so it is repeatable) and taking the k largest
is sampling k documents without replacement in proportion to the weights.

k is a share of all documents: given, or else the share of good ones among the labelled.
The k-th largest value is found exactly with counts over ever finer ranges of the sort
key (radix selection): no sort, no ranking in one task.

Defined results: null or empty text has weight 0; a document with several labels is
good if all of them are; labels without document are ignored; without good labels all
weights are 0; equal keys at the border go by doc_id, then by hash of the text, and rows
equal in both stand or fall together; null doc_id sorts last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survlake.llm.tables import ship, stored, tidy
from survlake.llm.tokens import mix, text_blocks, words


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram, and the text it is in."""
    h, n, _ = words(data, offsets)
    row = np.repeat(np.arange(len(n)), n)
    same = row[1:] == row[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[same]
    m = np.uint64(buckets)
    return np.concatenate([h % m, pair % m]).astype(np.intp), np.concatenate([row, row[1:][same]])


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts per bucket over the column ``text``: combined in the tasks, ``buckets`` numbers to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offs in text_blocks(b.column(0)):
                total += np.bincount(_grams(data, offs, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def texts_of(docs: DataFrame, ids: DataFrame, most_bits: int = 1 << 29) -> DataFrame:
    """The texts of documents whose doc_id is in ``ids`` (one row each).

    A Bloom filter over the ids (16 bits an id, two of them set, at most 64 MB) goes to the
    tasks first, so that the text of other documents is not shuffled, whatever size the tables have. A filter
    that is too full lets more through; the join on the ids decides.
    """
    bits = 1 << 16
    n = ids.count()
    while bits < min(16 * n, most_bits):
        bits *= 2
    spots = [F.xxhash64("doc_id", F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(2)]
    at = ids.select(F.explode(F.array(*spots)).alias("at"))
    words_ = at.groupBy(F.shiftright("at", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("set")).toArrow()
    filled = np.zeros(bits // 64, np.uint64)
    filled[words_["w"].to_numpy()] = words_["set"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    @F.arrow_udf("boolean")
    def maybe(first: pa.Array, second: pa.Array) -> pa.Array:
        ok = np.ones(len(first), bool)
        for x in (first, second):
            h = x.to_numpy(zero_copy_only=False).astype(np.int64)
            ok &= (sent.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pa.array(ok)

    return docs.select("doc_id", "text").where(maybe(*spots)).join(ids, "doc_id", "left_semi").select("text")


def largest(keyed: DataFrame, column: str, k: int, bits: int = 12) -> tuple[int, int]:
    """(threshold, number above it): rows whose long ``column`` exceeds the threshold are fewer than or equal to k,
    and with those equal to it at least k. Each pass counts 2**bits ranges."""
    # as unsigned numbers: the sign bit is turned over
    up = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    prefix, above, shift = None, 0, 64 - bits
    while True:
        part = keyed if prefix is None else keyed.where(F.shiftrightunsigned(up, shift + bits) == prefix)
        cell = F.shiftrightunsigned(up, shift)
        rows = part.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
        for c, n in sorted(((r["cell"], r["n"]) for r in rows), key=lambda x: x[0] % (1 << 64), reverse=True):
            if above + n >= k:
                break
            above += n
        if shift == 0:
            return c ^ -(1 << 63), above
        prefix, bits = c, min(bits, shift)
        shift -= bits


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = 1 << 16,
             smooth: float = 1.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, log_weight, selection_key (with its noise), selected."""
    ship(docs.sparkSession)
    marks = stored(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good")))
    if share is None:  # of the labelled documents: ids only
        share = docs.select("doc_id").join(marks, "doc_id").agg(F.avg(F.col("good").cast("double"))).first()[0]
        share = 1.0 if share is None else share
    raw = bucket_counts(docs, buckets)
    target = bucket_counts(texts_of(docs, marks.where("good").select("doc_id")), buckets)
    log = np.log((target + smooth) / (target.sum() + smooth * buckets)) - np.log((raw + smooth) / (raw.sum() + smooth * buckets))
    if not target.any():
        log[:] = 0
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, tie = np.zeros(b.num_rows), b.column(2)
            for lo, hi, data, offs in text_blocks(b.column(1)):
                g, row = _grams(data, offs, buckets)
                weight[lo:hi] = np.bincount(row, weights=log[g], minlength=hi - lo)
            u = (mix(np.array(b.column(3)).astype(np.int64).view(np.uint64) + np.uint64(seed)) >> np.uint64(11)) * 2.0 ** -53
            key = weight - np.log(-np.log(np.clip(u, 2.0 ** -54, 1 - 2.0 ** -53)))
            raw_bits = key.view(np.int64)
            order = np.where(raw_bits < 0, raw_bits ^ np.int64(0x7FFFFFFFFFFFFFFF), raw_bits)  # sorts as the doubles do
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight), pa.array(key), pa.array(order), tie],
                                             names=["doc_id", "log_weight", "selection_key", "_order", "_tie"])

    keyed = stored(docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_tie"),
                               F.xxhash64("doc_id").alias("_noise"))
                   .mapInArrow(tidy(run), f"doc_id {kind}, log_weight double, selection_key double, _order long, _tie long"))
    n = keyed.count()
    k = round(share * n)
    out = ["doc_id", "log_weight", "selection_key"]
    if k <= 0 or k >= n:
        return keyed.select(*out, F.lit(k > 0).alias("selected"))
    level, above = largest(keyed, "_order", k)
    edge = keyed.where(F.col("_order") == level).select("doc_id", "_tie").orderBy(F.asc_nulls_last("doc_id"), "_tie").limit(k - above)
    bound = edge.orderBy(F.desc_nulls_first("doc_id"), F.desc("_tie")).first()
    before = F.lit(True) if bound["doc_id"] is None else F.coalesce(F.col("doc_id") < bound["doc_id"], F.lit(False))
    tie = before | (F.col("doc_id").eqNullSafe(F.lit(bound["doc_id"])) & (F.col("_tie") <= bound["_tie"]))
    return keyed.select(*out, ((F.col("_order") > level) | ((F.col("_order") == level) & tie)).alias("selected"))
