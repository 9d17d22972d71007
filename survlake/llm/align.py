"""Alignment of the tokens that two tokenizers give for the same text, by as-of merges per batch.

Side A is a byte-level BPE file, side B a sentence-piece model that sets a space before the
text; both cut the bytes of space + text. In a batch of texts each token has its document and
the offset at which it starts. An as-of merge of A's starts on B's starts, keyed by document,
gives the B token that covers each A token's start; the merge the other way gives the A token
that covers each B token's start. The union of both is every overlapping pair. Pairs whose
ends are equal close a group: up to there both sides have cut the same bytes. Such pairs are
the links. How often two ids are linked is counted over all documents (combined in the tasks
before the shuffle), and each document's links are then looked up in the counts: the counts of
all pairs are sent to the tasks only if their counted number is below a bound, and joined on a
salted key beyond it.

Byte-level tokens come from the library that works on ranks, with the ranks read from the
file: its merges are in order of ids, which is checked, and a test holds the two libraries
against each other; a file that is not of this kind is encoded by its own library.

Defined results: null and empty text, and text whose tokens' bytes on either side differ from
space + text, have no tokens: all numbers 0 and no groups. Strings of special tokens are plain
text. Repeated rows are aligned and counted each; a null doc_id is kept; an empty table gives no
rows; further columns are ignored. Whole texts are encoded, a very long one alone in its batch.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survlake.llm.bpe import byte_letters
from survlake.llm.tables import ship, stored, tidy

BATCH_CHARS = 1 << 18   # of text aligned at once; a longer text stands alone
HELD = 1 << 21          # links a task counts before it gives the counts on
SENT = 4_000_000        # id pairs up to which their counts are sent to the tasks (48 MB)


class ByteLevel:
    """Ids and bytes of a byte-level BPE file (side A)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i not in added}
        self.size = max([*vocab.values(), *added]) + 1
        self.bytes = [b""] * self.size
        for raw, i in ranks.items():
            self.bytes[i] = raw
        joined = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in merges]
        plain = (spec["normalizer"] is None and spec["pre_tokenizer"].get("type") == "ByteLevel"
                 and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space")
                 and all(vocab.get(t) == 256 + i for i, t in enumerate(joined)))
        if plain:
            import public_tokenizers
            import tiktoken

            one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [one.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            tok.no_truncation()
            tok.no_padding()
            self.encode = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Ids and bytes of a sentence-piece model (side B)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in ((i, model.id_to_piece(i)) for i in range(self.size))]
        self.encode = lambda texts: model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple:
    """Both tokenizers and the lengths of their tokens."""
    a, b = ByteLevel(path_a), Pieces(path_b)
    return a, b, np.array([len(x) for x in a.bytes]), np.array([len(x) for x in b.bytes])


class Aligned:
    """The tokens of a batch of texts, text after text, and how they overlap.

    ``a, b`` ids; ``na, nb`` tokens per text; ``end_a, end_b`` offsets over the whole batch;
    ``over`` overlapping pairs of positions; ``link`` those that end together; ``group_a, group_b``
    the group of each token, numbered over the batch; ``groups`` per text.
    """

    def __init__(self, texts: list[str | None], path_a: str, path_b: str):
        side_a, side_b, len_a, len_b = sides(path_a, path_b)
        some = [i for i, t in enumerate(texts) if t]
        kept = [texts[i] for i in some]
        ids_a, ids_b = side_a.encode([" " + t for t in kept]), side_b.encode(kept)
        lists = [([], [])] * len(texts)
        for i, t, x, y in zip(some, kept, ids_a, ids_b):
            raw = b" " + t.encode("utf-8", "surrogatepass")
            if b"".join(map(side_a.bytes.__getitem__, x)) == raw and b"".join(map(side_b.bytes.__getitem__, y)) == raw:
                lists[i] = (x, y)
        self.na, self.nb = (np.array([len(p[k]) for p in lists], np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([np.array(p[k], np.int64) for p in lists] or [np.zeros(0, np.int64)]) for k in (0, 1))
        size_a, size_b = len_a[self.a], len_b[self.b]
        self.end_a, self.end_b = np.cumsum(size_a), np.cumsum(size_b)   # texts cover the same bytes on both sides
        start_a, start_b = self.end_a - size_a, self.end_b - size_b
        doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (self.na, self.nb))
        i = _covering(doc_a, start_a, doc_b, start_b)                   # for each A token a B token
        j = _covering(doc_b, start_b, doc_a, start_a)                   # for each B token an A token
        new = start_a[j] != start_b                                     # else both directions give the pair
        self.over = (np.concatenate([np.arange(len(i)), j[new]]), np.concatenate([i, np.flatnonzero(new)]))
        ends = self.end_a[self.over[0]] == self.end_b[self.over[1]]
        at = np.argsort(self.over[0][ends], kind="stable")
        self.link = self.over[0][ends][at], self.over[1][ends][at]
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.link[0]], last_b[self.link[1]] = True, True
        self.last_a, self.last_b = last_a, last_b
        self.group_a, self.group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        self.groups = np.bincount(doc_a[last_a], minlength=len(texts))
        self.links = np.bincount(doc_a[self.link[0]], minlength=len(texts))

    def rendered(self, names: list[str], wide: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text; ``names`` has every id with ',', then with '|', then with ';'."""
        n = int(self.group_a[-1]) + 1 if len(self.a) else 0
        in_a, in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        mixed = np.zeros(len(self.a) + len(self.b), np.int64)
        mixed[np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]] = self.a + wide * self.last_a
        mixed[np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]] = self.b + 2 * wide * self.last_b
        cuts = np.cumsum(self.na + self.nb)
        return ["".join(map(names.__getitem__, mixed[lo:hi].tolist()))[:-1] for lo, hi in zip(np.append(0, cuts[:-1]), cuts)]


def _covering(doc: np.ndarray, at: np.ndarray, other_doc: np.ndarray, other_at: np.ndarray) -> np.ndarray:
    """For each token the other side's last token of the same text that starts at or before it."""
    if not len(at):
        return np.zeros(0, np.int64)
    left = pd.DataFrame({"doc": doc, "at": at})
    right = pd.DataFrame({"doc": other_doc, "at": other_at, "token": np.arange(len(other_at))})
    return pd.merge_asof(left, right, on="at", by="doc")["token"].to_numpy(np.int64)


@lru_cache(maxsize=2)
def _names(wide: int) -> list[str]:
    return [f"{i}{mark}" for mark in ",|;" for i in range(wide)]


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about ``BATCH_CHARS`` characters."""
    texts = column.to_pylist()
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS or i - lo >= 2048:
            yield lo, texts[lo:i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def overlaps(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a_ids, b_ids, pairs (positions of overlapping tokens, in order) and groups ([a tokens, b tokens] of each)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _runs(batch.column(1)):
                x = Aligned(texts, path_a, path_b)
                rows, at, bt, g = [], 0, 0, 0
                by = np.lexsort((x.over[1], x.over[0]))
                over = x.over[0][by], x.over[1][by]
                cut = np.searchsorted(over[0], np.append(0, np.cumsum(x.na)))
                for k, (na, nb) in enumerate(zip(x.na.tolist(), x.nb.tolist())):
                    mine = slice(cut[k], cut[k + 1])
                    n = int(x.groups[k])
                    sizes = zip(np.bincount(x.group_a[at:at + na] - g, minlength=n).tolist(), np.bincount(x.group_b[bt:bt + nb] - g, minlength=n).tolist())
                    rows.append((x.a[at:at + na].tolist(), x.b[bt:bt + nb].tolist(),
                                 [{"a": int(i) - at, "b": int(j) - bt} for i, j in zip(over[0][mine], over[1][mine])],
                                 [list(s) for s in sizes]))
                    at, bt, g = at + na, bt + nb, g + n
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(texts)), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.list_(pa.int32())),
                    pa.array(cols[2], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(cols[3], pa.list_(pa.list_(pa.int32())))],
                    names=["doc_id", "a_ids", "b_ids", "pairs", "groups"])

    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), f"doc_id {kind}, a_ids array<int>, b_ids array<int>, pairs array<struct<a int, b int>>, groups array<array<int>>")


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links: the packed id pairs (a · size of B + b, 8 bytes each, sorted)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b, _, _ = sides(path_a, path_b)
        wide = max(side_a.size, side_b.size)
        names = _names(wide)
        for batch in batches:
            for lo, texts in _runs(batch.column(1)):
                x = Aligned(texts, path_a, path_b)
                code = x.a[x.link[0]] * side_b.size + x.b[x.link[1]]
                by = np.lexsort((code, np.repeat(np.arange(len(texts)), x.links)))
                code, cuts = code[by], np.cumsum(x.links)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(texts)), pa.array(x.na), pa.array(x.nb), pa.array(x.groups.astype(np.int64)), pa.array(x.links.astype(np.int64)),
                    pa.array([hashlib.sha256(r.encode()).hexdigest() if r else "" for r in x.rendered(names, wide)], pa.string()),
                    pa.array([code[s:e].tobytes() for s, e in zip(np.append(0, cuts[:-1]), cuts)], pa.binary())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """code, n: links of a task, combined as far as ``HELD`` of them are held."""
    held, size = [], 0

    def emit() -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    for batch in batches:
        for x in batch.column(0).to_pylist():
            held.append(np.frombuffer(x, np.int64))
            size += len(held[-1])
            if size >= HELD:
                yield emit()
                held, size = [], 0
    if held:
        yield emit()


def align(docs: DataFrame, path_a: str, path_b: str, sent: int = SENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``sent`` bounds the number of id pairs whose counts are sent to all tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    width = sides(path_a, path_b)[1].size
    rows = stored(linked(docs, path_a, path_b).withColumn("_row", F.monotonically_increasing_id()))
    counts = stored(rows.where("n_links > 0").select("links").mapInArrow(tidy(_counted), "code long, n long")
                    .groupBy("code").agg(F.sum("n").alias("n")))
    # one row per id of side B: its vocabulary bounds them
    highest = counts.groupBy((F.col("code") % width).alias("b")).agg(F.max("n").alias("most"))
    judged = stored(counts.join(F.broadcast(highest), F.col("code") % width == F.col("b")).select(
        "code", "n", (F.col("n") == F.col("most")).alias("best")))
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if judged.count() <= sent:
        table = judged.sort("code").toArrow()
        code, n = table["code"].to_numpy(), table["n"].to_numpy()
        known = spark.sparkContext.broadcast((code, np.where(table["best"].to_numpy(zero_copy_only=False), -n, n)))  # sign: is it best?
        kind = docs.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, n = known.value
            for batch in batches:
                best, total = [], []
                for x in batch.column(6).to_pylist():
                    got = n[np.searchsorted(code, np.frombuffer(x, np.int64))] if x else np.zeros(0, np.int64)
                    best.append(int((got < 0).sum()))
                    total.append(int(np.abs(got).sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(best, pa.int64()), pa.array(total, pa.int64()), batch.column(5)], names=out)

        return rows.drop("_row").mapInArrow(
            tidy(run), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code, times = np.unique(np.frombuffer(x, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), row)), pa.array(code), pa.array(times.astype(np.int64))],
                                                 names=["row", "code", "times"])

    salts = 64   # a pair that nearly every document has is spread over so many tasks
    asked = rows.where("n_links > 0").select("_row", "links").mapInArrow(unpack, "row long, code long, times long").withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    told = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    sums = asked.join(told, ["code", "salt"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return rows.join(sums, rows["_row"] == sums["row"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
