"""Scoring with class-based bigrams (Brown et al.), classes found by exchange.

Every word with at least ``least`` training tokens (a fixed small number, alike at every size of
corpus) has a class that its own contexts decide; rarer and unseen words, of which there is next to no
context, share the items of their last two bytes, and the end of a text is an item with a class of its
own. A pass over the corpus counts, for each item, the classes of its left and right neighbours; then
items are exchanged: each moves to the class with the largest exact gain in the likelihood of the
class bigrams, half of the items at a time (all moves of a turn are judged against the same counts).
Turns go on until a sweep over both halves gains less than ``settled`` nats a token, then the counts are
taken anew with the new classes; the exchange ends when such a round gains less than that. (A class
bigram's likelihood is bounded, so both end.) The text's score is

    sum over tokens of log10( P(class | class before) * P(word | class) )

with P(word | class) = (c + 0.1) / (N_class + 0.1 (V_class + 1)), where c counts the word
itself, whether or not it is an item, and transitions are smoothed towards the class unigram.

The vocabulary, the classes and the context counts stay distributed in buckets of words and grow with
the corpus. Documents are dealt into chunks and coded once as numbers of the chunk's distinct words;
from then on chunks ask the buckets for counts and classes of these, and send context counts back. The
driver sees totals by class and the classes of the 65,536 endings only.

Defined results: null or empty text is one end token; rows with a null doc_id are not held
out (and are learned from); repeated rows count each; with nothing to learn from, N is 0 and the
base score 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survlake.llm.tables import freed, ship, stored, text_bytes, tidy
from survlake.llm.tokens import mix, text_blocks, words

TAILS = 1 << 16
SPREAD = 8             # buckets of the endings, after those of the words
POOLED = 0xFFFFFFFF    # place of a word without a class of its own
MERGED = 256           # chunks whose counts of endings are added up at once
SMOOTH = 0.1


def _packed(raw: np.ndarray) -> bytes:
    data = raw.tobytes()
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(block: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(block[4:], int.from_bytes(block[:4], "little"), "zstd", asbytes=True), kind)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of equal keys; keys sorted."""
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)


def vocabulary(train: DataFrame, buckets: int) -> DataFrame:
    """Packed rows (bucket, hash, count, tail, n_words, n_tokens) of all words of ``train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        tails: dict = {}

        def flush() -> pa.RecordBatch:
            h, c = _add(*held)
            t = tails["all"] if len(tails.get("h", ())) else np.zeros(0, np.uint16)
            t = t[np.searchsorted(tails["h"], h)] if len(h) else t
            b = _bucket(h, buckets)
            by = np.argsort(b, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], b[by][1:] != b[by][:-1], [True]])) if len(by) else np.zeros(0, np.int64)
            rows = [(int(b[by[lo]]), _packed(h[by[lo:hi]]), _packed(c[by[lo:hi]].astype(np.uint32)), _packed(t[by[lo:hi]]))
                    for lo, hi in zip(edge[:-1], edge[1:])]
            cols = list(zip(*rows)) or [[]] * 4
            held[0].clear(), held[1].clear(), tails.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])],
                                              names=["bucket", "h", "c", "t"])

        size = 0
        for batch in batches:
            for _, _, data, offs in text_blocks(batch.column(0)):
                h, _, tail = words(data, offs)
                u, one, n = np.unique(h, return_index=True, return_counts=True)
                held[0].append(u)
                held[1].append(n)
                old = tails.get("h", np.zeros(0, np.uint64))
                both, first = np.unique(np.concatenate([old, u]), return_index=True)
                tails["all"] = np.concatenate([tails.get("all", np.zeros(0, np.uint16)), tail[one]])[first]
                tails["h"] = both
                size += len(u)
                if size > 4_000_000:
                    yield flush()
                    size = 0
        if held[0]:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        hs = [_unpacked(x, np.uint64) for x in table["h"].to_pylist()]
        h, one, inverse = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate([_unpacked(x, np.uint32) for x in table["c"].to_pylist()])).astype(np.int64)
        t = np.concatenate([_unpacked(x, np.uint16) for x in table["t"].to_pylist()])[one]
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "h": pa.array([_packed(h)], pa.binary()),
                         "c": pa.array([_packed(c)], pa.binary()), "t": pa.array([_packed(t)], pa.binary()),
                         "n_words": pa.array([len(h)], pa.int64()), "n_tokens": pa.array([int(c.sum())], pa.int64())})

    return stored(train.select("text").mapInArrow(run, "bucket int, h binary, c binary, t binary").groupBy("bucket")
                  .applyInArrow(total, "bucket int, h binary, c binary, t binary, n_words long, n_tokens long"))


def _sequence(n: np.ndarray, items: np.ndarray, end: int) -> np.ndarray:
    """Items of all texts with the end before the first and after each."""
    stop = np.cumsum(n) + np.arange(len(n))
    out = np.full(int(n.sum()) + len(n) + 1, end, np.int64)
    inner = np.ones(len(out) - 1, bool)
    inner[stop] = False
    out[1:][inner] = items
    return out


def _edges(b: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal numbers."""
    edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(0, np.int64)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def _coded(rows: DataFrame, chunks: int, kind: str) -> DataFrame:
    """One row per chunk: its documents, words of each, and the text as places in ``h``, its words by bucket."""

    def code(table: pa.Table) -> pa.Table:
        hs, ns, ts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
        for _, _, data, offs in text_blocks(table["text"]):
            h, n, t = words(data, offs)
            hs.append(h), ns.append(n), ts.append(t)
        own, first, seq = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        by = np.argsort(_bucket(own, chunks), kind="stable")
        place = np.empty(len(own), np.uint32)
        place[by] = np.arange(len(own))
        size = pa.array([0, table.num_rows], pa.int32())
        whole = [pa.ListArray.from_arrays(size, table[c].combine_chunks()) for c in ("doc_id", "held_out")]
        cells = (np.concatenate(ns).astype(np.uint32), place[seq], own[by], np.concatenate(ts)[first][by])
        return pa.table([pa.array([table["chunk"][0].as_py()], pa.int32()), *whole, *(pa.array([_packed(x)], pa.binary()) for x in cells)],
                        names=["chunk", "docs", "held", "n", "seq", "h", "tail"])

    chunk = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int")
    return stored(rows.withColumn("chunk", chunk).groupBy("chunk").applyInArrow(
        freed(code), f"chunk int, docs array<{kind}>, held array<boolean>, n binary, seq binary, h binary, tail binary"))


def _places(coded: DataFrame, vocab: DataFrame, chunks: int, least: int) -> DataFrame:
    """(chunk, bucket, c, place): training count of each of a chunk's words and its place among its bucket's classes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = _unpacked(x, np.uint64)
                b = _bucket(h, chunks)
                cut = _edges(b)
                yield pa.RecordBatch.from_arrays([pa.array([int(b[lo]) for lo, _ in cut], pa.int32()), pa.array([chunk] * len(cut), pa.int32()),
                                                  pa.array([h[lo:hi].tobytes() for lo, hi in cut], pa.binary())], names=["bucket", "chunk", "ask"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        h, c = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        if right.num_rows:
            h, c = _unpacked(right["h"][0].as_py(), np.uint64), _unpacked(right["c"][0].as_py(), np.int64)
        kept = c >= least
        place = np.where(kept, np.cumsum(kept) - 1, POOLED).astype(np.uint32)
        counts, places = [], []
        for x in left["ask"].to_pylist():
            q = np.frombuffer(x, np.uint64)
            at = np.minimum(np.searchsorted(h, q), len(h) - 1)
            known = (h[at] == q) & (c[at] > 0)
            counts.append(_packed(np.where(known, c[at], 0)))
            places.append(_packed(np.where(known, place[at], POOLED).astype(np.uint32)))
        return pa.table({"chunk": left["chunk"].cast(pa.int32()), "bucket": left["bucket"].cast(pa.int32()),
                         "c": pa.array(counts, pa.binary()), "place": pa.array(places, pa.binary())})

    asked = coded.select("chunk", "h").mapInArrow(tidy(ask), "bucket int, chunk int, ask binary")
    return stored(asked.groupBy("bucket").cogroup(vocab.select("bucket", "h", "c").groupBy("bucket")).applyInArrow(
        answer, "chunk int, bucket int, c binary, place binary"))


def _started(vocab: DataFrame, chunks: int, least: int, k: int) -> DataFrame:
    """(bucket, cls): a class by hash for each word with a class of its own; buckets of endings after those of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, h, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = _unpacked(h, np.uint64)[_unpacked(c, np.int64) >= least]
                cls = (mix(own) % np.uint64(k)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_packed(cls)], pa.binary())], names=["bucket", "cls"])

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                item = np.arange(i, TAILS + 1, SPREAD, dtype=np.uint64)
                cls = np.where(item == TAILS, k, mix(item) % np.uint64(k)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([chunks + i], pa.int32()), pa.array([_packed(cls)], pa.binary())], names=["bucket", "cls"])

    words_ = vocab.select("bucket", "h", "c").mapInArrow(run, "bucket int, cls binary")
    return stored(words_.unionByName(vocab.sparkSession.range(SPREAD).mapInArrow(endings, "bucket int, cls binary")))


def _endings(state: DataFrame, chunks: int) -> np.ndarray:
    """Classes of all endings and of the end of a text: a fixed 65,537 bytes."""
    out = np.zeros(TAILS + 1, np.uint8)
    for r in state.where(F.col("bucket") >= chunks).collect():
        out[r["bucket"] - chunks::SPREAD] = _unpacked(r["cls"], np.uint8)
    return out


def _told(places: DataFrame, state: DataFrame) -> DataFrame:
    """``places`` with the class of each word (255: that of its ending)."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        cls = _unpacked(right["cls"][0].as_py(), np.uint8) if right.num_rows else np.zeros(0, np.uint8)
        cls = np.append(cls, np.uint8(255))
        got = [_packed(cls[np.minimum(_unpacked(x, np.uint32), len(cls) - 1)]) for x in left["place"].to_pylist()]
        return pa.table([*(left[c].cast(t) for c, t in (("chunk", pa.int32()), ("bucket", pa.int32()), ("c", pa.binary()), ("place", pa.binary()))),
                         pa.array(got, pa.binary())], names=["chunk", "bucket", "c", "place", "cls"])

    return places.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(
        look, "chunk int, bucket int, c binary, place binary, cls binary")


class _Chunk:
    """A chunk as its coded row and the rows of its words: items, classes and counts of its words, its documents' words."""

    def __init__(self, coded: pa.Table, told: pa.Table, tails: np.ndarray, chunks: int):
        cell = lambda name, kind: _unpacked(coded[name][0].as_py(), kind)
        self.n, self.seq, tail = cell("n", np.uint32).astype(np.int64), cell("seq", np.uint32), cell("tail", np.uint16)
        rows = np.argsort(told["bucket"].to_numpy(), kind="stable").tolist()
        joined = lambda name, kind: np.concatenate(
            [np.zeros(0, kind)] + [_unpacked(told[name][i].as_py(), kind) for i in rows])
        place, cls, self.c = joined("place", np.uint32), joined("cls", np.uint8), joined("c", np.int64)
        pooled = place == POOLED
        lengths = [len(_unpacked(told["place"][i].as_py(), np.uint32)) for i in rows]
        bucket = np.repeat(np.array([told["bucket"][i].as_py() for i in rows], np.int64), lengths)
        # the end of a text comes after the words
        self.bucket = np.append(np.where(pooled, chunks + tail % SPREAD, bucket), chunks + TAILS % SPREAD)
        self.place = np.append(np.where(pooled, tail // SPREAD, place).astype(np.int64), TAILS // SPREAD)
        self.cls = np.append(np.where(cls == 255, tails[tail], cls), tails[TAILS]).astype(np.int64)


def _contexts(coded: DataFrame, told: DataFrame, tails: np.ndarray, k: int, chunks: int) -> DataFrame:
    """Per bucket of items, packed: training counts of (item, side, class of the neighbour on that side)."""
    width, kind, parts = 2 * (k + 1), "bucket int, part int, key binary, n binary", -(-chunks // MERGED)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        key = n = b = np.zeros(0, np.int64)
        if left.num_rows:
            x = _Chunk(left, right, tails, chunks)
            train = ~np.array(left["held"][0].as_py(), bool)
            seq = _sequence(x.n[train], x.seq[np.repeat(train, x.n)].astype(np.int64), len(x.cls) - 1)
            c = x.cls[seq]
            u, n = np.unique(np.concatenate([seq[1:] * width + c[:-1], seq[:-1] * width + k + 1 + c[1:]]), return_counts=True)
            b, key = x.bucket[u // width], x.place[u // width] * width + u % width
            by = np.lexsort((key, b))
            b, key, n = b[by], key[by], n[by]
        cut = _edges(b)
        part = left["chunk"][0].as_py() // MERGED if left.num_rows else 0
        return pa.table([pa.array([int(b[lo]) for lo, _ in cut], pa.int32()), pa.array([part if b[lo] >= chunks else 0 for lo, _ in cut], pa.int32()),
                         pa.array([_steps(key[lo:hi]) for lo, hi in cut], pa.binary()),
                         pa.array([_packed(n[lo:hi].astype(np.uint32)) for lo, hi in cut], pa.binary())], names=["bucket", "part", "key", "n"])

    def total(table: pa.Table) -> pa.Table:
        key, n = _add([_keys(x) for x in table["key"].to_pylist()], [_unpacked(x, np.uint32) for x in table["n"].to_pylist()])
        return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([0], pa.int32()),
                         pa.array([_steps(key)], pa.binary()), pa.array([_packed(n.astype(np.uint32))], pa.binary())], names=["bucket", "part", "key", "n"])

    sent = coded.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(freed(count), kind)
    if parts > 1:
        sent = sent.groupBy("bucket", "part").applyInArrow(total, kind)
    return stored(sent.groupBy("bucket").applyInArrow(total, kind).drop("part"))


def _steps(key: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return _packed(np.diff(key, prepend=0).astype(np.uint32))


def _keys(block: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(block, np.uint32), dtype=np.int64)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(counts: np.ndarray, k: int) -> float:
    """Of the class bigrams from both sides, in nats, but for terms that no exchange changes."""
    return sum(xlogx(a).sum() - xlogx(a.sum(axis=1)).sum() for a in (counts[:k, :k + 1].astype(float), counts[:k, k + 1:].astype(float)))


def gains(vectors: np.ndarray, own: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Exact change of the likelihood when each item (row of neighbour counts) moves from its class to each of k others."""
    item, slot = np.nonzero(vectors)
    return _gains(item, slot, vectors[item, slot].astype(float), own, counts, k)


def _gains(item: np.ndarray, slot: np.ndarray, n: np.ndarray, own: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """As ``gains``, from the counts above 0 only, in order of items."""
    a = counts[:k].astype(float)
    out = np.zeros((len(own), k))
    if not len(item):
        return out
    now = a[own[item], slot]
    change = xlogx(a[:, slot] + n) - xlogx(a)[:, slot] + xlogx(np.maximum(now - n, 0)) - xlogx(now)
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    out[item[first]] = np.add.reduceat(change, first, axis=1).T
    for side, sums in ((slot <= k, a[:, :k + 1].sum(axis=1)), (slot > k, a[:, k + 1:].sum(axis=1))):
        m = np.bincount(item[side], weights=n[side], minlength=len(own))
        rest = np.maximum(sums[own] - m, 0)
        out -= xlogx(sums + m[:, None]) - xlogx(sums) + (xlogx(rest) - xlogx(sums[own]))[:, None]
    out[np.arange(len(own)), own] = 0
    return out


def _exchanged(key: np.ndarray, n: np.ndarray, cls: np.ndarray, counts: np.ndarray, turn: int, k: int) -> np.ndarray:
    """New classes of a bucket's items, of which half (by hash) may move in this turn."""
    width, out = 2 * (k + 1), cls.copy()
    cut = np.append(np.flatnonzero(np.diff(key // width, prepend=-1)), len(key))
    items = key[cut[:-1]] // width
    moves = (cls[items] < k) & ((mix(items.astype(np.uint64) + np.uint64(977 * (turn // 2))) >> np.uint64(7)) % np.uint64(2) == turn % 2)
    some = np.repeat(moves, np.diff(cut))
    items, key, n = items[moves], key[some], n[some]
    cut = np.append(np.flatnonzero(np.diff(key // width, prepend=-1)), len(key))
    lo = 0
    while lo < len(items):
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + 32_768, "right")) - 1)
        mine, at = slice(cut[lo], cut[hi]), np.repeat(np.arange(hi - lo), np.diff(cut[lo:hi + 1]))
        own = cls[items[lo:hi]].astype(np.int64)
        g = _gains(at, key[mine] % width, n[mine].astype(float), own, counts, k)
        out[items[lo:hi]] = np.where(g.max(axis=1) > 1e-9, g.argmax(axis=1), own)
        lo = hi
    return out


def _turn(contexts: DataFrame, state: DataFrame, counts: np.ndarray | None, turn: int, k: int) -> tuple[DataFrame, np.ndarray]:
    """The classes after a turn (as they are, where ``counts`` is None) and their (class, side and neighbour class) counts."""
    width = 2 * (k + 1)

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            raise ValueError("contexts of a bucket without classes")
        cls, total = _unpacked(right["cls"][0].as_py(), np.uint8), np.zeros((k + 1) * width, np.int64)
        if left.num_rows:
            key, n = _keys(left["key"][0].as_py()), _unpacked(left["n"][0].as_py(), np.uint32)
            if counts is not None:
                cls = _exchanged(key, n, cls, counts, turn, k)
            total = np.bincount(cls[key // width].astype(np.int64) * width + key % width, weights=n, minlength=len(total)).astype(np.int64)
        return pa.table([pa.array([right["bucket"][0].as_py()], pa.int32()), pa.array([_packed(cls)], pa.binary()), pa.array([_packed(total)], pa.binary())],
                        names=["bucket", "cls", "total"])

    done = stored(contexts.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(step, "bucket int, cls binary, total binary"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) * width, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += _unpacked(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

    got = done.select("total").mapInArrow(add, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((k + 1) * width, np.int64)
    out[got["i"].to_numpy()] = got["n"].to_numpy()
    return done.select("bucket", "cls"), out.reshape(k + 1, width)


def _emissions(vocab: DataFrame, state: DataFrame, tails: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, v = np.zeros(k + 1, np.int64), np.zeros(k + 1, np.int64)
        if left.num_rows:
            c, cl = _unpacked(left["c"][0].as_py(), np.int64), tails[_unpacked(left["t"][0].as_py(), np.uint16)]
            cl[c >= least] = _unpacked(right["cls"][0].as_py(), np.uint8)
            n = np.bincount(cl, weights=c, minlength=k + 1).astype(np.int64)
            v = np.bincount(cl, minlength=k + 1)
        return pa.table({"i": np.arange(k + 1), "n": n, "v": v})

    got = (vocab.select("bucket", "c", "t").groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(run, "i long, n long, v long")
           .groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow())
    n, v = np.zeros(k + 1, np.int64), np.zeros(k + 1, np.int64)
    n[got["i"].to_numpy()], v[got["i"].to_numpy()] = got["n"].to_numpy(), got["v"].to_numpy()
    return n, v


@dataclass
class Model:
    """What is learned: distributed vocabulary and classes, and the small tables of the classes."""

    k: int
    chunks: int
    least: int
    n_texts: int          # training texts
    total: int            # training tokens
    distinct: int
    rounds: int
    coded: DataFrame
    vocab: DataFrame
    places: DataFrame
    state: DataFrame
    tails: np.ndarray     # class of each ending, and of the end of a text
    pairs: np.ndarray     # counts of (class, class after)
    n_class: np.ndarray
    v_class: np.ndarray


def learn(docs: DataFrame, classes: int = 32, least: int = 3, settled: float = 0.05, chunk_bytes: int = 8 << 20) -> Model:
    """The model of the rows that are not held out; all rows are coded for it."""
    ship(docs.sparkSession)
    k = classes
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    train = rows.where(~F.col("held_out"))
    chunks = max(1, -(-text_bytes(rows)[1] // chunk_bytes))
    n_texts = train.count()
    vocab = vocabulary(train, chunks)
    sums = vocab.agg(F.sum("n_words").alias("v"), F.sum("n_tokens").alias("n")).first()
    total, distinct = (sums["n"] or 0) + n_texts, (sums["v"] or 0) + (n_texts > 0)
    coded = _coded(rows, chunks, docs.schema["doc_id"].dataType.simpleString())
    places = _places(coded, vocab, chunks, least)
    state, before, rounds = _started(vocab, chunks, least, k), -np.inf, 0
    while True:
        tails = _endings(state, chunks)
        contexts = _contexts(coded, _told(places, state), tails, k, chunks)
        state, counts = _turn(contexts, state, None, 0, k)
        value = likelihood(counts, k)
        if value - before < settled * max(total, 1):
            break
        before, rounds, turn = value, rounds + 1, 0
        while True:
            for _ in range(2):
                state, counts = _turn(contexts, state, counts, turn, k)
                turn += 1
            last, value = value, likelihood(counts, k)
            if value - last < settled * max(total, 1):
                break
    n_class, v_class = _emissions(vocab, state, tails, least, k)
    return Model(k, chunks, least, n_texts, total, distinct, rounds, coded, vocab, places, state, tails, counts[:, k + 1:], n_class, v_class)


def score(docs: DataFrame, classes: int = 32, least: int = 3, settled: float = 0.05, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    return judged(learn(docs, classes, least, settled, chunk_bytes))


def judged(model: Model) -> DataFrame:
    """The scores of the documents a model was made for."""
    k, chunks, n_texts, total, tails = model.k, model.chunks, model.n_texts, model.total, model.tails
    unigram = (model.pairs.sum(axis=0) + 1) / (model.pairs.sum() + k + 1)
    after = np.log10((model.pairs + k * unigram) / (model.pairs.sum(axis=1, keepdims=True) + k))
    norm = np.log10(model.n_class + SMOOTH * (model.v_class + 1))
    base_norm = float(np.log10(total + SMOOTH * (model.distinct + 1)))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        x = _Chunk(left, right, tails, chunks)
        docs = left["docs"].combine_chunks().flatten()
        size = len(docs)
        doc, c = np.repeat(np.arange(size), x.n), x.c[x.seq]
        sum_of = lambda y, at=doc: np.bincount(at, weights=y, minlength=size)
        log_c = np.log10(c + SMOOTH)
        cl = x.cls[_sequence(x.n, x.seq.astype(np.int64), len(x.cls) - 1)]
        return pa.table({
            "doc_id": docs, "held_out": left["held"].combine_chunks().flatten(), "n_tokens": x.n + 1,
            "n_known": (sum_of(c > 0) + (n_texts > 0)).astype(np.int64), "train_tokens": np.full(size, total, np.int64),
            "base_score": sum_of(log_c) + np.log10(n_texts + SMOOTH) - (x.n + 1) * base_norm,
            "score": sum_of(after[cl[:-1], cl[1:]], np.repeat(np.arange(size), x.n + 1)) + sum_of(log_c - norm[x.cls[x.seq]])})

    kind = model.coded.schema["docs"].dataType.elementType.simpleString()
    return model.coded.groupBy("chunk").cogroup(_told(model.places, model.state).groupBy("chunk")).applyInArrow(
        freed(judge), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
