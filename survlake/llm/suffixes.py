"""Removal of repeated byte strings with a distributed, common-prefix-aware suffix sort.

A byte goes if it is covered by a string of ``SPAN`` (50) bytes that also starts in a
document with a smaller doc_id. Which strings are equal is found by sorting suffixes, but
not one for every position: each 50-byte window has an anchor, the position in it whose
``GRAM`` (24) bytes have the least hash (the first of those if several). The anchor
depends on the window's bytes alone, so equal windows have it at the same offset, and
sorting the suffixes that start at anchors, with the few bytes before them, decides all
windows exactly. About one position in 14 is an anchor.

Steps, one Spark job: documents are dealt into chunks; a chunk asks which of its anchors'
grams occur more than once anywhere (packed hashes, counted in buckets; a hash collision
only costs work); it sorts the suffixes at those anchors, keeps the smallest document of
equal entries (others are decided at once) and sends the run, front-coded: the length of
the prefix shared with the suffix before and the bytes after it. Ranges of suffixes, cut by a
bounded sample, are each merged by a loser tree that carries common prefix lengths:
characters are looked at only where two candidates share the same known prefix with the
last winner. The merged order and its prefix lengths give, for every offset of the
anchor, which windows are equal to the right, and the same for the reversed bytes before the
anchor to the left; the least document of each class stays. Verdicts (a bit per window)
return to the chunks, which cut the bytes out.

Grams that occur ``hot`` times or more give one entry per window instead, placed by all of its
50 bytes, so that a passage many documents share is spread over the ranges by what
follows it; each run sends a distinct string once.

Defined results: null and empty text have no bytes; texts under 50 bytes lose nothing; rows
repeated under one doc_id do not remove each other; a null doc_id counts as larger than all; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from survlake.llm.tables import freed, ship, text_bytes
from survlake.llm.tokens import text_blocks

SPAN, GRAM = 50, 24
REACH = SPAN - GRAM  # largest offset of an anchor in its window
PIECE = 1 << 19
LAST = np.iinfo(np.int64).max


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        m = (n - r + 7) // 8
        out[r::8] = np.frombuffer(data[r:r + 8 * m].tobytes(), "<u8")
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    g = _eights(data)
    n = len(data) - GRAM + 1
    x = g[:n] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += g[8:8 + n]
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x += g[16:16 + n]
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, text, hash of the anchor's gram) for the windows inside each text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(data)
    bits = max(1, int(n).bit_length())
    mask = np.uint64((1 << bits) - 1)
    m = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8, REACH + 1 - 16):
        m = np.minimum(m[:len(m) - step], m[step:])
    m = (m & mask).astype(np.int64)
    length = np.diff(offsets)
    room = np.maximum(length - SPAN + 1, 0)  # windows of each text
    start = np.repeat(offsets[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    if not len(start):
        return none, none, none, none, np.zeros(0, np.uint64)
    a = m[start]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(new[1:], len(a)) - 1
    owner = np.searchsorted(offsets, start[new], "right") - 1
    return a[new], start[new], start[last], owner, h[a[new]]


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, where the piece begins in all texts together); long texts in overlapping pieces."""
    base = 0
    for lo, hi, data, offs in text_blocks(column, PIECE):
        if len(data) <= 2 * PIECE or hi - lo > 1:
            yield lo, data, offs, base
        else:
            for at in range(0, len(data) - SPAN + 1, PIECE):
                part = data[at:at + PIECE + SPAN - 1]
                yield lo, part, np.array([0, len(part)]), base + at
        base += len(data)


def _matrix(data: np.ndarray, at: np.ndarray, length: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Rows of ``width`` bytes from each position on (or backwards from the one before), zero after ``length``."""
    j = np.arange(width, dtype=np.int32)
    out = np.empty((len(at), width), np.uint8)
    for lo in range(0, len(at), 20_000):
        a = at[lo:lo + 20_000, None].astype(np.int32)
        where = (a - 1 - j) if back else (a + j)
        out[lo:lo + 20_000] = np.where(j < length[lo:lo + 20_000, None], data[np.clip(where, 0, len(data) - 1)], 0)
    return out


def _numbers(rows: np.ndarray) -> np.ndarray:
    """Columns of big-endian numbers that sort as the rows do."""
    pad = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    pad[:, :rows.shape[1]] = rows
    return pad.view(">u8").astype(np.uint64)


def _shared(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        diff = rows[1:] != rows[:-1]
        out[1:] = np.where(diff.any(axis=1), diff.argmax(axis=1), rows.shape[1])
    return out


class Chunk:
    """Anchors of a chunk's texts, and the sorted run of the entries to be compared with other chunks."""

    def __init__(self, column: pa.Array, buckets: int):
        self.parts = []
        hashes = []
        for row, data, offs, base in _pieces(column):
            a, lo, hi, owner, h = anchors(data, offs)
            self.parts.append((row, data, base, a, lo, hi, owner))
            hashes.append(h)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        code = (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        self.code, self.which, self.times = np.unique(code, return_inverse=True, return_counts=True)

    def run(self, state: np.ndarray, ids: np.ndarray) -> None:
        """Entries of the anchors with state 1 (one for the anchor) and 2 (one for each window), sorted, equal ones once."""
        right, left, rl, ll, doc, hot, where, decided = [], [], [], [], [], [], [], []
        at = 0
        for row, data, base, a, lo, hi, owner in self.parts:
            s = state[at:at + len(a)]
            at += len(a)
            for kind in (1, 2):
                e = np.flatnonzero(s == kind)
                if not len(e):
                    continue
                if kind == 1:
                    pos, first, end = a[e], lo[e], hi[e]
                else:
                    n = hi[e] - lo[e] + 1
                    e = np.repeat(e, n)
                    pos = lo[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
                    # of equal windows in a piece the smallest document's stays; the others are decided
                    own = ids[row + owner[e]]
                    cols = _numbers(_matrix(data, pos, np.full(len(pos), SPAN), SPAN)).T
                    by = np.lexsort([own, *cols[::-1]])
                    new = np.ones(len(by), bool)
                    new[1:] = np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in cols])
                    least = own[by][new][np.cumsum(new) - 1]
                    over = by[own[by] > least]
                    decided.append(np.stack([base + pos[over], np.zeros_like(over), np.zeros_like(over)]))
                    stay = by[own[by] == least]
                    e, pos = e[stay], pos[stay]
                    first = end = pos
                r, l = end + SPAN - pos, pos - first
                right.append(_matrix(data, pos, r, SPAN))
                left.append(_matrix(data, pos, l, REACH, True))
                rl.append(r)
                ll.append(l)
                doc.append(ids[row + owner[e]])
                hot.append(np.full(len(e), kind == 2))
                where.append(np.stack([base + pos, l, end - first]))
        self.where, self.place, self.entries = np.zeros((3, 0), np.int64), np.zeros(0, np.int64), 0
        if not right:
            return
        right, left = np.concatenate(right), np.concatenate(left)
        rl, ll, doc, hot = (np.concatenate(x) for x in (rl, ll, doc, hot))
        self.where = np.concatenate(where, axis=1)
        rn, ln = _numbers(right), _numbers(left)
        by = np.lexsort([doc, hot, ll, *ln.T[::-1], rl, *rn.T[::-1]])
        same = np.ones(len(by), bool)
        same[0] = False
        for col in (*rn.T, rl, *ln.T, ll, hot):
            c = col[by]
            same[1:] &= c[1:] == c[:-1]
        group = np.cumsum(~same) - 1
        head = by[~same]
        # per entry: its place in the run, or -1 where a smaller document of this chunk has all of it
        self.place = np.empty(len(by), np.int64)
        self.place[by] = np.where(doc[by] > doc[head][group], -1, group)
        if decided:
            self.where = np.concatenate([self.where, *decided], axis=1)
            self.place = np.append(self.place, np.full(self.where.shape[1] - len(by), -1))
        self.right, self.left, self.rl, self.ll, self.heads, self.hot = right[head], left[head], rl[head], ll[head], doc[head], hot[head]
        self.entries = len(head)

    def ranges(self, cuts: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
        """(range of each entry of the run, entries ordered by range)."""
        key = np.where((np.arange(SPAN) < GRAM) | self.hot[:, None], self.right, 0).astype(np.uint8)
        key = np.ascontiguousarray(key)
        part = np.searchsorted(cuts, key.view(f"S{SPAN}")[:, 0], "right").astype(np.int64) * slices
        if slices > 1:
            mixed = np.zeros(len(key), np.uint64)
            for c in _numbers(key).T:
                mixed = (mixed ^ c) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(31)
            part += (mixed % np.uint64(slices)).astype(np.int64)
        return part, np.argsort(part, kind="stable")


def pack(right: np.ndarray, left: np.ndarray, rl: np.ndarray, ll: np.ndarray, doc: np.ndarray) -> bytes:
    """A sorted run, front-coded and compressed."""
    lcp = _shared(right)
    j = np.arange(SPAN)
    tails = right[(j >= lcp[:, None]) & (j < rl[:, None])]
    lefts = left[np.arange(REACH) < ll[:, None]]
    raw = b"".join([lcp.astype(np.uint8).tobytes(), rl.astype(np.uint8).tobytes(), ll.astype(np.uint8).tobytes(),
                    doc.astype(np.int64).tobytes(), tails.tobytes(), lefts.tobytes()])
    return len(rl).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(block: bytes) -> tuple[np.ndarray, ...]:
    """(prefix lengths, right rows, left rows, right lengths, left lengths, documents)."""
    n, size = int.from_bytes(block[:4], "little"), int.from_bytes(block[4:8], "little")
    raw = pa.decompress(block[8:], size, "zstd", asbytes=True)
    lcp, rl, ll = (np.frombuffer(raw, np.uint8, n, n * i).astype(np.int64) for i in range(3))
    doc = np.frombuffer(raw, np.int64, n, 3 * n)
    j = np.arange(SPAN)
    fresh = (j >= lcp[:, None]) & (j < rl[:, None])
    m = int(fresh.sum())
    right = np.zeros((n, SPAN), np.uint8)
    right[fresh] = np.frombuffer(raw, np.uint8, m, 11 * n)
    # a column's value comes from the last row that was not told to share it
    source = np.maximum.accumulate(np.where(j >= lcp[:, None], np.arange(n)[:, None], 0), axis=0)
    right = right[source, j]
    left = np.zeros((n, REACH), np.uint8)
    left[np.arange(REACH) < ll[:, None]] = np.frombuffer(raw, np.uint8, offset=11 * n + m)
    return lcp, right, left, rl, ll, doc


def merge(runs: list[tuple[list[int], list[int]]], width: int = SPAN) -> Iterator[tuple[int, int]]:
    """Loser tree over sorted runs of (numbers of ``width`` bytes, shared prefix lengths): (run, prefix shared with the one before).

    ``known[r]`` is the prefix that run r's head shares with the last winner it lost to. The
    longer known prefix wins; only at equal ones are the strings looked at.
    """
    k = 1
    while k < len(runs):
        k *= 2
    bits, end = 8 * width, 1 << (8 * width)
    head = [r[0][0] if r[0] else end for r in runs] + [end] * (k - len(runs))
    known, place = [0] * k, [0] * k
    tree = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        a, b = head[x], head[y]
        if a == b:
            return (x, y) if x < y else (y, x)
        if a == end or b == end:
            return (y, x) if a == end else (x, y)
        if a > b:
            x, y = y, x
        known[y] = (bits - (a ^ b).bit_length()) >> 3
        return x, y

    level = list(range(k))
    base = k
    while len(level) > 1:
        base //= 2
        winners = []
        for i in range(0, len(level), 2):
            w, l = play(level[i], level[i + 1])
            if head[w] == head[l] != end:
                known[l] = width
            tree[base + i // 2] = l
            winners.append(w)
        level = winners
    w = level[0]
    while head[w] != end:
        yield w, known[w]
        values, shared = runs[w]
        place[w] += 1
        i = place[w]
        if i < len(values):
            head[w], known[w] = values[i], shared[i]
        else:
            head[w], known[w] = end, -1
        node = (w + k) >> 1
        while node:
            l = tree[node]
            kw, kl = known[w], known[l]
            if kl > kw:
                tree[node], w = w, l
            elif kl == kw and kw >= 0:
                a, b = head[w], head[l]
                if a > b:
                    tree[node], w, l = w, l, w
                    known[l] = (bits - (a ^ b).bit_length()) >> 3
                elif a < b:
                    known[l] = (bits - (a ^ b).bit_length()) >> 3
                else:
                    known[l] = width
            node >>= 1


def verdicts(blocks: list[bytes]) -> list[np.ndarray]:
    """For each run's entries the bits of the offsets at which a smaller document has the same window."""
    runs = [unpack(b) for b in blocks]
    size = [len(r[0]) for r in runs]
    feed = []
    for lcp, right, *_ in runs:
        raw = right.tobytes()
        feed.append(([int.from_bytes(raw[i:i + SPAN], "big") for i in range(0, len(raw), SPAN)], lcp.tolist()))
    pairs = np.array(list(merge(feed)), np.int64).reshape(-1, 2)
    del feed
    base = np.cumsum([0] + size[:-1])
    run, lcp = pairs[:, 0], pairs[:, 1]
    turn = np.argsort(run, kind="stable")  # the entries of a run come in their order
    order = np.empty(len(run), np.int64)
    order[turn] = np.arange(len(run))
    if len(lcp):
        lcp[0] = 0
    left, rl, ll, doc = (np.concatenate([r[i] for r in runs])[order] for i in (2, 3, 4, 5))
    by = np.lexsort(_numbers(left).T[::-1])
    shared = _shared(left[by])
    bits = np.zeros(len(order), np.uint32)
    for o in range(REACH + 1):
        v = np.flatnonzero((SPAN - rl <= o) & (o <= ll))
        if len(v) < 2:
            continue
        lc = np.empty(len(order), np.int64)
        lc[by] = np.cumsum(shared < o) if o else 0
        key = np.cumsum(lcp < SPAN - o)[v] * (len(order) + 1) + lc[v]
        d = doc[v]
        s = np.lexsort((d, key))
        ks = key[s]
        first = np.concatenate([[True], ks[1:] != ks[:-1]])
        least = d[s][first][np.cumsum(first) - 1]
        bits[v[s[d[s] > least]]] |= np.uint32(1 << o)
    out = np.empty(len(order), np.uint32)
    out[order] = bits
    return [out[b:b + n] for b, n in zip(base, size)]


def _encoded(texts: pa.Array) -> Iterator[bytes]:
    return ((x.as_py() or "").encode("utf-8", "surrogatepass") for x in texts)


def _in_order(table: pa.Table) -> pa.Table:
    """Rows of a chunk in the same order whenever it is read: a shuffle hands them over in any."""
    return table.take(np.lexsort((table["_tie"].to_numpy(), table["_rank"].to_numpy())))


def _count(table: pa.Table) -> pa.Table:
    """How often the grams of a bucket occur in all chunks (up to 65,535), back to each chunk."""
    low = [np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()]
    times = np.frombuffer(b"".join(table["times"].to_pylist()), np.uint16)
    _, inverse = np.unique(np.concatenate(low), return_inverse=True)
    total = np.minimum(np.bincount(inverse, weights=times), 65535)[inverse].astype(np.uint16)
    cuts = np.cumsum([len(x) for x in low])[:-1]
    return pa.table({"chunk": table["chunk"].cast(pa.int32()), "bucket": table["bucket"].cast(pa.int32()),
                     "freq": pa.array([x.tobytes() for x in np.split(total, cuts)], pa.binary())})


def _merge_range(table: pa.Table) -> pa.Table:
    """Merges the runs of a range; what a chunk sent to itself (negative range) passes."""
    chunk, part, blocks = (table[c].to_pylist() for c in ("chunk", "part", "block"))
    if part[0] >= 0:
        by = sorted(range(len(chunk)), key=chunk.__getitem__)
        chunk, part, blocks = ([x[i] for i in by] for x in (chunk, part, blocks))
        blocks = [b.tobytes() for b in verdicts(blocks)]
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "part": pa.array(part, pa.int64()), "block": pa.array(blocks, pa.binary())})


def _sample(docs: DataFrame, rows: int, wanted: int) -> np.ndarray:
    """Suffixes at anchors of about ``wanted`` documents chosen by hash, sorted: only the balance of the ranges depends on them."""
    share = min(1.0, wanted / max(1, rows))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) <= int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, data, offs, _ in _pieces(b.column(0)):
                a, _, hi, owner, _ = anchors(data, offs)
                one = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(a) else np.zeros(0, np.int64)
                n = np.diff(np.append(one, len(a)))
                for q in range(4):  # four of each text
                    e = one + n * q // 4
                    m = _matrix(data, a[e], hi[e] + SPAN - a[e], SPAN)
                    out += [r.tobytes() for r in m]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["s"])

    got = sorted({bytes(r["s"]) for r in picked.select("text").mapInArrow(run, "s binary").collect()})
    return np.array(got, f"S{SPAN}")


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), with_text: bool = False, chunk_bytes: int = 4 << 20,
                   hot: int = 2048, most_ranges: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` also the spans and the kept text.

    ``carry`` names further columns of ``docs`` to hand on; one that has the name of a result stands in its place. The kept text leaves out bytes of
    characters that were cut in part; the digest is of the bytes.
    """
    ship(docs.sparkSession)
    rows, size = text_bytes(docs)
    n_chunks = max(1, -(-size // chunk_bytes))
    n_ranges = min(n_chunks, most_ranges)
    slices = -(-n_chunks // n_ranges)
    sample = _sample(docs, rows, min(20 * n_ranges, 20_000)) if n_ranges > 1 else np.zeros(0, f"S{SPAN}")
    cuts = np.unique(sample[np.arange(1, n_ranges) * len(sample) // n_ranges]) if len(sample) else sample
    chunk = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n_chunks)).cast("int")
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST)))
    dealt = docs.select(chunk.alias("_chunk"), rank.alias("_rank"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_tie"), "doc_id", F.col("text").alias("_text"),
                        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]).repartition("_chunk")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
              + ", spans array<struct<start:long,end:long>>, kept string" * with_text
              + "".join(f", _c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def ask(table: pa.Table) -> pa.Table:
        c = Chunk(table["_text"], n_chunks)
        b = (c.code >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(0, np.int64)
        low = (c.code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        times = np.minimum(c.times, 65535).astype(np.uint16)
        cut = list(zip(edge[:-1], edge[1:]))
        return pa.table({"bucket": pa.array([int(b[lo]) for lo, _ in cut], pa.int32()),
                         "chunk": pa.array([table["_chunk"][0].as_py()] * len(cut), pa.int32()),
                         "low": pa.array([low[lo:hi].tobytes() for lo, hi in cut], pa.binary()),
                         "times": pa.array([times[lo:hi].tobytes() for lo, hi in cut], pa.binary())})

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["chunk", "part", "block"]
        if not left.num_rows:
            return pa.table({"chunk": pa.array([], pa.int32()), "part": pa.array([], pa.int64()), "block": pa.array([], pa.binary())})
        me = left["_chunk"][0].as_py()
        left = _in_order(left)
        c = Chunk(left["_text"], n_chunks)
        back = right["freq"].to_pylist()
        freq = np.frombuffer(b"".join([back[i] for i in np.argsort(right["bucket"].to_numpy(), kind="stable")]), np.uint16)[c.which]
        state = (freq > 1).astype(np.uint8) + (freq >= hot)
        c.run(state, left["_rank"].to_numpy())
        out = []
        slot = c.place
        if c.entries:
            part, by = c.ranges(cuts, slices)
            p = part[by]
            turn = np.empty(c.entries, np.int64)
            turn[by] = np.arange(c.entries)
            slot = np.where(slot < 0, -1, turn[slot])
            edge = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]]))
            for lo, hi in zip(edge[:-1], edge[1:]):
                e = by[lo:hi]
                out.append((me, int(p[lo]), pack(c.right[e], c.left[e], c.rl[e], c.ll[e], c.heads[e])))
        # what the chunk has to know when the verdicts come back
        raw = (c.where[0].astype(np.int64).tobytes() + c.where[1].astype(np.uint8).tobytes()
               + c.where[2].astype(np.uint8).tobytes() + slot.astype(np.int32).tobytes())
        out.append((me, -1 - me, len(slot).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)))
        cols = list(zip(*out))
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=names)

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        left = _in_order(left)
        me = left["_chunk"][0].as_py()
        blocks = dict(zip(right["part"].to_pylist(), right["block"].to_pylist()))
        own = blocks.pop(-1 - me)
        n = int.from_bytes(own[:4], "little")
        raw = pa.decompress(own[4:], 14 * n, "zstd", asbytes=True)
        pos = np.frombuffer(raw, np.int64, n)
        before, more = (np.frombuffer(raw, np.uint8, n, (8 + i) * n).astype(np.int64) for i in range(2))
        slot = np.frombuffer(raw, np.int32, n, 10 * n)
        bits = np.frombuffer(b"".join([blocks[k] for k in sorted(blocks)]) + b"\xff\xff\xff\xff", np.uint32)
        mine = bits[slot]  # the last one, all bits, for what was decided at once
        texts = left["_text"].combine_chunks() if isinstance(left["_text"], pa.ChunkedArray) else left["_text"]
        length = np.array([len(d) for d in _encoded(texts)], np.int64)
        offs = np.concatenate([[0], np.cumsum(length)])
        gone = np.zeros(int(offs[-1]) + SPAN, bool)
        for o in range(REACH + 1):
            hit = ((mine >> np.uint32(o)) & np.uint32(1)).astype(bool) & (o <= before) & (o >= before - more)
            gone[pos[hit] - o] = True
        s = np.concatenate([np.zeros(SPAN, np.int32), np.cumsum(gone, dtype=np.int32)])
        covered = s[SPAN:] > s[:-SPAN]
        total = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])
        removed = total[offs[1:]] - total[offs[:-1]]
        out = []
        for r, data in enumerate(_encoded(texts)):
            kept, spans = data, []
            if removed[r]:
                c = covered[offs[r]:offs[r + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2])]
                kept = np.frombuffer(data, np.uint8)[~c].tobytes()
            row = (len(data), int(removed[r]), len(spans), hashlib.sha256(kept).hexdigest())
            out.append(row + (spans, kept.decode("utf-8", "ignore")) if with_text else row)
        cols = [list(x) for x in zip(*out)]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_text
        made = {n: pa.array(v, arrow.field(n).type) for n, v in zip(names, cols)}
        made |= {"doc_id": left["doc_id"]} | {f"_c{i}": left[f"_c{i}"] for i in range(len(carry))}
        return pa.table([made[f.name].cast(f.type) for f in arrow], schema=arrow)

    told = (dealt.groupBy("_chunk").applyInArrow(freed(ask), "bucket int, chunk int, low binary, times binary")
            .groupBy("bucket").applyInArrow(freed(_count), "chunk int, bucket int, freq binary"))
    sent = dealt.groupBy("_chunk").cogroup(told.groupBy("chunk")).applyInArrow(freed(send), "chunk int, part long, block binary")
    back = sent.groupBy("part").applyInArrow(freed(_merge_range), "chunk int, part long, block binary")
    out = dealt.groupBy("_chunk").cogroup(back.groupBy("chunk")).applyInArrow(freed(cut_out), schema)
    own = [c for c in out.columns if c not in carry and not c.startswith("_c")]   # a carried column keeps its name and values
    return out.select(*own, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
