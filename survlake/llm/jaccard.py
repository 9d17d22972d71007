"""Near duplicates by word shingles: an exact Jaccard join over PartEnum signatures.

A document's set is its distinct shingles of ``words`` words, as 48-bit hashes. Sets are
put into bands of sizes, each at most 100/percent times as wide as its start, so linked
sets are in the same band or in neighbouring ones. For a band, linked sets differ in at
most k elements. The domain of shingles is dealt into n > k parts; a set has one
signature for each part: the part's number with all its elements of that part. Linked
sets agree in at least n - k parts. The subset of parts to enumerate follows from that:
of its N non-empty parts a set gives the H + 1 whose signatures are rarest in the whole
corpus, where H bounds its difference from any partner. The rarest part on which a linked
pair agrees is among those of both, as each leaves out fewer than they agree on. (A set
with N ≤ H gives all parts, also empty ones; in bands of small sets every shingle is a
part of its own.) So sets linked share a signature, exactly, and signatures that a
common passage gives to many documents are the first to be left out.

Steps, all on Spark: documents are dealt into chunks; each chunk sends its signatures
(packed) to be counted and gets their frequencies back; signatures that are given and not
unique go to buckets, where sets that share one form a group. No group is expanded into
pairs: first each set is verified against the hub (the most connected member of a group)
that it shares most signatures with; then, between the components this leaves, those pairs
of the groups with one hub that sizes and parity sketches (whose distance never exceeds that of the sets)
do not rule out: the closest pair of any two components, and after that all. Verified links are closed into components.
Equal sets are one node all along. Links between sets of one component are not all
listed; no link between different components is left out.

Defined results: null, empty or wordless text has an empty set, no links and is its own
component; texts of fewer than ``words`` words have one shingle, the whole sequence; rows
repeated under one doc_id are in one component if their texts are linked; a null doc_id is
smaller than none; an empty table gives no rows. Words are `[^\\x20\\x09-\\x0D]+`, A-Z
lower-cased. Two different shingles of one text have equal hashes with probability 2⁻⁴⁸.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from survlake.llm.graph import components
from survlake.llm.tables import freed, ship, stored, text_bytes, tidy
from survlake.llm.tokens import mix, text_blocks, words

SINGLE = 16  # bands of sets up to this size: every shingle is a part of its own
_DOC = np.uint64(48)
_SET = np.uint64((1 << 48) - 1)


@lru_cache(maxsize=8)
def bands(percent: int) -> np.ndarray:
    """First size of each band."""
    lo = [1]
    while lo[-1] < 1 << 40:
        lo.append(lo[-1] * 100 // percent + 1)
    return np.array(lo)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, set sizes, all sets' sorted shingles one after another) for runs of rows."""
    for lo, hi, data, offs in text_blocks(column):
        h, n, _ = words(data, offs)
        rows = hi - lo
        starts = np.cumsum(n) - n
        many = np.maximum(n - k + 1, (n > 0).astype(np.int64))
        doc = np.repeat(np.arange(rows), many)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + starts[doc]
        s = np.zeros(len(doc), np.uint64)
        end = starts[doc] + n[doc]
        for j in range(k):
            inside = at + j < end
            s += np.where(inside, h[np.minimum(at + j, len(h) - 1)], 0).astype(np.uint64) * np.uint64((2 * j + 3) * 0x9E3779B97F4A7C15 % 2**64 | 1)
        s = mix(s) >> np.uint64(16)
        full = np.sort((doc.astype(np.uint64) << _DOC) | s)
        if len(full):
            full = full[np.concatenate([[True], full[1:] != full[:-1]])]
        owner = (full >> _DOC).astype(np.int64)
        yield lo, np.bincount(owner, minlength=rows), full & _SET


def signatures(sizes: np.ndarray, sets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, segment of each, how many a segment gives); segment 2i is set i in its band, 2i+1 in the next."""
    first = bands(percent)
    band = np.searchsorted(first, np.maximum(sizes, 1), "right") - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    give = np.zeros(2 * len(sizes), np.int64)
    sig, seg = [], []
    for role in (0, 1):
        b = band + role
        most = first[b + 1] - 1  # largest size of the band
        k = 2 * most * (100 - percent) // (100 + percent)
        h = np.minimum(k, sizes * (100 - percent) // percent)
        give[role::2] = h + 1
        v = mix(sets + b[owner].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        alone = most[owner] <= SINGLE
        sig.append(mix(v[alone] + np.uint64(1)))
        seg.append(2 * owner[alone] + role)
        parts = np.where((most > SINGLE) & (sizes > 0), k + 1 + k // 3, 0)
        base = np.cumsum(parts) - parts
        big = ~alone
        o, v = owner[big], v[big]
        key = base[o] + (mix(v) % parts[o].astype(np.uint64)).astype(np.int64)
        total = int(parts.sum())
        if not total:
            continue
        low = np.bincount(key, weights=(v & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(np.uint64)
        high = np.bincount(key, weights=(v >> np.uint64(32)).astype(np.float64), minlength=total).astype(np.uint64)
        count = np.bincount(key, minlength=total)
        of = np.repeat(np.arange(len(sizes)), parts)
        filled = np.bincount(of[count > 0], minlength=len(sizes))
        use = (count > 0) | (filled <= h)[of]
        give[role::2] = np.where((parts > 0) & (filled <= h), parts, give[role::2])
        number = np.arange(total) - base[of]
        full = mix(low + (high << np.uint64(32)) + number.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
                   + b[of].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        sig.append(full[use])
        seg.append(2 * of[use] + role)
    return np.concatenate(sig), np.concatenate(seg), give


class Chunk:
    """The sets of a chunk's texts, equal ones once, and their signatures."""

    def __init__(self, column: pa.Array, k: int, percent: int, buckets: int):
        sizes, prints, parts = [], [], []
        for _, n, s in shingle_sets(column, k):
            owner = np.repeat(np.arange(len(n)), n)
            total = np.zeros(len(n), np.uint64)
            m = mix(s)
            ends = np.cumsum(n)
            run = np.concatenate([[np.uint64(0)], np.cumsum(m, dtype=np.uint64)])
            total = run[ends] - run[ends - n]
            sizes.append(n)
            prints.append(mix(total + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64))
            parts.append(s)
        empty = np.zeros(0, np.int64)
        self.sizes = np.concatenate(sizes) if sizes else empty
        self.prints = np.concatenate(prints) if prints else empty
        sets = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        starts = np.cumsum(self.sizes) - self.sizes
        _, one = np.unique(self.prints, return_index=True)
        one = np.sort(one[self.sizes[one] > 0])
        self.node, self.start, self.sets = one, starts[one], sets
        n = self.sizes[one]
        keep = np.zeros(len(self.sizes), bool)
        keep[one] = True
        chosen = sets[np.repeat(keep, self.sizes)]
        sig, self.seg, self.give = signatures(n, chosen, percent)
        code = (((sig >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (sig & np.uint64(0xFFFFFFFF))
        self.code, self.which, self.times = np.unique(code, return_inverse=True, return_counts=True)


def _blocks(code: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted codes."""
    b = (code >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(b[lo]), int(lo), int(hi)


def _low(code: np.ndarray) -> bytes:
    return (code & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()


def candidate_tables(docs: DataFrame, k: int, percent: int, chunk_bytes: int) -> DataFrame:
    """kind 0: each row's doc_id, n, fp; kind 1: packed signatures of a bucket; kind 2: the sets that have any."""
    _, size = text_bytes(docs)
    n_chunks = max(1, -(-size // chunk_bytes))
    n_buckets = -(-n_chunks // 4)   # a bucket holds the signatures of about four chunks' size: the packed rows stay few
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_schema(StructType.fromDDL(f"doc_id {kind}")).field(0).type
    chunk = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n_chunks)).cast("int")
    dealt = docs.select(chunk.alias("chunk"), "doc_id", "text").repartition("chunk")

    def ask(table: pa.Table) -> pa.Table:
        c = Chunk(table["text"], k, percent, n_buckets)
        rows = [(b, _low(c.code[lo:hi]), np.minimum(c.times[lo:hi], 255).astype(np.uint8).tobytes()) for b, lo, hi in _blocks(c.code)]
        cols = list(zip(*rows)) or [[], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * len(rows), pa.int32()),
                         "low": pa.array(cols[1], pa.binary()), "times": pa.array(cols[2], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        low = [np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()]
        times = np.frombuffer(b"".join(table["times"].to_pylist()), np.uint8)
        _, inverse = np.unique(np.concatenate(low), return_inverse=True)
        total = np.bincount(inverse, weights=times)
        freq = np.minimum(total[inverse], 65535).astype(np.uint16)
        cuts = np.cumsum([len(x) for x in low])[:-1]
        return pa.table({"chunk": table["chunk"].cast(pa.int32()), "bucket": table["bucket"].cast(pa.int32()),
                         "freq": pa.array([x.tobytes() for x in np.split(freq, cuts)], pa.binary())})

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left["text"], k, percent, n_buckets)
        order = np.argsort(right["bucket"].to_numpy(), kind="stable")
        back = right["freq"].to_pylist()
        freq = np.frombuffer(b"".join([back[i] for i in order]), np.uint16)[c.which]
        by = np.lexsort((c.code[c.which], freq, c.seg))
        seg = c.seg[by]
        head = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1]) if len(seg) else np.zeros(0, np.int64)
        rank = np.arange(len(seg)) - np.repeat(head, np.diff(np.append(head, len(seg))))
        got = by[(rank < c.give[seg]) & (freq[by] > 1)]
        code, node = c.code[c.which[got]], c.seg[got] // 2
        some = np.unique(node)
        by = np.lexsort((node, code))
        code, node = code[by], node[by]
        prints, sizes = c.prints[c.node], c.sizes[c.node]
        blocks = []
        for b, lo, hi in _blocks(code):
            own, inv = np.unique(node[lo:hi], return_inverse=True)
            blocks.append((b, np.uint32(len(own)).tobytes() + prints[own].tobytes() + sizes[own].astype(np.uint32).tobytes()
                           + inv.astype(np.uint32).tobytes() + _low(code[lo:hi])))
        n, m, d = left.num_rows, len(blocks), len(some)
        sets = [c.sets[c.start[i]:c.start[i] + sizes[i]].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for i in some]
        doc = left["doc_id"].cast(id_type)
        doc = doc.combine_chunks() if isinstance(doc, pa.ChunkedArray) else doc
        full = lambda a, b_, c_, t: pa.array([*a, *b_, *c_], t)
        ids = pa.concat_arrays([doc, pa.nulls(m + d, doc.type)])
        return pa.table({
            "doc_id": ids, "n": full(c.sizes.tolist(), [None] * m, sizes[some].tolist(), pa.int64()),
            "fp": full(c.prints.tolist(), [None] * m, prints[some].tolist(), pa.int64()),
            "bucket": full([None] * n, [b for b, _ in blocks], [None] * d, pa.int32()),
            "blob": full([None] * n, [x for _, x in blocks], sets, pa.binary()),
            "kind": full([0] * n, [1] * m, [2] * d, pa.int32())})

    asked = dealt.groupBy("chunk").applyInArrow(freed(ask), "bucket int, chunk int, low binary, times binary")
    told = asked.groupBy("bucket").applyInArrow(freed(count), "chunk int, bucket int, freq binary")
    out = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        freed(choose), f"doc_id {kind}, n long, fp long, bucket int, blob binary, kind int")
    return stored(out, "kind")


def _groups(table: pa.Table) -> pa.Table:
    """Groups of a bucket: sets that share a signature. Groups with the same members are one, with their number as weight."""
    low, fp, size = [], [], []
    for x in table["blob"].to_pylist():
        m = int(np.frombuffer(x, np.uint32, 1)[0])
        prints, sizes = np.frombuffer(x, np.int64, m, 4), np.frombuffer(x, np.uint32, m, 4 + 8 * m)
        n = (len(x) - 4 - 12 * m) // 8
        inv = np.frombuffer(x, np.uint32, n, 4 + 12 * m)
        low.append(np.frombuffer(x, np.uint32, n, 4 + 12 * m + 4 * n))
        fp.append(prints[inv])
        size.append(sizes[inv])
    low, fp, size = np.concatenate(low), np.concatenate(fp), np.concatenate(size)
    by = np.lexsort((fp, low))
    low, fp, size = low[by], fp[by], size[by]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (fp[1:] != fp[:-1])])
    low, fp, size = low[new], fp[new], size[new]
    head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    many = np.diff(np.append(head, len(low)))
    gid = mix(np.add.reduceat(mix(fp.view(np.uint64)), head) + many.astype(np.uint64)).view(np.int64)
    some = np.flatnonzero(many > 1)
    gid, one, times = np.unique(gid[some], return_index=True, return_counts=True)
    g = some[one]
    n = many[g]
    at = np.repeat(head[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return pa.table({"gid": np.repeat(gid, n), "fp": fp[at], "n": size[at].astype(np.int64),
                     "weight": np.repeat(times, n).astype(np.int64)})


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                n, m = len(x) // 6, len(y) // 6
                both = np.concatenate([_wide(x), _wide(y)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (n + m - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))],
                                             names=["a", "b"])
    return run


def _wide(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("fp").alias("fa"), F.col("blob").alias("x"))
    right = sets.select(F.col("fp").alias("fb"), F.col("blob").alias("y"))
    full = (pairs.join(left, F.col("a") == F.col("fa")).join(right, F.col("b") == F.col("fb")).select("a", "b", "x", "y"))
    return full.mapInArrow(tidy(_linked(percent)), "a long, b long")


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles at each of a power of two of bits, at least twice as many as shingles.

    Two sketches differ in no more bits than their sets differ in elements.
    """
    bits = 256
    while bits < 2 * len(shingles):
        bits *= 2
    at = (mix(shingles) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(_wide(x)) for x in b.column(1).to_pylist()], pa.binary())],
                                         names=["fp", "sketch"])


def _near(fp: np.ndarray, n: np.ndarray, label: np.ndarray, sketches: list[bytes], side: np.ndarray, percent: int,
          closest: bool) -> list[np.ndarray]:
    """Pairs of a group in different components that sizes and sketches don't rule out; across sides where there are two.

    ``closest``: only the pair with the closest sketches for each two components.
    """
    words_ = np.array([len(x) // 8 for x in sketches])
    by = np.argsort(-words_, kind="stable")
    fp, n, label, side, words_ = fp[by], n[by], label[by], side[by], words_[by]
    # at each width the sketches of that width and, folded, the wider ones, which stand before them
    folded = {}
    for w in np.unique(words_).tolist():
        upto = int((words_ >= w).sum())
        folded[w] = (int((words_ > w).sum()), upto, np.stack([
            np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, w), axis=0) for i in by[:upto]]))
    two = side.min() != side.max()
    out = []
    for i in range(len(fp) - 1):
        for lo, hi, rows in folded.values():
            lo = max(lo, i + 1)
            if lo >= hi:
                continue
            rest = slice(lo, hi)
            small, large = np.minimum(n[i], n[rest]), np.maximum(n[i], n[rest])
            ok = (label[rest] != label[i]) & (small * 100 >= large * percent)
            if two:
                ok &= side[rest] != side[i]
            j = np.flatnonzero(ok) + lo
            if not len(j):
                continue
            differ = np.bitwise_count(rows[j] ^ rows[i]).sum(axis=1, dtype=np.int64)
            ok = differ * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            j = j[ok]
            out.append(np.stack([np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j]), np.minimum(label[i], label[j]),
                                 np.maximum(label[i], label[j]), differ[ok] * 1000 // (n[i] + n[j])]))
    if not out:
        return out
    pairs = np.concatenate(out, axis=1)
    if closest and pairs.shape[1]:
        pairs = pairs[:, np.lexsort(pairs[[1, 0, 4, 3, 2]])]
        pairs = pairs[:, np.concatenate([[True], (pairs[2:4, 1:] != pairs[2:4, :-1]).any(axis=0)])]
    return [pairs[:2]]


def _open_pairs(groups: DataFrame, label: DataFrame, short: DataFrame, percent: int, block: int, closest: bool) -> DataFrame:
    """Pairs (a, b) still to be verified: in one group, in different components, not ruled out.

    Only they leave the tasks. A group of more than ``block`` sets is compared in pieces of
    that size, one pair of pieces at a time.
    """
    placed = groups.join(label, groups["fp"] == label["node"], "left").select("gid", "fp", "n", F.coalesce("label", "fp").alias("label"))
    open_ = (placed.groupBy("gid").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("m"))
             .where("l <> h").select("gid", F.ceil(F.col("m") / block).cast("int").alias("pieces")))
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    rows = (placed.join(open_, "gid").join(short, "fp").withColumn("side", piece)
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .select("gid", F.least("side", "with").alias("p"), F.greatest("side", "with").alias("q"), "side", "fp", "n", "label", "sketch"))
    rows = rows.repartition("gid", "p", "q").sortWithinPartitions("gid", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.Table) -> Iterator[np.ndarray]:
            gid, p, q, side, fp, n, lab = (t[c].to_numpy() for c in ("gid", "p", "q", "side", "fp", "n", "label"))
            sk = t["sketch"].to_pylist()
            cut = np.flatnonzero(np.concatenate([[True], (gid[1:] != gid[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), [True]]))
            for lo, hi in zip(cut[:-1], cut[1:]):
                if hi - lo > 1 and not (p[lo] != q[lo] and side[lo:hi].min() == side[lo:hi].max()):
                    yield from _near(fp[lo:hi], n[lo:hi], lab[lo:hi], sk[lo:hi], side[lo:hi], percent, closest)

        def emit(t: pa.Table) -> pa.RecordBatch:
            found = list(pairs(t))
            both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = [t[c].to_numpy() for c in ("gid", "p", "q")]
            same = np.logical_and.reduce([k == k[-1] for k in key])
            start = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if start:
                yield emit(t.slice(0, start))
            held = t.slice(start)
        if held is not None and held.num_rows:
            yield emit(held)

    return rows.mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, chunk_bytes: int = 4 << 20, block: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    ship(docs.sparkSession)
    table = candidate_tables(docs, k, percent, chunk_bytes)
    groups = stored(table.where("kind = 1").select("bucket", "blob").groupBy("bucket")
                    .applyInArrow(freed(_groups), "gid long, fp long, n long, weight long")
                    .groupBy("gid", "fp").agg(F.min("n").alias("n"), F.sum("weight").alias("weight")))
    sets = table.where("kind = 2").groupBy("fp").agg(F.first("blob").alias("blob"))
    # the hub of a group is the member that shares most signatures with others: of near copies, their original
    degree = groups.groupBy("fp").agg(F.sum("weight").alias("degree"))
    hub = groups.join(degree, "fp").groupBy("gid").agg(F.max(F.struct("degree", "fp"))["fp"].alias("hub"))
    groups = stored(groups.join(hub, "gid"))
    best = stored(groups.where("fp <> hub").groupBy("fp", "hub").agg(F.sum("weight").alias("w"))
                  .groupBy("fp").agg(F.max_by("hub", F.struct("w", "hub")).alias("hub"))
                  .select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")).distinct())
    links = stored(_verify(best, sets, percent))
    # groups with one hub are compared as one: what shares a group shares its hub
    groups = stored(groups.groupBy(F.col("hub").alias("gid"), "fp").agg(F.min("n").alias("n")))
    label = components(links)
    short = stored(sets.mapInArrow(tidy(_sketches), "fp long, sketch binary"))
    # the closest pair of any two components first: most of what belongs together is joined by it
    tried = stored(_open_pairs(groups, label, short, percent, block, True).join(best, ["a", "b"], "left_anti"))
    links = stored(links.unionByName(_verify(tried, sets, percent)))
    label = components(links)
    left = (_open_pairs(groups, label, short, percent, block, False)
            .join(best.unionByName(tried), ["a", "b"], "left_anti"))
    more = stored(_verify(left, sets, percent))
    if more.limit(1).count():
        label = components(links.unionByName(more))
    rows = table.where("kind = 0").select("doc_id", "n", "fp")
    keyed = rows.join(label, (rows["fp"] == label["node"]) & (rows["n"] > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("label", "fp")).alias("class"))
    smallest = keyed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    return keyed.join(smallest, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
