"""Mixing, alignment and hard negatives against plain Python versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from survlake.llm import align, mixing, negatives
from survlake.llm.queries import tokenizer_path

DOC = "doc_id long, text string, source string, size long, row string"


# --- mixing ----------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Rounds of sharing out until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > repeats * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def corpus(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):  # source a holds most rows; one document is very long
        source = "a" if i % 3 else rng.choice(["b", "é", "zz", "", None])
        n = 20_000 if i == 333 else rng.randint(0, 60)
        rows.append((i, " ".join("w%d" % rng.randint(0, 9) for _ in range(n)), source, 1, "x"))
    rows += [(5000, None, "a", 1, "x"), (5001, "", "only", 1, "x"), (None, "one two", "b", 1, "x"), (None, None, None, None, None)]
    rows += [(7, "same text", "b", 1, "x")] * 5
    return spark.createDataFrame(rows, DOC), rows


def test_mix_against_targets_and_rules(spark):
    docs, rows = corpus(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    words = Counter()
    for r in rows:
        words[r[2]] += len((r[1] or "").split())
    want = brute_targets(words)
    known = {(r[0], len((r[1] or "").split())) for r in rows}
    taken, largest = Counter(), Counter()
    for g in got:
        assert g.taken in (0, g.size, 2 * g.size) and (g.doc_id, g.size) in known
    plan = mixing.schedule(docs).collect()
    for p in plan:
        assert p.source_size == words[p.source] and p.target == pytest.approx(want[p.source])
        taken[p.source] += p.size * p.taken
        largest[p.source] = max(largest[p.source], p.size)
    for s in words:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sum(taken.values()) <= sum(want.values()) + 1e-6
    order = sorted(plan, key=lambda p: p.position)
    assert [p.finish for p in order] == sorted(p.finish for p in order)
    assert order[-1].position == 2 * sum(words.values())
    # every queue is a sum over its own documents, and the whole order a sum over all
    run = Counter()
    for p in sorted((p for p in plan if p.size), key=lambda p: p.finish):
        run[p.source] += p.size
        assert p.finish == pytest.approx(run[p.source] / want[p.source])
    again = mixing.mix(docs.repartition(13)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(again, key=key) == sorted(got, key=key)


def test_mix_edges(spark):
    empty = spark.createDataFrame([], DOC)
    assert mixing.mix(empty).collect() == []
    no_words = spark.createDataFrame([(1, None, "a", 0, ""), (2, " \t", None, 0, "")], DOC)
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(no_words).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    one = spark.createDataFrame([(1, "a b c d", "x", 0, "")], DOC)
    assert [(r.target, r.taken) for r in mixing.mix(one).collect()] == [(6.0, 4)]


def test_many_sources_by_salted_join(spark, monkeypatch):
    docs, _ = corpus(spark)
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


# --- alignment -------------------------------------------------------------


TEXTS = ["Hello world, it's 2024!", None, "", " leading and  double  spaces ", "naïve café 東京 🙂\n\ttabs", "▁ is a mark", "</s> <unk> <|endoftext|>",
         "the cat sat on the mat the cat", "the cat sat on the mat the cat", "a\x00b", "x" * 3000, "The quick brown fox. " * 400]


def brute_alignment(texts):
    a, b, _, _ = align.sides(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    docs, count = [], Counter()
    for t in texts:
        x = y = []
        if t:
            x, y = tok.encode(" " + t, add_special_tokens=False).ids, b.encode([t])[0]
            raw = (" " + t).encode()
            if b"".join(a.bytes[i] for i in x) != raw or b"".join(b.bytes[i] for i in y) != raw:
                x = y = []

        def spans(ids, side):
            out, at = [], 0
            for i in ids:
                out.append((at, at + len(side.bytes[i]), i))
                at = out[-1][1]
            return out

        sx, sy = spans(x, a), spans(y, b)
        links = [(p[2], q[2]) for p in sx for q in sy if p[1] == q[1]] if len(sx) * len(sy) < 10**7 else None
        cut = sorted({p[1] for p in sx} & {q[1] for q in sy})
        groups, lo = [], 0
        for c in cut:
            groups.append(",".join(str(p[2]) for p in sx if lo < p[1] <= c) + "|" + ",".join(str(q[2]) for q in sy if lo < q[1] <= c))
            lo = c
        over = [(i, j) for i, p in enumerate(sx) for j, q in enumerate(sy) if p[0] < q[1] and q[0] < p[1]]
        docs.append((len(x), len(y), groups, links, over))
        count.update(links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(na, nb, len(g), len(ln), sum(count[p] == best[p[1]] for p in ln), sum(count[p] for p in ln),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", over) for na, nb, g, ln, over in docs]


@pytest.mark.parametrize("sent", [align.SENT, 0])
def test_alignment_against_brute_force(spark, sent):
    docs = spark.createDataFrame([(i, t, "s", 3, "n") for i, t in enumerate(TEXTS)], "doc_id long, text string, links string, n_a int, _row string")
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in align.align(docs.repartition(3), *paths, sent=sent).collect()}
    want = brute_alignment(TEXTS)
    for i, w in enumerate(want):
        g = got[i]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum, g.groups_sha256) == w[:7], TEXTS[i]
    assert want[1][:3] == want[2][:3] == want[5][:3] == (0, 0, 0)   # null, empty, the mark that reads as a space
    if sent:
        for r in align.overlaps(docs, *paths).collect():
            assert [(p.a, p.b) for p in r.pairs] == want[r.doc_id][7]
            assert len(r.groups) == want[r.doc_id][2]


def test_alignment_empty_and_null_ids(spark):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), *paths).collect() == []
    got = align.align(spark.createDataFrame([(None, "a b"), (None, None), (None, "a b")], "doc_id long, text string"), *paths).collect()
    assert sorted(r.n_links for r in got) == [0, 2, 2] and sum(r.count_sum for r in got) == 8


# --- hard negatives --------------------------------------------------------


def brute_negatives(rows):
    use = []
    for i, (k, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if k is not None and k % 7 == 0:
            label = (label + 1) % 10
        use.append((i, k, [math.floor(256 * x) for x in v], label))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, k, v, label in use:
        if k is None or k % 100:
            continue
        scored = [(q, sum(x * y for x, y in zip(v, w)), m == label) for j, q, w, m in use if j != i]
        positives = sorted(((q, s) for q, s, same in scored if same), key=order)[:5]
        others = sorted(((q, s) for q, s, same in scored if not same), key=order)
        for q, p in positives:
            fit = [(n, s) for n, s in others if 80 * p <= 100 * s <= 100 * p][:5]
            out += [(k, q, rank, n, p, s) for rank, (n, s) in enumerate(fit, 1)]
    return out


def found(spark, rows, **more):
    table = spark.createDataFrame([(k, v, label, 1, "d") for k, v, label in rows], "vec_id long, embedding array<float>, label int, uid long, data string")
    return [tuple(r) for r in negatives.hard_negatives(table.repartition(4), **more).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_negatives_against_brute_force(spark):
    rng = random.Random(3)
    f = lambda x: float.fromhex(float(x).hex())
    rows = []
    for i in range(700):
        center = i % 4
        v = [round(rng.gauss(0.4 if d % 4 == center else 0, 0.2) * 32) / 32 for d in range(12)]   # coarse: many ties
        rows.append((i, [f(x) for x in v], rng.choice([1, 1, 1, 2, 9])))
    rows[5] = (5, None, 1)
    rows[6] = (6, rows[6][1], None)
    rows[8] = (8, [None] + rows[8][1][1:], 1)
    rows[9] = (9, [float("nan")] + rows[9][1][1:], 1)
    rows[10] = (10, [float("inf")] + rows[10][1][1:], 1)
    rows[11] = (None, rows[11][1], 1)
    rows[12] = (12, rows[12][1][:7], 1)          # shorter
    rows[13] = (13, [], 1)
    rows += [rows[200], rows[200], rows[201], rows[201]]
    want = plain(brute_negatives(rows))
    assert len(want) > 100
    assert plain(found(spark, rows, block_rows=64)) == want
    assert plain(found(spark, rows, block_rows=50, stripe_bytes=200, parts=3)) == want   # several stripes of anchors


def test_negatives_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []                       # no positive
    assert found(spark, [(100, [1.0], 1), (101, [-1.0], 1), (102, [-1.0], 2)]) == []    # a negative score opens no window
    assert found(spark, [(100, [1.0], 1), (101, [0.0], 1), (102, [0.0], 2)]) == [(100, 101, 1, 102, 0, 0)]
    assert found(spark, [(100, [1e6], 1), (101, [1e6], 1), (102, [9e5], 2)]) == brute_negatives(
        [(100, [1e6], 1), (101, [1e6], 1), (102, [9e5], 2)])
    with pytest.raises(Exception, match="63 bits"):
        found(spark, [(100, [1e30], 1), (101, [1e30], 1)])


def test_scan_leaves_exactly_the_window(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(-90, 90, (40, 500))
    block = negatives.Block({"data": x.tobytes(), "dims": 40, "n": 500, "labels": [0] * 500, "ids": list(range(500)), "base": 0}, 40, 90)
    v = rng.integers(-90, 90, 40)
    full = v @ x
    lo, hi = np.sort(full)[[-40, -20]]
    got, score = negatives.scan(v, block, np.arange(500), lo, hi)
    assert got.tolist() == np.flatnonzero((full >= lo) & (full <= hi)).tolist() and score.tolist() == full[got].tolist()
