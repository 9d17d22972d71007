"""Each operator against brute force or an exact round trip, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from survlake.llm import bpe, brown, chat, decontam, graph, html_text, iblt, jaccard, language, quality, suffixes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk int, n long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


@pytest.fixture(scope="module")
def corpus(spark):
    """Near and exact copies, nulls, empties, short, long and repeated texts, with extra columns whose names clash."""
    rng = np.random.default_rng(3)
    vocab = ["w" + "".join(rng.choice(list("abcdeé"), 4)) for _ in range(400)]
    base = [" ".join(rng.choice(vocab, n)) + "." for n in (60, 90, 130, 300, 40)]
    texts = [None, "", " \n ", "one two", "One  two", "é" * 70]
    for t in base:
        w = t.split()
        texts += [t, t]
        for edits in (1, 2, 4, 9):
            v = list(w)
            for i in rng.choice(len(v), edits, replace=False):
                v[i] = "x" + v[i]
            texts.append(" ".join(v))
        texts.append("intro " + t[:120] + " and more " + " ".join(rng.choice(vocab, 30)))
    texts.append(" ".join(rng.choice(vocab, 30_000)))
    rows = [(i, t, ("en", "de", None)[i % 3], "s", len(t or ""), 7, 9) for i, t in enumerate(texts)]
    rows.append(rows[6])  # one row twice
    return spark.createDataFrame(rows, DOCS), rows


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_chat_round_trip(spark):
    hard = ["", "<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "a<\\\\|b", "<|", "<|im_", "plain <|other|>", "\n"]
    for role in ("user", "a\nb", "a\\nb", "", "<|im_end|>"):
        for text in hard:
            assert [t[:2] for t in chat.parse(chat.render_turn(role, text))] == [(role, text)]
    assert chat.render_turn("user", "a <|x|>") == "<|im_start|>user\na <|x|><|im_end|>\n"
    rows = [(1, 1, "assistant", hard[2], 0), (1, 0, "user", None, 0), (2, 0, None, "x", 0), (None, 5, "assistant", "y", 0), (1, 1, "assistant", hard[2], 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    text = "user\n\n" + 2 * f"assistant\n{hard[2]}\n"
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[1]["loss_chars"] == 2 * len(hard[2]) and got[None]["n_turns"] == 1
    segs = chat.format_conversations(df).where("conv_id = 1").orderBy("turn_no").collect()
    whole = "".join(s["segment"] for s in segs)
    assert len(whole) == got[1]["formatted_chars"]
    assert [chat.unescape(whole[s["loss_start"]:s["loss_end"]]) for s in segs] == ["", hard[2], hard[2]]
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_resampling_takes_exactly_k(spark, corpus, empty):
    docs, rows = corpus
    labels = spark.createDataFrame([(i, int(i % 2), 0, "t") for i in range(0, 30)] + [(6, 1, 1, "t"), (999, 1, 0, "t"), (None, 1, 0, "t")],
                                   "doc_id long, quality int, toxic int, text string")
    got = quality.resample(docs, labels, share=0.4).toPandas()
    k = round(0.4 * len(rows))
    keys = sorted(got.selection_key, reverse=True)
    assert abs(got.selected.sum() - k) <= 1 and len(got) == len(rows)  # a row that is there twice stands or falls whole
    assert got[got.selected].selection_key.min() >= keys[k]
    assert got[got.doc_id.isin([0, 1])].log_weight.abs().max() == 0
    assert quality.resample(empty, labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).where("log_weight <> 0").count() == 0


def _brute_scores(model, docs):
    """log10 probability of each text from the model's classes, word by word."""
    from survlake.llm.tokens import words as hashed

    count, place = {}, {}
    for r in model.vocab.collect():
        own = 0
        for h, c in zip(brown._unpacked(r["h"], np.uint64).tolist(), brown._unpacked(r["c"], np.int64).tolist()):
            count[h] = c
            if c >= model.least:
                place[h] = (r["bucket"], own)
                own += 1
    state = {r["bucket"]: brown._unpacked(r["cls"], np.uint8) for r in model.state.collect()}

    def cls(w):
        h, _, tail = hashed(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
        h = int(h[0])
        b, i = place.get(h, (model.chunks + int(tail[0]) % brown.SPREAD, int(tail[0]) // brown.SPREAD))
        return int(state[b][i]), count.get(h, 0)
    texts = [(i, [cls(w) for w in words(t)]) for i, t in docs]
    n, v = collections.Counter({model.k: model.n_texts}), collections.Counter()
    pairs, seen = np.zeros((model.k + 1, model.k + 1)), {}
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 10:
            c = [model.k] + [cls(w)[0] for w in words(t)] + [model.k]
            n.update(c[1:-1])
            np.add.at(pairs, (c[:-1], c[1:]), 1)
            seen.update((w, cls(w)[0]) for w in words(t))
    v.update(seen.values())
    assert (pairs == model.pairs).all() and all(n[c] == model.n_class[c] and v[c] == model.v_class[c] for c in range(model.k))
    unigram = (pairs.sum(axis=0) + 1) / (pairs.sum() + model.k + 1)
    out = []
    for i, t in texts:
        s, prev = 0.0, model.k
        for c, m in t + [(model.k, None)]:
            s += np.log10((pairs[prev, c] + model.k * unigram[c]) / (pairs[prev].sum() + model.k))
            if m is not None:
                s += np.log10((m + 0.1) / (n[c] + 0.1 * (v[c] + 1)))
            prev = c
        out.append((i, round(s, 6)))
    return sorted(out)


def test_brown_scores(spark, corpus, empty):
    docs, rows = corpus
    model = brown.learn(docs, classes=4, chunk_bytes=4000)
    got = brown.judged(model).collect()
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows}
    count = collections.Counter(w for r in rows if not held[r[0]] for w in words(r[1]) + [None])
    n, v = sum(count.values()), len(count)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        w = words(text[r["doc_id"]]) + [None]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(w), n)
        assert r["n_known"] == sum(count[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
    assert len(got) == len(rows) and brown.score(empty).count() == 0
    assert model.rounds > 0
    want = _brute_scores(model, [(r[0], r[1]) for r in rows])
    for (i, s), (j, t) in zip(sorted((r["doc_id"], r["score"]) for r in got), want, strict=True):
        assert i == j and s == pytest.approx(t, abs=1e-5 * max(1, abs(t)))


def test_brown_finds_word_classes(spark):
    """Words that alternate by kind end in classes by kind, the rare ones above the fixed count too."""
    rng = np.random.default_rng(1)
    nouns, verbs = [f"n{i}q" for i in range(60)], [f"v{i}q" for i in range(60)]
    texts = [" ".join(x for _ in range(20) for x in (nouns[rng.integers(60)], verbs[rng.integers(60)])) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = brown.score(docs, classes=2).agg(F.sum("score")).first()[0]
    assert got > -200 * 40 * (np.log10(60) + 0.06)  # with the true classes log10(60) a word, without classes log10(120)


def test_exchange_gain_is_exact():
    rng = np.random.default_rng(0)
    k, items = 4, 12
    v = rng.integers(0, 9, (items, 2 * (k + 1))).astype(float)
    own = rng.integers(0, k, items)

    def value(cl):
        a = np.array([v[cl == b].sum(axis=0) for b in range(k)])
        return sum(brown.xlogx(a[:, s]).sum() - brown.xlogx(a[:, s].sum(axis=1)).sum() for s in (slice(0, k + 1), slice(k + 1, None)))
    counts = np.array([v[own == b].sum(axis=0) for b in range(k)] + [np.zeros(2 * (k + 1))])
    g = brown.gains(v, own, counts, k)
    for i in range(items):
        for b in range(k):
            moved = own.copy()
            moved[i] = b
            assert g[i, b] == pytest.approx(value(moved) - value(own), abs=1e-9)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, corpus, empty, limit):
    docs, rows = corpus
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    long_ = plain(rows[13][1])
    items = [(1, " ".join(long_[5:30])), (10, " ".join(long_[20:33]).upper()), (2, "one, two"), (3, None), (4, "..."), (None, "one"),
             (5, "never seen words in any of these documents at all here"), (2, "one, two")]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    wins = {}
    for i, t in items:
        w = plain(t)
        if i is not None and w:
            for s in range(max(1, len(w) - 9)):
                wins.setdefault(tuple(w[s:s + 10]), set()).add(str(i))
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench, broadcast_windows=limit).collect()}
    for r in rows:
        w, hit, found = plain(r[1]), set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        g = got[r[0]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert g["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert any(g["contaminated"] for g in got.values())
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("kw", [{}, {"chunk_bytes": 3000, "hot": 2, "most_ranges": 3}, {"chunk_bytes": 20_000, "hot": 5}])
def test_suffixes(spark, corpus, empty, kw):
    docs, rows = corpus
    first = {}
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda x: x[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs, carry=("source", "chunk"), with_text=True, **kw).collect()}
    for i, t in ((r[0], r[1]) for r in rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        g = got[i]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert g["kept"] == kept.decode("utf-8", "ignore") and len(g["spans"]) == spans and g["chunk"] == 7
    assert suffixes.remove_repeats(empty).count() == 0


def test_loser_tree_merges():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 7):
        runs, rows = [], []
        for _ in range(k):
            r = sorted(bytes(rng.integers(97, 99, 50, dtype=np.uint8)[:6].tolist() + [97] * 44) for _ in range(int(rng.integers(0, 40))))
            shared = suffixes._shared(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 50)).tolist()
            runs.append(([int.from_bytes(x, "big") for x in r], shared))
            rows.append(r)
        at, last = [0] * k, None
        for run, known in suffixes.merge(runs):
            x = rows[run][at[run]]
            at[run] += 1
            if last is not None:
                assert x >= last
                assert known == next((i for i in range(50) if x[i] != last[i]), 50)
            last = x
        assert at == [len(r) for r in rows]


def test_jaccard_components(spark, corpus, empty):
    docs, rows = corpus
    sets = {}
    for r in rows:
        w = words(r[1])
        sets[r[0]] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for kw in ({}, {"chunk_bytes": 3000, "block": 2}):
        got = jaccard.near_duplicates(docs, **kw).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    assert jaccard.near_duplicates(empty).count() == 0


def test_parity_sketches_bound_the_distance():
    rng = np.random.default_rng(2)
    for n in (1, 5, 200, 900):
        a = rng.integers(0, 1 << 47, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 47, n - n // 2).astype(np.uint64)])
        x, y = (np.frombuffer(jaccard.sketch(np.unique(s)), np.uint8) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 30), (30, 35)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in (30, 35, 40)} == {30}


def test_fingerprints(spark, corpus, empty):
    docs, rows = corpus
    got = {r["doc_id"]: r for r in iblt.fingerprints(docs).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0], x[1]), reverse=True)
    for i, (k, t) in enumerate(order):
        follow = order[(i + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + follow[:m]
        g = got[k]
        if order.count((k, t)) == 1:
            assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and g["n_chars"] == len(t)
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and got[7]["near_next"] == 1.0
    assert got[1]["near_next"] == 1.0  # empty and null are alike
    assert iblt.fingerprints(empty).count() == 0


def test_sketch_difference_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n, m, common in ((0, 0, 0), (5, 3, 2), (30, 30, 10), (60, 50, 0), (120, 90, 5), (1, 0, 4000), (3, 2, 900), (3000, 10, 40), (0, 7, 0)):
        c = [int(x) for x in rng.integers(-2**62, 2**62, common)]
        rows.append((c + [int(x) for x in rng.integers(-2**62, 2**62, n)], c + [int(x) for x in rng.integers(-2**62, 2**62, m)], n, m))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int, m int")
    got = df.select("n", "m", iblt.difference(F.col("a"), F.col("b")).alias("d"), F.least(*[iblt.width(F.col(x)) for x in "ab"]).alias("first"),
                    iblt.power((F.size("a") + F.size("b")) * 2).alias("full")).collect()
    for r in got:
        assert (r["d"]["only_a"], r["d"]["only_b"]) == (r["n"], r["m"])
        assert r["first"] <= r["d"]["exponent"] <= r["full"] + 2     # a sketch gave it, after few tries
    first = [r["d"]["exponent"] == r["first"] for r in got]
    assert first[0] and first[5] and first[6] and not any(first[i] for i in (3, 4, 7))


def test_written_fingerprints_hold_the_sketch(spark):
    keys = [5, -7, 1 << 40, (1 << 62) + 3]
    row = spark.createDataFrame([(keys,)], "k array<long>").select(
        iblt.fingerprint(F.col("k")).alias("f"), F.transform("k", lambda x: F.xxhash64(x)).alias("checks")).first()
    cells = collections.defaultdict(lambda: [0, 0, 0])
    for key, check in zip(keys, row["checks"]):
        for t in range(3):
            c = cells[((key >> (21 * t)) & 7) + 8 * t]
            c[0] += 1
            c[1] ^= key & (1 << 64) - 1
            c[2] ^= check & (1 << 64) - 1
    want = [f"{at}:{n}:{key:X}:{check & 0xFFFFFFFF:X}" for at, (n, key, check) in sorted(cells.items())]
    assert row["f"] == "3/4/" + ",".join(want)


def test_likeness_of_long_edited_contained_and_cjk_texts(spark):
    rng = np.random.default_rng(6)
    vocab = ["v" + "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    long_ = "\n\n".join(" ".join(rng.choice(vocab, 12)) + ". " + " ".join(rng.choice(vocab, 9)) + "." for _ in range(1500))

    def changed(t, times):
        t = list(t)
        for i in rng.choice(len(t), times, replace=False):
            t[i] = "X"
        return "".join(t)
    signs = [chr(0x4E00 + int(x)) for x in rng.integers(0, 5000, 6000)]
    cjk, bare = "".join(c + ("\u3002" if i % 25 == 24 else "") for i, c in enumerate(signs)), "".join(signs)
    plain = " ".join(rng.choice(vocab, 8000))
    pairs = [(long_, changed(long_, 20)), (long_, long_[: len(long_) // 6]), (cjk, "\u4e00" + cjk), (bare, "\u4e00" + bare),
             (plain, "intro " + plain), (long_, plain), ("", None), ("one. two.", "two. one."), (long_, long_)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string")
    got = (df.withColumn("a", iblt.digests(F.col("x"))).withColumn("b", iblt.digests(F.col("y")))
           .withColumn("like", iblt._likeness("a", "b")).orderBy("i").collect())
    for r in got:
        a, b = set(r["a"]), set(r["b"])
        assert r["like"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    like = [r["like"] for r in got]
    assert like[0] > 0.97 and 0.14 < like[1] < 0.19 and min(like[2:5]) > 0.9 and like[5] < 0.01 and like[6] == like[8] == 1.0
    assert len(got[0]["a"]) > 2500
    docs = spark.createDataFrame([(2, long_), (1, changed(long_, 20))], "doc_id long, text string")
    assert min(r["near_next"] for r in iblt.fingerprints(docs).collect()) > 0.97


def test_bpe_equals_the_library(spark, corpus, empty):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    c = bpe.codec(path)
    rng = np.random.default_rng(4)
    pool = [*"abcdestring  ''\n\u0085 \u001c019½ÉßΣςİı<|>$#́日\U0001F600‍\x00", "<|endoftext|>", "</w>", "'re"]
    for _ in range(1500):
        t = "".join(rng.choice(pool, int(rng.integers(0, 50))))
        e = lib.encode(t, add_special_tokens=False)
        assert c.encode(t) == e.ids and c.decode(e.ids).decode() == lib.decode(e.ids, skip_special_tokens=False)
    docs, rows = corpus
    got = bpe.encode_documents(docs, path, with_ids=True).collect()
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        e = lib.encode(text[r["doc_id"]], add_special_tokens=False)
        assert r["ids"] == e.ids and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
    assert len(got) == len(rows) and bpe.encode_documents(empty, path).count() == 0


def test_html(spark):
    page = ("<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><a href='/'>Home</a></nav>"
            "<div class='ad'>Buy now</div><article><h1>Head &eacute;</h1><p><b>First  \n words of a paragraph<p>a&lt;b in the second one</p>"
            "</article><section id='comments'><p>Nice text thank you all</p></section><footer>&copy; me</footer>")
    rows = [(1, "u", page, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", "<p>cut off <b", "x"), (1, "u", page, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df, html_text.fit(df)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "Head é\nFirst words of a paragraph\na<b in the second one"
    assert text[2] == text[3] == "" and text[4].startswith("cut off") and len(got) == 5
    assert html_text.extract(df.limit(0), html_text.fit(df.limit(0))).count() == 0


def test_html_keeps_headings_inline_and_slug_sections():
    score = html_text.weights({})
    page = ("<body><nav>Home</nav><article><h2 id='related-work'>Related work</h2><p>Some words on what others did.</p>"
            "<pre><span class='token comment'># a note</span> x = 1</pre><section aria-label='Related work' id='legal-basis'><h3 id='legal-basis'>"
            "Legal basis</h3><p>The whole section stays in the text.</p></section><div class='share'>Share this</div><p>Last words of the page, which are quite a few more than the others.</p></article>"
            "<section id='comments'><p>Nice text</p></section></body>")
    assert html_text.main_text(page, score) == ("Related work\nSome words on what others did.\n# a note x = 1\nLegal basis\n"
                                                "The whole section stays in the text.\nLast words of the page, which are quite a few more than the others.")


@pytest.mark.parametrize("tag", ["<svg class='i'/>", "<object data='x' />", "<iframe src='x'/>", "<canvas/>", "<title/>", "<svg><title>t</title><g/></svg>",
                                 f"<div data-x='{'[1>0] ' * 1500}'></div>", f'<b title="{"a>b " * 1500}"></b>'])
def test_html_keeps_what_follows_a_tag(tag):
    page = f"<body><article><p>First words of it, also some more than a few of them.</p>{tag}<p>Second words of it, which are quite a few more than the first ones.</p></article></body>"
    assert html_text.main_text(page, html_text.weights({})) == "First words of it, also some more than a few of them.\nSecond words of it, which are quite a few more than the first ones."


@pytest.mark.parametrize("page, text", [
    ("<article><p>One two three.</p><script src='a.js'/>var leak = 1;</script><p>Four five six.</p></article>", "One two three.\nFour five six."),
    ("<article><p>Second one <svg><g><path/></g></svg> goes on <button>ok</button> and on</p></article>", "Second one goes on and on"),
    ("<article><p>Ten words or so are here to begin with.</p>" + "<ul>" + "".join(f"<li><a href='{i}'>l{i}</a></li>" for i in range(30)) + "</ul><p>tail one here</p></article>",
     "\n".join(["Ten words or so are here to begin with.", *[f"l{i}" for i in range(30)], "tail one here"])),
    ("<article><p>Ten words or so are here to begin with.</p><table>" + "".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(9)) + "</table></article><p>beside</p>",
     "\n".join(["Ten words or so are here to begin with.", *[x for i in range(9) for x in (str(i), "x")]])),
    ("<body><form action='/'><div><p>The whole page stands in one form, all of it.</p></div></form></body>", "The whole page stands in one form, all of it."),
    ("<body><form><input name='q'><label>Search</label></form></body>", ""),
    ("<body><p>No form and <nav>menu</nav></p></body>", "No form and")])
def test_html_blocks_and_edges(page, text):
    assert html_text.main_text(page, html_text.weights({})) == text


def test_html_takes_time_in_proportion_to_the_page():
    def took(n):
        t0 = time.process_time()
        html_text.main_text("<article>" + "<div>" * n + "words of it " + "</div></b>" * n + "</article>", html_text.weights({}))
        return time.process_time() - t0
    took(500)
    assert took(32_000) < 40 * max(took(2_000), 0.005)


def test_language_held_out_accuracy(spark, sf_dir, empty, corpus):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    got = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    net = language.fit(corpus[0])
    und = {r["doc_id"]: r["lang_pred"] for r in language.identify(corpus[0], net).collect()}
    assert und[0] == und[1] == und[2] == "und" and und[3] in ("en", "de")
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language.identify(corpus[0], None).collect()} == {"und"}
