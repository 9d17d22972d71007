"""Stages of the pipeline on rows that are easily lost or kept twice."""

import random

import corpus_pipeline
from survlake.llm import language, quality, suffixes
from survlake.llm.tables import read


def many(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_one_row_of_each_component(spark, sf_dir):
    rng = random.Random(1)
    a, b, c = many(rng, 60), many(rng, 60), many(rng, 60)
    rows = [(1, a), (1, a), (1, a + " x"), (2, a + " y"), (3, b), (3, c), (None, c), (None, c), (None, "own words of a null id here"),
            (None, None), (None, None), (4, None), (4, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "v", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, component_id string, n long")
    got = corpus_pipeline.one_of_near_copies(spark, docs, sf_dir)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [r for r in left if r[0] == 1][0][1] in (a, a + " x") and len([r for r in left if r[0] in (1, 2)]) == 1
    assert (3, b) in left and (3, c) in left
    assert [r[1] for r in left if r[0] is None and r[1]] == ["own words of a null id here"]
    assert len([r for r in left if not r[1]]) == 4   # (null, null) once, (4, null), (4, ''), (5, '')
    assert all(r.component_id == "v" for r in got.collect())


def test_carried_columns_keep_their_values(spark):
    text = "the same long passage stands in both of the documents, word for word, to the end"
    docs = spark.createDataFrame([(1, text, 77, "s1"), (2, text, 78, "s2")], "doc_id long, text string, n_bytes long, spans string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, carry=("n_bytes", "spans"), with_text=True).collect()}
    assert (got[1].n_bytes, got[1].spans, got[2].n_bytes, got[2].spans) == (77, "s1", 78, "s2")
    assert got[2].n_removed == len(text) and got[2].kept == ""


def test_language_keeps_clean_text(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    net = language.fit(docs)
    kept = language.accepted(docs, net)
    assert kept.columns == docs.columns
    lettered = docs.where(docs.text.rlike(r"\p{L}")).count()
    assert kept.count() >= 0.98 * lettered
    assert kept.where("doc_id IS NOT NULL").join(language.identify(docs, net).where("lang_pred = 'und'"), "doc_id", "left_semi").count() == 0
    assert language.accepted(docs.limit(0), net).count() == 0


def test_target_counts_meet_good_documents_only(spark, monkeypatch):
    docs, labels = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "labels")
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()
    want = docs.join(good, "doc_id", "left_semi").select("text")
    for bits in (1 << 29, 1):    # also with a filter far too small
        got = quality.texts_of(docs, good, bits)
        assert sorted(r.text or "" for r in got.collect()) == sorted(r.text or "" for r in want.collect())
    assert quality.texts_of(docs, good.limit(0)).count() == 0


def test_weights_against_plain_counts(spark):
    import math
    from collections import Counter

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Red", "blue", "green", "sky"] if i % 2 else ["dog", "cat", "sky"]) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, "sky dog"), (3, "red sky")]
    marks = [(i, int(i % 2 == 1), 0) for i in range(0, 60)] + [(1, 1, 1), (500, 1, 0), (None, 1, 0)]   # 1 is toxic in one label
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality.resample(docs, labels, buckets=1 << 20).collect()

    def grams(t):
        w = (t or "").lower().split()
        return [*w, *zip(w, w[1:])]

    good = {i for i in range(60) if i % 2 and i != 1}
    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for i, t in rows if i in good for g in grams(t))
    n, m, b = sum(target.values()), sum(raw.values()), 1 << 20
    want = sorted(round(sum(math.log((target[g] + 1) / (n + b)) - math.log((raw[g] + 1) / (m + b)) for g in grams(t)), 6) for _, t in rows)
    assert sorted(round(r.log_weight, 6) for r in got) == want
    labelled = [i in good for i, _ in rows if i is not None and i < 60]
    assert sum(r.selected for r in got) == round(sum(labelled) / len(labelled) * len(rows))
    best = sorted((r.selection_key for r in got), reverse=True)[:sum(r.selected for r in got)]
    assert sorted((r.selection_key for r in got if r.selected), reverse=True) == best
