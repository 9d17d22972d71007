"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame operations only.

A window is every run of ``window`` consecutive words of an item (an item of fewer is
one window). A document contains a window only if it contains each of its words, so
one word is a sufficient prefix: words are ordered by how often they occur in the
documents, and each window is looked up by its rarest word. An occurrence of that
word in a document fixes where the window would have to start; positions outside the
document are out of bounds, and the words in between are compared exactly.

The look-up table holds one row per distinct window of the benchmark. Up to
``broadcast_windows`` of them (counted first) it is broadcast and the comparison
happens in the scan's own stage, so no document text is shuffled. Beyond that the
occurrences are shuffled by word and the candidates verified against the documents
by key.

Defined results: null or wordless text has no words and is clean; null item ids are
ignored, repeated items count once; rows repeated under one doc_id are judged each by
its own text; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survlake.llm.tables import LOWER, UPPER, stored

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; the plain ``lower`` serves where all characters are ASCII."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (window id, words of the window, item id)."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = items.where(F.size("w") > 0).select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    return cut.select(F.md5(F.concat_ws(" ", "win").cast("binary")).alias("win_id"), "win", "item_id").distinct()


def _key_words(docs: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """For every window its rarest word and where that stands in it; windows with a word no document has go."""
    hint = F.broadcast if small else (lambda df: df)
    placed = wins.select("win_id", "win", F.posexplode("win").alias("off", "word"))
    vocabulary = placed.select("word").distinct()
    found = (docs.select(F.explode_outer("words").alias("word")).join(hint(vocabulary), "word")
             .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    ranked = placed.join(F.broadcast(found) if small else found, "word", "left")
    return (ranked.groupBy("win_id").agg(
                F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")).alias("k"), F.first("win").alias("win"))
            .where("k.n > 0").select(F.col("k.word").alias("word"), F.col("k.off").alias("off"), "win_id", "win"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_windows: int = 200_000
                ) -> tuple[DataFrame, DataFrame]:
    """All places where a window occurs, with one row per document in front, and the windows of the items.

    First table: doc_id, text_hash, n_words, and for occurrences start, len, win_id
    (null on the row that stands for the document).
    """
    items = stored(item_windows(benchmark, window))
    wins = items.dropDuplicates(["win_id"]).select("win_id", "win")
    small = items.count() <= broadcast_windows
    texts = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), words(F.col("text")).alias("words"))
    keys = _key_words(texts, wins, small)
    # a word that no text has stands first in every document: its row carries the document itself
    spread = texts.select("doc_id", "text_hash", "words", F.size("words").alias("n_words"),
                          F.posexplode_outer(F.concat(F.array(F.lit("")), "words")).alias("at", "word"))
    start = F.col("at") - 1 - F.col("off")
    inside = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
    same = F.slice("words", F.greatest(start + 1, F.lit(1)), F.size("win")) == F.col("win")
    out = ["doc_id", "text_hash", "n_words", "start", "len", "win_id"]
    if small:
        spark = docs.sparkSession
        mark = spark.createDataFrame([("", 0, None, [])], keys.schema)
        found = spread.join(F.broadcast(keys.unionByName(mark)), "word").where(F.col("win_id").isNull() | (inside & same))
        table = found.select("doc_id", "text_hash", "n_words", start.alias("start"), F.size("win").alias("len"), "win_id")
    else:
        near = (spread.drop("words").join(keys, "word").where(inside)
                .select("doc_id", "text_hash", "n_words", start.alias("start"), "win_id", "win"))
        t = texts.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "words")
        hits = (near.join(t, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
                .where(F.slice("words", F.col("start") + 1, F.size("win")) == F.col("win"))
                .select("doc_id", "text_hash", "n_words", "start", F.size("win").alias("len"), "win_id"))
        table = (texts.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.lit(0).alias("start"),
                              F.lit(0).alias("len"), F.lit(None).cast("string").alias("win_id")).unionByName(hits))
    return stored(table.select(out)), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and text_hash."""
    table, items = occurrences(docs, benchmark, window, broadcast_windows)
    hits = table.where("win_id IS NOT NULL").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "start", "len", "win_id")
    n_hit = (hits.select("d", "h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p"))
             .distinct().groupBy("d", "h").agg(F.count(F.lit(1)).alias("n_hit")))
    owners = items.select("win_id", F.col("item_id").cast("string").alias("item"))
    named = (hits.select("d", "h", "win_id").distinct().join(owners, "win_id").select("d", "h", "item").distinct()
             .groupBy("d", "h").agg(F.array_sort(F.collect_list("item")).alias("found")))
    both = n_hit.join(named.select(F.col("d").alias("d2"), F.col("h").alias("h2"), "found"),
                      F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")))
    rows = table.where("win_id IS NULL").select("doc_id", "text_hash", "n_words")
    full = rows.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return full.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n.alias("n_hit"),
                       F.size(found).cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", found).cast("binary"), 256).alias("items_sha256"),
                       (n > 0).alias("contaminated"), "text_hash")
