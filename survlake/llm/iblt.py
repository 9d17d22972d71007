"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations only.

A text is cut into pieces by its content: at line and sentence ends (of many scripts), and a
sentence of more than 512 characters further where a hash of its last few words (or characters,
where no spaces are) says so. A piece does not depend on where it stands, and the number of
pieces grows with the text. Each piece's 64-bit digest goes into three cells of a sketch, one in
each third; a cell holds how many, the XOR of the digests and the XOR of their check hashes,
and cells that hold nothing are left out. Two sketches are compared by subtracting them cell by cell
and peeling: a cell with one digest left gives it away, it is taken out of its other cells, and
so on. The first try subtracts the sketches of the two fingerprints, the wider one folded to the narrower; if
cells are left, both sketches are built again with 6 to 12 places for each digest of both (empty ones cost nothing), at which peeling
all but always ends after a few rounds, and then twice as wide each time until it does. Digests of two texts are never compared. What is recovered are the pieces that only one
of the two has, so the likeness is the exact share of common pieces among all of both:
shared / (shared + recovered), for texts of any two lengths. A third has at most 2**21 places, as three of them take the 63 low bits
of a digest; what is left there (differences of more than about 5 million pieces) counts by the signs in its cells.

The fingerprint written out has about a cell for every 3 to 5 pieces (24 at least). Thirds are powers of
two wide and places are the low bits, so a wide sketch folds to a narrower one: the first try is that of the fingerprints written.

Defined results: null and empty texts have no pieces, the empty sketch, and likeness 1 to
each other and 0 to the rest; repeated pieces of one text count once; documents with one
doc_id follow each other by text, descending; a null doc_id comes after all; the only
document is its own next; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survlake.llm.tables import text_bytes

LEAST, BITS = 8, 21  # least cells of a third; bits of a digest that a place is taken from
ROUNDS = 32  # of peeling; a sketch as wide as a retry is needs about 4
LONG, WINDOW = 512, 4  # a sentence of more characters is cut further, by hashes of so many units
# Ends of lines and sentences: of Latin-1, and further ones. Latin-1 is spelt out, for then a character is one look into a table.
ENDS, WIDE_ENDS = "\n.!?", "…。！．？｡؟۔।॥።։။។"
_INNER = "(?:[" + "".join(f"\\x{i:02X}" for i in range(256) if chr(i) not in ENDS) + f"]++|[^\\x00-\\xFF{WIDE_ENDS}]++)"
SENTENCES = rf"{_INNER}*+(?:[{ENDS}]++|[{WIDE_ENDS}]++)++|{_INNER}++"
UNITS = r"(?s)\S{1,64}+(?:\s++|\z)|\s++|."  # words, or single characters where a run without spaces is longer


# Casts to these change nothing; they spare the analyzer from working out the types of nested expressions again and again.
CELLS = "array<struct<at:int,n:int,key:bigint,check:bigint>>"
DIFFERENCE = "struct<only_a:int,only_b:int,exponent:int>"
STATE = f"struct<cells:{CELLS},only_a:int,only_b:int,over:boolean>"
SKETCH = f"struct<exponent:int,cells:{CELLS}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once, as the end of an aggregate of nothing: a transform would copy the result, however deep."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def _cut(piece: Column) -> Column:
    """A long piece cut after the units whose last few hash to a multiple of 32, and every 512 units from there."""
    def ends(u: Column) -> Column:
        marks = F.transform(u, lambda _, i: F.when(
            (F.xxhash64(*[F.get(u, i - j) for j in range(WINDOW)]).bitwiseAND(F.lit(31)) == 0) | (i == F.size(u) - 1), i + 1))
        return F.filter(marks, lambda m: m.isNotNull())

    def parts(u: Column, e: Column) -> Column:
        def between(end: Column, k: Column) -> Column:
            return F.transform(F.sequence(F.coalesce(F.get(e, k - 1), F.lit(0)), end - 1, F.lit(LONG)),
                               lambda s: F.array_join(F.slice(u, s + 1, F.least(end - s, F.lit(LONG))), ""))
        return F.flatten(F.transform(e, between)).cast("array<string>")
    return let(F.regexp_extract_all(piece, F.lit(UNITS), F.lit(0)), lambda u: let(ends(u).cast("array<int>"), lambda e: parts(u, e)).cast("array<string>")).cast("array<string>")


def digests(text: Column) -> Column:
    """Distinct digests of the pieces."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCES), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(F.filter(found, lambda p: p != ""), lambda p: F.when(
        F.char_length(p) <= LONG, F.array(F.xxhash64(p))).otherwise(F.transform(_cut(p), lambda c: F.xxhash64(c))).cast("array<bigint>")))).cast("array<bigint>")


def power(least: Column) -> Column:
    """Exponent of the smallest power of two that is neither below ``least`` nor the least width."""
    return F.ceil(F.log2(F.greatest(least, F.lit(LEAST)).cast("double"))).cast("int")


def _word(place: Column, index: Column) -> Column:
    """A place and what stands there in one long: such sort several times as fast as structs."""
    return F.call_function("shiftleft", place, F.lit(32)).bitwiseOR(index.cast("long"))


def _place(word: Column) -> Column:
    return F.call_function("shiftright", word, F.lit(32)).cast("int")


def _index(word: Column) -> Column:
    return word.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _summed(words: Column, at: Callable[[Column], Column], alone: Callable[[Column, Column], Column], n: Callable[[Column], Column],
            key: Callable[[Column], Column], check: Callable[[Column], Column], kept: Callable[[Column], Column] | None = None) -> Column:
    """A cell for each place (of those ``kept``, by the least index there): the sums of ``n``, ``key`` and ``check`` of the indices; what comes to nothing is left out."""
    def cells(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x.bitwiseXOR(F.get(w, i - 1)) > F.lit(0xFFFFFFFF)), i)), lambda i: i.isNotNull())

        def cell(place: Column, values: list[Column]) -> Column:
            return F.struct(place.alias("at"), *[v.alias(name) for v, name in zip(values, ("n", "key", "check"))])

        def of(s: Column, size: Column) -> Column:
            first, second, place = _index(F.get(w, s)), _index(F.get(w, s + 1)), at(_place(F.get(w, s)))
            pair = cell(place, [n(first) + n(second), key(first).bitwiseXOR(key(second)), check(first).bitwiseXOR(check(second))])

            def many(r: Column) -> Column:
                none = F.lit(0).cast("long")
                return cell(place, [F.aggregate(r, F.lit(0), lambda z, i: z + n(i)), F.aggregate(r, none, lambda z, i: z.bitwiseXOR(key(i))),
                                    F.aggregate(r, none, lambda z, i: z.bitwiseXOR(check(i)))])
            made = F.when(size == 1, alone(first, place)).when(size == 2, pair).otherwise(
                let(F.transform(F.sequence(s, s + size - 1), lambda p: _index(F.get(w, p))), many))  # slices cost more
            return made if kept is None else F.when(kept(first), made)
        return let(starts.cast("array<int>"), lambda f: F.transform(f, lambda s, k: of(s, F.coalesce(F.get(f, k + 1), F.size(w)) - s)))
    return F.filter(let(F.sort_array(words), cells), lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0)).cast(CELLS)


def fold(cells: Column) -> Column:
    """Cells of one place made one; what comes to nothing is left out."""
    def of(c: Column) -> Column:
        return _summed(F.transform(c, lambda x, i: _word(x["at"].cast("long"), i)), lambda place: place, lambda i, _: F.get(c, i),
                       *[lambda i, field=field: F.get(c, i)[field] for field in ("n", "key", "check")])
    return let(cells, of)


def _thirds(exponent: Column, of: Callable[[Column, Column, Column], Column]) -> Column:
    """What ``of`` gives for each third's shift, mask of places and first place, one after the other."""
    width = F.call_function("shiftleft", F.lit(1), exponent)
    thirds = F.array(*[F.struct(F.lit(t * BITS).alias("shift"), (width - 1).cast("long").alias("mask"), (width * t).alias("start")) for t in range(3)])
    return F.flatten(F.transform(thirds, lambda t: of(t["shift"], t["mask"], t["start"])))


def _at(digest: Column, shift: Column, mask: Column) -> Column:
    return F.call_function("shiftright", digest, shift).bitwiseAND(mask)


def subtract(a: Column, b: Column | None, exponent: Column) -> Column:
    """The sketch of ``a`` less that of ``b``: the sums of both sides' entries by place."""
    def of(keys: Column) -> Column:
        def sign(i: Column) -> Column:
            return F.lit(1) if b is None else F.when(i < F.size(a), F.lit(1)).otherwise(F.lit(-1))

        def alone(i: Column, at: Column) -> Column:
            return F.struct(at.alias("at"), sign(i).alias("n"), F.get(keys, i).alias("key"), F.xxhash64(F.get(keys, i)).alias("check"))

        def third(shift: Column, mask: Column, start: Column) -> Column:
            return _summed(F.transform(keys, lambda d, i: _word(_at(d, shift, mask), i)), lambda place: place + start, alone,
                           sign, lambda i: F.get(keys, i), lambda i: F.xxhash64(F.get(keys, i)))
        return _thirds(exponent, third).cast(CELLS)
    return of(a) if b is None else let(F.concat(a, b), of)


def sketch(keys: Column, exponent: Column) -> Column:
    """The cells that hold something, by place, of three times 2**exponent."""
    return subtract(keys, None, exponent)


def own_sketch(keys: Column) -> Column:
    """struct(exponent, cells): the sketch that the fingerprint holds."""
    return F.struct(width(keys).alias("exponent"), sketch(keys, width(keys)).alias("cells")).cast(SKETCH)


def subtract_sketches(a: Column, b: Column, exponent: Column) -> Column:
    """The sketch of ``a`` less that of ``b``, both first folded to a width that neither falls below."""
    def narrowed(s: Column, sign: int) -> Column:
        def cell(c: Column) -> Column:
            third = F.call_function("shiftright", c["at"], s["exponent"])
            at = c["at"].bitwiseAND(F.call_function("shiftleft", F.lit(1), exponent) - 1) + F.call_function("shiftleft", third, exponent)
            return F.struct(at.alias("at"), (c["n"] * sign).alias("n"), c["key"].alias("key"), c["check"].alias("check"))
        return F.transform(s["cells"], cell).cast(CELLS)
    return fold(F.concat(narrowed(a, 1), narrowed(b, -1)))


def _without(cells: Column, of_a: Column, of_b: Column, exponent: Column) -> Column:
    """The cells with these digests of the first and the second taken out; a place without a cell holds nothing any more."""
    own = F.size(cells)

    def of(keys: Column) -> Column:  # indices: of the cells, then of the digests
        def either(cell: Callable[[Column], Column], digest: Callable[[Column], Column]) -> Callable[[Column], Column]:
            return lambda i: F.when(i < own, cell(F.get(cells, i))).otherwise(digest(i - own))
        gone = _thirds(exponent, lambda shift, mask, start: F.transform(keys, lambda d, i: _word(_at(d, shift, mask) + start, i + own)))
        return _summed(F.concat(F.transform(cells, lambda c, i: _word(c["at"].cast("long"), i)), gone), lambda place: place, lambda i, _: F.get(cells, i),
                       either(lambda c: c["n"], lambda i: F.when(i < F.size(of_a), F.lit(-1)).otherwise(F.lit(1))),
                       either(lambda c: c["key"], lambda i: F.get(keys, i)), either(lambda c: c["check"], lambda i: F.xxhash64(F.get(keys, i))),
                       lambda i: i < own)
    return let(F.concat(of_a, of_b), of)


def peel(cells: Column, exponent: Column) -> Column:
    """struct(cells, only_a, only_b, over): what is left, and how many digests of the first and the second were recovered."""
    def pure(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (F.xxhash64(c["key"]) == c["check"])

    def step(state: Column, _: Column) -> Column:
        def given(found: Column, sign: int) -> Column:  # as plain longs: of structs, the distinct ones are found by comparing all with all
            return F.array_distinct(F.transform(F.filter(found, lambda c: c["n"] == sign), lambda c: c["key"])).cast("array<bigint>")

        def after(rest: Column, of_a: Column, of_b: Column) -> Column:
            # a cell that gave away its only digest is empty; no later round finds anything where none is left
            left = F.when(F.size(rest) == 0, rest).otherwise(_without(rest, of_a, of_b, exponent)).cast(CELLS)
            return F.struct(left.alias("cells"), (state["only_a"] + F.size(of_a)).alias("only_a"),
                            (state["only_b"] + F.size(of_b)).alias("only_b"), (F.size(rest) == 0).alias("over")).cast(STATE)

        def told(found: Column) -> Column:
            # no later round finds what this one did not
            return F.when(F.size(found) == 0, F.struct(state["cells"].alias("cells"), state["only_a"].alias("only_a"), state["only_b"].alias("only_b"),
                                                       F.lit(True).alias("over")).cast(STATE)).otherwise(
                let(F.struct(F.filter(state["cells"], lambda c: ~pure(c)).cast(CELLS).alias("rest"), given(found, 1).alias("of_a"), given(found, -1).alias("of_b")),
                    lambda x: after(x["rest"], x["of_a"], x["of_b"])))
        return F.when(state["over"], state).otherwise(let(F.filter(state["cells"], pure).cast(CELLS), told)).cast(STATE)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("only_a"), F.lit(0).alias("only_b"), F.lit(False).alias("over"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start.cast(STATE), step).cast(STATE)


def width(keys: Column) -> Column:
    """Exponent of the fingerprint's width."""
    return F.least(power(F.size(keys) / 16), F.lit(BITS)).cast("int")


def difference(a: Column, b: Column, own_a: Column | None = None, own_b: Column | None = None) -> Column:
    """struct(only_a, only_b, exponent): numbers of digests that one side lacks, by ever larger sketches, and the width that gave them.

    ``own_a`` and ``own_b`` are the sketches of the two fingerprints, where they are at hand.
    """
    own_a, own_b = (own_sketch(keys) if own is None else own for keys, own in ((a, own_a), (b, own_b)))

    def attempt(exponent: Column, written: Column) -> Column:
        def told(s: Column) -> Column:
            def left(sign: int) -> Column:
                return F.ceil(F.aggregate(s["cells"], F.lit(0), lambda z, c: z + F.greatest(sign * c["n"], F.lit(0))) / 3)
            return F.when(F.size(s["cells"]) == 0, F.struct(s["only_a"].alias("only_a"), s["only_b"].alias("only_b"), exponent.alias("exponent"))).when(
                exponent == BITS, F.struct((s["only_a"] + left(1)).cast("int").alias("only_a"),
                                           (s["only_b"] + left(-1)).cast("int").alias("only_b"), exponent.alias("exponent")))
        cells = F.when(written, subtract_sketches(own_a, own_b, exponent)).otherwise(subtract(a, b, exponent)).cast(CELLS)
        return let(peel(cells, exponent), lambda s: told(s).cast(DIFFERENCE)).cast(DIFFERENCE)
    larger = F.sequence(F.least(power((F.size(a) + F.size(b)) * 2), F.lit(BITS)), F.lit(BITS))
    tries = F.concat(F.array(F.least(width(a), width(b))), larger).cast("array<int>")
    tries = F.transform(tries, lambda e, i: F.struct(e.alias("exponent"), (i == 0).alias("written"))).cast("array<struct<exponent:int,written:boolean>>")
    return F.aggregate(tries, F.lit(None).cast(DIFFERENCE),
                       lambda done, t: F.coalesce(done, attempt(t["exponent"], t["written"])).cast(DIFFERENCE)).cast(DIFFERENCE)


def fingerprint(keys: Column, own: Column | None = None) -> Column:
    """A sketch as text: exponent of its width, number of digests, then the cells with their places."""
    def written(s: Column) -> Column:
        cells = F.transform(s["cells"], lambda c: F.concat_ws(
            ":", c["at"].cast("string"), c["n"].cast("string"), F.hex(c["key"]), F.hex(c["check"].bitwiseAND(F.lit(0xFFFFFFFF)))))
        return F.concat(s["exponent"].cast("string"), F.lit("/"), F.size(keys).cast("string"), F.lit("/"), F.concat_ws(",", cells))
    return let(own_sketch(keys) if own is None else own, written)


def _likeness(a: str, b: str, own_a: str | None = None, own_b: str | None = None) -> Column:
    """The likeness of two arrays of digests (with the sketches of their fingerprints, where at hand)."""
    def share(d: Column) -> Column:
        total = F.size(a) + d["only_b"]
        return F.when(total == 0, F.lit(1.0)).otherwise((F.size(a) - d["only_a"]) / total)
    return let(difference(F.col(a), F.col(b), *[None if own is None else F.col(own) for own in (own_a, own_b)]), share).cast("double")


def with_next(docs: DataFrame, columns: list[str], bucket_bytes: int = 16 << 20, made: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Each row with the ``columns`` of the next one in descending doc_id as ``next`` (after the last: the first).

    ``made`` are further columns made of the text (then one of ``columns``), once for a row and for its being the next
    one; they are made after the shuffle. Ranges of doc_id are cut at 64 quantiles, and evenly within those; within a range the next
    row is in the same window, at its end it is the head of the next range that has rows.
    """
    made = made or {}
    _, size = text_bytes(docs)
    parts = max(1, -(-size // bucket_bytes))
    marks = docs.select(F.percentile_approx(F.col("doc_id").cast("double"), [i / 64 for i in range(65)], 2000)).first()[0] or []
    marks = sorted(set(marks))
    inner = -(-parts // max(1, len(marks) - 1)) if parts > 1 else 1
    key = F.col("doc_id").cast("double")
    if parts > 1 and len(marks) > 1:
        edges = F.array(*[F.lit(m) for m in marks[:-1]])
        seg = F.greatest(F.size(F.filter(edges, lambda m: m <= key)), F.lit(1))
        low = F.element_at(F.array(*[F.lit(m) for m in marks]), seg)
        high = F.element_at(F.array(*[F.lit(m) for m in marks]), seg + 1)
        within = F.floor((key - low) / (high - low) * inner)
        bucket = seg * inner + F.least(F.greatest(within, F.lit(0)), F.lit(inner - 1))
    else:
        bucket = F.lit(0)
    rows = docs.withColumn("_b", F.coalesce(bucket.cast("long"), F.lit(-1)))
    pack = F.struct(*columns)
    head = (rows.groupBy("_b").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "text", pack.alias("p"))).alias("h"))
            .select(F.col("_b").alias("hb"), F.col("h.p").alias("_head")))
    turn = Window.partitionBy(F.lit(0)).orderBy(F.desc("_b"))  # one row per range
    follow = (rows.select("_b").distinct().withColumn("nb", F.lead("_b").over(turn))
              .withColumn("nb", F.coalesce("nb", F.max("_b").over(Window.partitionBy(F.lit(0))))).withColumnRenamed("_b", "fb"))
    heads = follow.join(head, F.col("nb") == F.col("hb")).select("fb", "_head")
    order = Window.partitionBy("_b").orderBy(F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    rows = rows.repartition("_b").select("*", *[of(F.col("text")).alias(name) for name, of in made.items()])
    rows = rows.withColumn("_next", F.lead(F.struct(*columns, *made)).over(order))
    first = F.struct(*[F.col(f"_head.{c}").alias(c) for c in columns], *[of(F.col("_head.text")).alias(name) for name, of in made.items()])
    return (rows.join(heads, F.col("_b") == F.col("fb"), "left")
            .withColumn("next", F.coalesce("_next", first)).drop("_b", "fb", "_next", "_head"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    def pieces(text: Column) -> Column:
        return let(digests(text), lambda d: F.struct(d.alias("d"), own_sketch(d).alias("s")))

    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"], made={"own": pieces})
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = (rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut)))
            .select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    F.col("own.d").alias("d"), F.col("own.s").alias("ds"), F.col("next.own").alias("next"), pieces(F.col("edited")).alias("edited")))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "d", "ds", F.col("next.d").alias("nd"), F.col("next.s").alias("nds"),
                       F.col("edited.d").alias("ed"), F.col("edited.s").alias("eds"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("d"), F.col("ds")).alias("fingerprint"),
                       fingerprint(F.col("ed"), F.col("eds")).alias("edited_fingerprint"), _likeness("d", "ed", "ds", "eds").alias("near_edited"),
                       _likeness("d", "nd", "ds", "nds").alias("near_next"))
