"""Operator 9: line dedup, by a deletion-neighbourhood join (DataFrame and SQL functions alone).

The unit is a whole line of at least `min_words` words, however long; only if `max_words` is given, a longer line is cut to
units of that many. Words are what single spaces separate. The edit bound is one word: set, dropped or replaced; and the two must be
0.8 alike or more, the word being a fifth of the shorter one's at most, which is to say that both have `min_words` words.
A unit goes if an earlier one (by doc_id, then place in the text) is equal or within the bound. With `short_lines`, as the
query and the pipeline have it, that one rule holds for lines of any length: of 1 to 4 words a word is a quarter or more, so they go if an earlier one is equal; without it they always stay. Removal of a line's every unit removes the line; a document may end up empty, but stays a row.

1. Equal units meet by two 64-bit hashes; the earliest stands for all. Four keys ride along: the hashes of
   the unit's first and second half, and of the halves it would have with one word less.
2. Units within one edit share one of those half keys (the edit falls into one half only), so units that share none
   are done; for most text that is nearly all. Sieves of a fixed size keep what can't match out of the shuffles.
3. The rest emit their deletion neighbourhood: the hash of the unit and of each variant with a word
   left out, with the place. Units that share a variant and the place differ in that word; one that equals a
   variant of another has a word less. Groups are reduced to their earliest unit, never paired up. Variants of
   `TEXT_WORDS` words or more leave out only words of segments that may hold the edit, and are hashed by running sums, so a unit's work stays in proportion to its length.
4. Each unit and the earliest one it met are verified by their words: common start and common end must
   cover all but one.

Rows that share doc_id and text are one document and get one result; rows that share doc_id but not text count as
different documents, ordered by the text's hash. Null text is empty; null ids come first. Empty lines always stay. An empty table gives no rows;
other columns, whatever their names, ride along untouched in `rewrite` and aren't read in `dedup_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import id_and_text, stored, table

#: The lines of a text in order: (line, body, n): which line, the words, how many.
_LINES = "transform(split(text, '\\n', -1), (x, i) -> struct(i as line, x as body, length(x) - length(replace(x, ' ', '')) + 1 as n))"
#: The same, cut to units of at most {w} words. Only lines of more than {w} words are split to words.
_UNITS = (
    "flatten(transform(" + _LINES + ", "
    "u -> if(u.n <= {w}, array(u), transform(sequence(0, (u.n - 1) div {w}), "
    "p -> struct(u.line as line, array_join(slice(split(u.body, ' ', -1), p * {w} + 1, {w}), ' ') as body, least({w}, u.n - p * {w}) as n)))))"
)

#: Variants of fewer words are hashed as text, which is quicker for them; longer ones by running sums.
TEXT_WORDS = 256

#: Segments of a unit of TEXT_WORDS words or more, and its keys: size is the number of words that the segments are cut from, its own or one more.
SEGMENTS = 16

#: Bits of a sieve: 2,048 rows of 4 KB, so its broadcast is 8 MB whatever the input; when it fills up it lets more through, and the join after it decides.
SIEVE_BITS = 1 << 26


def _keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("doc_key", F.xxhash64("text"))


def _cut(max_words: int | None) -> Column:
    return F.expr(_LINES if max_words is None else _UNITS.format(w=max_words))


def _able(min_words: int, short_lines: bool, of: str = "") -> str:
    """Whether a unit can go."""
    return f"({of}n >= {min_words}" + (f" or {of}body <> '')" if short_lines else ")")


def _units(docs: DataFrame, min_words: int, max_words: int | None, short_lines: bool = False) -> DataFrame:
    """(doc_id, doc_key, k, body, n): the removable units, with their number of words."""
    all_units = docs.select("doc_id", "doc_key", F.posexplode(_cut(max_words)).alias("k", "u"))
    return all_units.select("doc_id", "doc_key", "k", "u.body", "u.n").filter(_able(min_words, short_lines))


def _half_keys() -> Column:
    start = "xxhash64(0, {n}, substring_index(body, ' ', {n} div 2))"
    end = "xxhash64(1, {n}, substring_index(body, ' ', {n} div 2 - {n}))"
    return F.expr("array(" + ", ".join(x.format(n=size) for size in ("n", "(n - 1)") for x in (start, end)) + ")")


def earliest_units(units: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2, first, keys): each different unit, its earliest place, its half keys (null below min_words, where equality alone counts)."""
    hashed = units.select(F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "n", "body").alias("h2"), F.struct("doc_id", "doc_key", "k").alias("place"), F.when(F.col("n") >= min_words, _half_keys()).alias("keys"))
    return hashed.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.first("keys").alias("keys"))


def _sieved(rows: DataFrame, kept: DataFrame, key: Column, kept_key: Column) -> DataFrame:
    """The rows whose key may be one of kept's: none of those is lost, nearly all others are, before any shuffle of rows."""
    at = lambda k: F.pmod(F.xxhash64(k, F.lit(3)), F.lit(SIEVE_BITS))
    bits = kept.select(at(kept_key).alias("at")).groupBy(F.expr("at div 32768").alias("_part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("_bits"))
    rows = rows.withColumn("_at", at(key)).withColumn("_part", F.expr("_at div 32768")).withColumn("_at", (F.col("_at") % 32768).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, _at % 8) & 1") == 1
    return rows.join(F.broadcast(bits), "_part").withColumn("_byte", byte).filter(is_set).drop("_part", "_at", "_bits", "_byte")


def candidates(distinct: DataFrame) -> DataFrame:
    """(doc_id, doc_key, k) of the different units that share a half key with another."""
    keys = distinct.select("first", F.explode(F.array_distinct("keys")).alias("key"))
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "lines-shared")
    return _sieved(keys, shared, F.col("key"), F.col("key")).join(shared, "key").select("first.doc_id", "first.doc_key", "first.k").distinct()


def _text_variants(words: DataFrame) -> DataFrame:
    """(place, q, m, v): the hash v of the m words that are left without the q-th (0: of all), for each m below TEXT_WORDS."""
    rows = words.filter(F.col("n") <= TEXT_WORDS).select("place", "body", "n", F.explode(F.sequence(F.when(F.col("n") < TEXT_WORDS, 0).otherwise(1), F.col("n"))).alias("q"))
    without = F.expr("case when q = 1 then substring_index(body, ' ', 1 - n) when q = n then substring_index(body, ' ', n - 1) else concat(substring_index(body, ' ', q - 1), ' ', substring_index(body, ' ', q - n)) end")
    size, text = F.when(F.col("q") == 0, F.col("n")).otherwise(F.col("n") - 1), F.when(F.col("q") == 0, F.col("body")).otherwise(without)
    return rows.select("place", "q", size.alias("m"), F.xxhash64(text).alias("v"))


def _segment_keys() -> Column:
    outside = "substring_index(body, ' ', cast(s * k div {K} as int)), substring_index(body, ' ', cast(s * (k + 1) div {K} - s as int))".format(K=SEGMENTS)
    keys = f"transform(sequence(0, {SEGMENTS - 1}), k -> struct(s as size, k as k, xxhash64(s, k, {outside}) as key))"
    return F.expr(f"flatten(transform(filter(array(n, n + 1), s -> s > {TEXT_WORDS}), s -> {keys}))")


def _long_variants(words: DataFrame) -> DataFrame:
    """The same for each m from TEXT_WORDS on, but only for segments in which another unit may differ.

    A unit has a key for each of its SEGMENTS segments, of all words outside it; once as it is and once as if that segment had a word more. Two units one
    word apart share the key of the segment with the edit, so only the words of such segments are left out in turn.
    A hash is the xor of hashes of (place, word): before q the words keep their places, after it they move by one.
    """
    long = words.filter(F.col("n") >= TEXT_WORDS)
    keyed = stored(long.select("place", "n", F.explode(_segment_keys()).alias("s")).select("place", "n", "s.size", "s.k", "s.key"), "lines-segments")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("units")).filter("units > 1").select(F.col("key").alias("shared"))
    met = keyed.join(shared, F.col("key") == F.col("shared")).groupBy("place").agg(F.collect_set(F.when(F.col("size") == F.col("n"), F.col("k"))).alias("ks"), F.max(F.col("size") > F.col("n")).alias("whole"))
    w = F.split("body", " ", -1)
    hashes = [F.transform(w, lambda x, i: F.xxhash64(i + 1, x)).alias("stays"), F.transform(w, lambda x, i: F.xxhash64(i, x)).alias("moves")]
    rows = stored(long.join(met.withColumnRenamed("place", "met"), F.col("place") == F.col("met")).select("place", "n", "ks", "whole", *hashes), "lines-hashed")

    all_of = lambda a: f"aggregate({a}, 0L, (s, x) -> s ^ x)"
    whole = rows.filter("whole").select("place", F.lit(0).alias("q"), F.col("n").alias("m"), F.expr(all_of("stays")).alias("v"))
    parts = rows.select("place", "n", "stays", "moves", F.explode("ks").alias("k")).withColumn("a", F.expr(f"n * k div {SEGMENTS}").cast("int")).withColumn("b", F.expr(f"n * (k + 1) div {SEGMENTS}").cast("int"))
    outside = F.expr(f"{all_of('slice(stays, 1, a)')} ^ {all_of('slice(moves, b + 1, n)')}")
    inside = F.expr("posexplode(arrays_zip(slice(stays, a + 1, b - a), slice(moves, a + 1, b - a)))").alias("i", "h")
    parts = parts.select("place", "n", "k", "a", outside.alias("outside"), inside).select("place", "n", "k", "outside", (F.col("a") + F.col("i") + 1).alias("q"), F.col("h.0").alias("stays"), F.col("h.1").alias("moves"))
    part = Window.partitionBy("place", "k").orderBy("q")
    before, after = F.bit_xor("stays").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.bit_xor("moves").over(Window.partitionBy("place", "k").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, -1))
    v = F.expr("outside ^ coalesce(before, 0L) ^ coalesce(after, 0L)")
    without = parts.withColumn("before", before).withColumn("after", after).select("place", "q", (F.col("n") - 1).alias("m"), v.alias("v"))
    return without.unionByName(whole)


def near_units(words: DataFrame) -> DataFrame:
    """(place) of the units of words (place, body, n; all different) that have an earlier one within one word."""
    variants = stored(_text_variants(words).unionByName(_long_variants(words)), "lines-variants")
    shared = stored(variants.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v"), "lines-shared-variants")
    variants = stored(_sieved(variants, shared, F.col("v"), F.col("v")), "lines-met")

    by_place = variants.groupBy("v", "m", "q").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n"))
    by_variant = by_place.groupBy("v", "m").agg(
        F.min("least").alias("any"), F.min(F.when(F.col("q") == 0, F.col("least"))).alias("whole"), F.sum("n").alias("n"))
    by_place = by_place.filter("n > 1 and q > 0").select(F.col("v").alias("v1"), F.col("m").alias("m1"), F.col("q").alias("q1"), "least")
    by_variant = by_variant.filter("n > 1").select(F.col("v").alias("v2"), F.col("m").alias("m2"), "any", "whole")

    met = variants.join(by_variant, (F.col("v") == F.col("v2")) & (F.col("m") == F.col("m2")))
    met = met.join(by_place, (F.col("v") == F.col("v1")) & (F.col("m") == F.col("m1")) & (F.col("q") == F.col("q1")), "left")
    earlier = F.explode(F.when(F.col("q") == 0, F.array("any")).otherwise(F.array("least", "whole")))
    pairs = met.select("place", earlier.alias("other")).filter("other < place").distinct()

    w = F.split("body", " ", -1)
    a, b = words.select("place", w.alias("wa")), words.select(F.col("place").alias("other"), w.alias("wb"))
    return pairs.join(a, "place").join(b, "other").filter(within_one_word("wa", "wb")).select("place").distinct()


def within_one_word(a: str, b: str) -> Column:
    """Whether two different arrays of words are one word apart: set, dropped or replaced."""
    n = f"least(size({a}), size({b}))"
    same = "array_position(transform(sequence(1, {n}), i -> element_at({a}, {s}i) <=> element_at({b}, {s}i)), false)"
    start, end = (f"if({p} = 0, {n}, {p} - 1)" for p in (same.format(n=n, a=a, b=b, s=s) for s in ("", "-")))
    return F.expr(f"abs(size({a}) - size({b})) <= 1 and ({start}) + ({end}) >= greatest(size({a}), size({b})) - 1")


def dedup_lines(docs: DataFrame, min_words: int = 5, max_words: int | None = None, short_lines: bool = False) -> DataFrame:
    """(doc_id, doc_key, text, new_text, n_units, n_exact, n_near) of each row: its text without the units that go, and how many went as equal to or near an earlier one."""
    left = _left(docs, _keyed(docs), min_words, max_words, short_lines)
    return left.select("doc_id", "doc_key", "text", "new_text", "n_units", "n_exact", "n_near")


def rewrite(docs: DataFrame, min_words: int = 5, max_words: int | None = None, short_lines: bool = False) -> DataFrame:
    """The rows of docs with their columns, text without the units that go, n_chars (if there) as its new length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    whole = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("doc_key", F.xxhash64("text"))
    left = _left(docs, whole, min_words, max_words, short_lines)
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return left.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def _left(docs: DataFrame, rows: DataFrame, min_words: int, max_words: int | None, short_lines: bool) -> DataFrame:
    """rows (with doc_id, doc_key and text of docs) with new_text and counts."""
    keyed = _keyed(docs)
    distinct = stored(earliest_units(_units(keyed, min_words, max_words, short_lines), min_words), "lines-distinct")
    near = stored(candidates(distinct), "lines-candidates")
    place = [F.col(c) for c in ("doc_id", "doc_key", "k")]
    found = _sieved(_units(keyed, min_words, max_words), near, F.xxhash64(*place), F.xxhash64(*place))
    c = near.select(F.col("doc_id").alias("c_id"), F.col("doc_key").alias("c_key"), F.col("k").alias("c_k"))
    found = found.join(c, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("doc_key") == F.col("c_key")) & (F.col("k") == F.col("c_k")))
    # places repeat where rows do: one row of each is enough
    words = found.groupBy(F.struct(*place).alias("place")).agg(F.first("body").alias("body"), F.first("n").alias("n"))
    gone = stored(near_units(stored(words, "lines-words")), "lines-near")

    by_doc = lambda rows, ks: rows.groupBy(F.col("place.doc_id").alias(f"{ks}_id"), F.col("place.doc_key").alias(f"{ks}_key")).agg(F.collect_list("place.k").alias(ks))
    joined = rows
    for marks, ks in ((distinct.select(F.col("first").alias("place")), "first_ks"), (gone, "near_ks")):
        joined = joined.join(by_doc(marks, ks), F.col("doc_id").eqNullSafe(F.col(f"{ks}_id")) & (F.col("doc_key") == F.col(f"{ks}_key")), "left")
    none = F.expr("cast(array() as array<int>)")
    joined = joined.withColumn("near_ks", F.coalesce("near_ks", none)).withColumn("kept", F.array_except(F.coalesce("first_ks", none), "near_ks"))

    units = joined.withColumn("units", _cut(max_words))
    can_go = f"filter(transform(units, (u, i) -> if({_able(min_words, short_lines, 'u.')}, i, null)), i -> i is not null)"
    units = units.withColumn("able", F.expr(can_go)).withColumn("gone", F.expr("array_except(able, kept)"))
    left = units.withColumn("left", F.expr("transform(array_except(sequence(0, size(units) - 1), gone), i -> units[i])"))
    whole = F.expr("array_join(transform(left, (u, i) -> concat(if(i = 0, '', if(u.line = left[i - 1].line, ' ', '\\n')), u.body)), '')")
    n_near = F.size("near_ks").cast("long")
    return left.select(*rows.columns, whole.alias("new_text"), F.size("able").cast("long").alias("n_units"), (F.size("gone") - n_near).alias("n_exact"), n_near.alias("n_near"))


def op9_line_dedup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents"), short_lines=True)
    return found.select("doc_id", "n_units", "n_exact", "n_near", F.length("new_text").cast("long").alias("n_chars"), F.sha2("new_text", 256).alias("text_sha256"))
