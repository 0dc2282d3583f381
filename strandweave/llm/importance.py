"""Operator 13: resampling by importance towards a target distribution, over an integer dictionary of words.

Texts are cut into words a block at a time (some MB of text); a block numbers its own words, so a word meets the corpus's
dictionary once a block and not once a use. The dictionary gives each distinct word an id, runs of words are tuples of ids, each distinct
tuple's bytes are put together and hashed once, and what its bucket gains is joined back to the blocks that hold it, where each
document adds up its features. Buckets are as many as the parameter says, whatever the corpus, so only their gains are broadcast.

Scores get a Gumbel term from the id's hash, so that the highest ones are a draw without replacement in proportion to the weights. Ranks come from a sort in
ranges and the counts of the ranges before; no task orders everything.

Null text has no words; null ids hash as empty text and come first among ties; repeated rows count, score and draw each; an empty
table gives no rows, an empty target leaves all counts of it at 0. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import id_and_text, in_slices, stored, table

#: Bytes of text in a block: its words are numbered together, by a task that holds them and their counts, not the texts.
BLOCK_BYTES, SLICE_BYTES = 32 << 20, 1 << 20
#: Letters A-Z in lower case, digits, a-z and all that isn't ASCII as they are, the rest to spaces. UTF-8 has bytes of 128 and more outside ASCII alone.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CUT = pa.schema([("target", pa.bool_()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("uses", pa.binary()), ("k", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
_CUT_SQL = "target boolean, block long, doc_id long, n_words long, uses binary, k long, word string, n long"


def pressed(numbers: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(numbers, "<i4").tobytes(), 1)


def opened(uses: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(uses), "<i4")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLDED).split()


def cut(texts: DataFrame) -> DataFrame:
    """(target, block, ...) of (doc_id, text, target): a row a document with its words as the block's numbers, and a row a word of the block with its number k and its uses n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, side = TaskContext.get().partitionId() << 32, 0, None
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        n = np.zeros(1 << 16, np.int64)

        def words() -> pa.RecordBatch:
            w = len(numbers)
            cols = [pa.array([side] * w, pa.bool_()), pa.array(np.full(w, block)), pa.nulls(w, pa.int64()), pa.nulls(w, pa.int64()), pa.nulls(w, pa.binary()), pa.array(np.arange(w)), pa.array([x.decode() for x in numbers], pa.string()), pa.array(n[:w])]
            return pa.RecordBatch.from_arrays(cols, schema=_CUT)

        for batch in in_slices(batches, "text", SLICE_BYTES):
            texts, m, side = batch.column("text").to_pylist(), batch.num_rows, batch.column("target")[0].as_py()  # a partition is of one side alone
            uses = [np.fromiter(map(numbers.__getitem__, words_of(t)), np.int32) for t in texts]
            if len(numbers) > len(n):
                n = np.concatenate([n, np.zeros(max(len(n), len(numbers) - len(n)), np.int64)])
            met, times = np.unique(np.concatenate(uses), return_counts=True)
            n[met] += times
            cols = [batch.column("target"), pa.array(np.full(m, block)), batch.column("doc_id"), pa.array([len(x) for x in uses], pa.int64()), pa.array([pressed(x) for x in uses], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(m, _CUT.field(i).type) for i in (5, 6, 7))], schema=_CUT)
            held += sum(map(len, texts))
            if held >= BLOCK_BYTES:
                yield words()
                block, held = block + 1, 0
                numbers.clear()
                n[:] = 0
        if numbers:
            yield words()

    return texts.mapInArrow(run, _CUT_SQL)


def dictionary(cut_rows: DataFrame) -> DataFrame:
    """(id, word, s, t) of each distinct word: its uses in the corpus and in the target."""
    words = cut_rows.filter("word is not null").groupBy("word").agg(*_uses())
    return stored(words.withColumn("id", F.monotonically_increasing_id()), "importance-dictionary")


def _uses() -> list[Column]:
    return [F.sum(F.when(F.col("target") == side, F.col("n")).otherwise(0)).alias(name) for side, name in ((False, "s"), (True, "t"))]


def runs_of(cut_rows: DataFrame, ids: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(features, documents): the distinct runs of 1 to `longest` words of each block as tuples of ids, (target, block, k, ids, n), and the documents, (target, block, doc_id, n_words, uses of k)."""
    documents = cut_rows.filter("word is null").select("target", "block", "doc_id", "n_words", "uses")
    words = cut_rows.filter("word is not null").select("block", "k", "word").join(ids.select("word", "id"), "word")
    schema = pa.schema([("target", pa.bool_()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("uses", pa.binary()), ("k", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.int64())])

    def runs(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        id_of = np.empty(known.num_rows, np.int64)
        id_of[known.column("k").to_numpy()] = known.column("id").to_numpy()
        spelt, m = [], docs.num_rows
        for x in docs.column("uses").to_pylist():
            own = id_of[opened(x)]
            rows = np.full((sum(max(0, len(own) - j) for j in range(longest)), longest), -1)
            at = 0
            for j in range(min(longest, len(own))):  # runs of j + 1 words
                rows[at : at + len(own) - j, : j + 1] = np.lib.stride_tricks.sliding_window_view(own, j + 1)
                at += len(own) - j
            spelt.append(rows)
        distinct, place = np.unique(np.concatenate(spelt), axis=0, return_inverse=True)
        place = place.ravel()
        ends = np.cumsum([len(x) for x in spelt])
        uses = [pressed(place[e - len(x) : e]) for x, e in zip(spelt, ends)]
        n = np.bincount(place, minlength=len(distinct)).astype(np.int64)
        side, block = docs.column("target")[0].as_py(), docs.column("block")[0].as_py()
        first = [docs.column("target"), docs.column("block"), docs.column("doc_id"), docs.column("n_words"), pa.array(uses, pa.binary()), *(pa.nulls(m, schema.field(i).type) for i in (5, 6, 7))]
        w = len(distinct)
        second = [pa.array([side] * w, pa.bool_()), pa.array([block] * w, pa.int64()), *(pa.nulls(w, schema.field(i).type) for i in (2, 3, 4)), pa.array(np.arange(w)), pa.array([r[r >= 0].tolist() for r in distinct], pa.list_(pa.int64())), pa.array(n)]
        return pa.concat_tables([pa.Table.from_arrays(first, schema=schema), pa.Table.from_arrays(second, schema=schema)])

    both = documents.groupBy("block").cogroup(words.select(F.col("block").alias("in_block"), "k", "id").groupBy("in_block")).applyInArrow(runs, "target boolean, block long, doc_id long, n_words long, uses binary, k long, ids array<long>, n long")
    both = stored(both, "importance-runs")
    return both.filter("k is not null").select("target", "block", "k", "ids", "n"), both.filter("k is null").select("target", "block", "doc_id", "n_words", "uses")


def hashed(features: DataFrame, ids: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(ids, bucket, s, t) of each distinct tuple: its bytes put together and hashed once, its uses in the corpus and in the target."""
    tuples = features.groupBy("ids").agg(*_uses())
    for j in range(longest):
        spelt = ids.select(F.col("id").alias(f"id{j}"), F.col("word").alias(f"word{j}"))
        tuples = tuples.withColumn(f"id{j}", F.get("ids", F.lit(j))).join(spelt, f"id{j}", "left")
    return tuples.select("ids", _bucket(F.concat_ws(" ", *(f"word{j}" for j in range(longest))), buckets), "s", "t")


def _bucket(text: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).cast("int").alias("bucket")


def gains(tuples: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of each bucket in use."""
    by_bucket = tuples.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    held, wanted = by_bucket.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    gain = F.floor(1000 * F.log((t + 1) * F.lit(float(held + buckets)) / ((s + 1) * F.lit(float(wanted + buckets)))))
    return by_bucket.select("bucket", gain.cast("long").alias("gain"))


def weighed(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document; target has texts alone."""
    sides = id_and_text(docs).withColumn("target", F.lit(False)).unionByName(target.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("target")))
    cut_rows = stored(cut(sides), "importance-words")
    ids = dictionary(cut_rows)
    if longest == 1:  # a tuple of one id is its dictionary's row: the counts and the bytes are there
        tuples = stored(ids.select("id", "word", _bucket(F.col("word"), buckets), "s", "t"), "importance-tuples")
        features, documents, key = cut_rows.filter("word is not null").select("target", "block", "k", "word"), cut_rows.filter("word is null"), "word"
    else:
        features, documents = runs_of(cut_rows, ids, longest)
        tuples, key = stored(hashed(features, ids, longest, buckets), "importance-tuples"), "ids"
    # a row a bucket: bounded by the parameter
    by_tuple = tuples.join(F.broadcast(gains(tuples, buckets)), "bucket").select(key, "gain")
    back = features.filter("not target").join(by_tuple, key).select(F.col("block").alias("in_block"), F.col("k").cast("int").alias("k"), F.col("gain").cast("int").alias("gain"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def add(own: pa.Table, known: pa.Table) -> pa.Table:
        gain = np.zeros(known.num_rows + 1, np.int64)
        gain[known.column("k").to_numpy()] = known.column("gain").to_numpy()
        uses = [opened(x) for x in own.column("uses").to_pylist()]
        return pa.Table.from_arrays([own.column("doc_id"), own.column("n_words"), pa.array([len(x) for x in uses], pa.int64()), pa.array([int(gain[x].sum()) for x in uses], pa.int64())], schema=schema)

    own = documents.filter("not target").select("block", "doc_id", "n_words", "uses")
    return own.groupBy("block").cogroup(back.groupBy("in_block")).applyInArrow(add, "doc_id long, n_words long, n_features long, weight long")


def luck(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number) of the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document; rank from 1 for the floor(percent/100) of the documents of least_words or more that are drawn, else null."""
    scored = weighed(docs, target, longest, buckets)
    scored = stored(scored.select("doc_id", "n_features", "weight", (F.col("weight") + luck(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("able")), "importance-scores")
    able = scored.filter("able").count()
    order = [F.desc("able"), F.desc("score"), F.asc("doc_id")]
    placed = stored(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "importance-order")
    # the upper bits of `at` name the range, the lower 33 the row in it; a row a range
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("start"))
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.col("able") & (rank <= F.lit(able * percent // 100))
    return placed.join(F.broadcast(starts), part == F.col("p")).select("doc_id", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))


def op13_importance_resampling(spark, sf_dir):
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A-Z in lower case, words, crc32 by bytes with a table of 256 made by its eight shifts, gains in doubles.
OP13_SQL = r"""
WITH crc AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(b))),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
goal AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
uses AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM docs) GROUP BY r, word),
counted AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, n AS s, 0 AS t FROM uses UNION ALL SELECT word, 0, 1 FROM goal) GROUP BY word),
bytes AS (SELECT word, s, t, hex(encode(word)) AS hx FROM counted),
hashed AS (SELECT word, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, crc),
buckets AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM buckets),
gain AS (SELECT bucket, floor(1000 * ln((b.t + 1) * (a.s + 10000) / ((b.s + 1) * (a.t + 10000))))::BIGINT AS gain FROM buckets b, totals a),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM uses JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, sum((n_features >= 20)::INT) OVER () AS able FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM placed
"""
