"""Operator 3: toxicity, by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, accents off, look-alike letters and digits that stand for letters to Latin letters,
zero-width characters out, all else to spaces. The lexicon holds words and beginnings of words, each with its log
odds between toxic and clean labelled documents, learned from a bounded sample (`per_class` documents of each
class by smallest hash of the id; equal texts count once). Every term is an entry whose odds are `least_odds` or more and that
`least_share` of the sampled toxic documents have (three at least); so their number is bounded by the sample, and none is left out. Where an entry also occurs in
clean documents, its neighbouring words there that `least_clean` clean documents and no toxic one have make exception phrases, all of them: a match that lies in one doesn't count. A
text's hits, one a word at most, are summed and set against its length; a logistic regression on the sample calibrates both to a score.

Ids labelled both ways give no sample; of equal texts with both labels the toxic one counts. Without labelled rows of both classes every score is 0. Null and empty
texts have no hits; null ids are scored like any, but not learned from. Repeated rows give repeated results, an empty table none; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import bounded_sample, id_and_text, in_slices, table
from strandweave.llm.logistic import Logistic, class_weights
from strandweave.llm.quality import Scorer, labelled, predictions

#: Look-alikes of Latin letters in other scripts, and what stands for letters in obfuscated words.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Lengths of the beginnings of words that may be terms.
BEGINNINGS = range(4, 7)


@functools.cache
def _fold_of(c: str) -> str:
    low = c.lower()
    if low in LOOK_ALIKES:
        return LOOK_ALIKES[low]
    if c in DIGITS:
        return DIGITS[c]
    if unicodedata.category(c) in ("Cf", "Mn"):
        return ""
    plain = "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFKD", low) if unicodedata.category(x) != "Mn")
    return plain if plain.isalnum() else " "


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = _fold_of(chr(code))
        return out


_FOLDS = _Folds()


def folded(text: str) -> str:
    """The text's words as plain letters, a space before and after each."""
    return f" {text.translate(_FOLDS)} "


def terms(text: str) -> set[str]:
    """Words (a space at either end) and beginnings of words (a space before) of a folded text."""
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


class Lexicon:
    """Weights of terms and exception phrases, and the automaton made of them where it is first used."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.weights, self.exceptions, self._automaton = weights, exceptions, None

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state):
        self.weights, self.exceptions = state
        self._automaton = None

    def hits(self, text: str) -> float:
        """Sum over words of the largest weight of a term that starts there, outside exception phrases; text is folded."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for t, w in self.weights.items():
                self._automaton.add_word(t, (len(t), w, False))
            for t in self.exceptions:
                self._automaton.add_word(t, (len(t), 0.0, True))
            self._automaton.make_automaton()
        if not self.weights:
            return 0.0
        best: dict[int, float] = {}
        spans: list[tuple[int, int]] = []
        for end, (n, w, exception) in self._automaton.iter(text):
            start = end - n + 1
            if exception:
                spans.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        for a, b in spans:
            for k in [k for k in best if a <= k < b]:
                del best[k]
        return sum(best.values())

    def features(self, text: str) -> list[float]:
        f = folded(text)
        hits = self.hits(f)
        return [math.log1p(hits), math.log1p(100 * hits / (1 + f.count(" ")))]


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, per_class: int = 3000, least_odds: float = math.log(20), least_share: float = 0.01) -> Scorer:
    """A scorer fitted on labelled rows outside the fold held_out."""
    rows = labelled(labels, "toxic", modulus, held_out)
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return _clean
    # two numbers for each of at most 2 * per_class documents
    sample = id_and_text(docs).join(F.broadcast(bounded_sample(rows, "label", per_class)), "doc_id")
    sample = sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).persist()
    try:
        sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
        if len(sizes) < 2:
            return _clean
        pos, neg = F.sum(F.col("n") * F.col("label")), F.sum(F.col("n") * (1 - F.col("label")))
        counted = sample.mapInArrow(_count(terms), "label long, term string, n long").groupBy("term").agg(pos.alias("pos"), neg.alias("neg"))
        odds = F.log((F.col("pos") + 0.5) / (sizes[1] + 1)) - F.log((F.col("neg") + 0.5) / (sizes[0] + 1))
        counted = counted.filter(F.col("pos") >= max(3, least_share * sizes[1])).withColumn("odds", odds).filter(F.col("odds") >= least_odds)
        found = counted.orderBy("term").collect()
        weights = {r.term: r.odds for r in found}
        lexicon = Lexicon(weights, _exceptions(sample, {r.term for r in found if r.neg}))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches, "text"):
                x = [lexicon.features(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

        found = sample.mapInArrow(measure, "doc_id long, label int, x array<double>").orderBy("doc_id").collect()
    finally:
        sample.unpersist()
    x, y = np.array([r.x for r in found]), np.array([r.label for r in found], float)
    model = Logistic(x, y, class_weights(y, counts))

    def score(texts: list[str]) -> np.ndarray:
        return model(np.array([lexicon.features(t) for t in texts]))

    return score


def _clean(texts: list[str]) -> np.ndarray:
    return np.zeros(len(texts))


def _count(of):
    """Documents with each term, by label, counted within the task first; the sample is bounded, and so is this."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in in_slices(batches, "text"):
            for label, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                seen[label].update(of(folded(t)))
        rows = [(k, t, n) for k, c in seen.items() for t, n in c.items()]
        for i in range(0, len(rows), 20_000):
            label, term, n = zip(*rows[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(term, pa.string()), pa.array(n, pa.int64())], names=["label", "term", "n"])

    return run


def _exceptions(sample: DataFrame, ambiguous: set[str], least_clean: int = 2) -> list[str]:
    """Two-word phrases with an ambiguous term that at least `least_clean` clean documents have and no toxic one."""
    if not ambiguous:
        return []

    def phrases(text: str) -> set[str]:
        words = text.split()
        hit = [bool(terms(w) & ambiguous) for w in words]
        return {f" {a} {b} " for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y}

    pos, neg = F.sum(F.col("n") * F.col("label")), F.sum(F.col("n") * (1 - F.col("label")))
    counted = sample.mapInArrow(_count(phrases), "label long, term string, n long").groupBy("term").agg(pos.alias("pos"), neg.alias("neg"))
    return [r.term for r in counted.filter((F.col("neg") >= least_clean) & (F.col("pos") == 0)).orderBy("term").collect()]


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predictions(docs, fit(docs, table(spark, sf_dir, "labels")), 5, 0)
