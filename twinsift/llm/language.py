"""Language identification: words first, then shorter and shorter character n-grams.

A text's words (runs of letters, lower case) are scored by their log frequency in each language. A word that no language knows
backs off to its longest known character n-grams (the word marked with its ends): at each length from ``longest`` down to 1, if
any n-gram of that length is known, the mean of their log frequencies is the word's score, less a penalty per step. A word
unknown throughout counts for no language. The scores of all words of the whole text add up, and the softmax over languages of
their sum over the root of the number of words gives the score.

The model is fitted on at most ``max_fit_rows`` training texts of ``max_fit_chars`` characters in all, an equal part of either for each
language, at least 20 texts, in order of a hash of the id (documented bounds); it holds every word and n-gram of these. A frequency
is smoothed by one occurrence shared out by the mean frequency over all languages, so that large and small samples are alike.

Null texts and texts without a letter are ``und`` with score 0, as is everything if there is no training row; an empty table gives
an empty result. Rows without a language or an id train nothing, repeated rows count as often as they come. Ties go to the
language that comes first. Long texts are read whole. Columns other than id, text and language aren't read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, scratch, texts

WORD = re.compile(r"[^\W\d_]+")
MAX_FIT_ROWS, MAX_FIT_CHARS, LEAST_ROWS, LONGEST = 20_000, 1 << 26, 20, 5
PENALTY = 0.5
CACHE = 200_000
FLUSH = 100_000


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(found: list[str]) -> bool:
    return any(c.isalpha() for w in found for c in w)


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Scores:
    """Log frequencies by language, found by the hash of a word or n-gram: two arrays are all that is broadcast."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, self.values = hashes, values

    def get(self, gram: str) -> tuple[float, ...] | None:
        h = np.array(xxhash.xxh64_intdigest(gram.encode(), 42), np.uint64).view(np.int64)
        k = int(np.searchsorted(self.hashes, h))
        return tuple(self.values[k].tolist()) if k < len(self.hashes) and self.hashes[k] == h else None


@dataclass
class Model:
    langs: list[str]
    word_scores: Scores | dict[str, tuple[float, ...]]
    gram_scores: Scores | dict[str, tuple[float, ...]]
    longest: int

    def word_score(self, word: str) -> tuple[float, ...]:
        if (s := self.word_scores.get(word)) is not None:
            return s
        for step, n in enumerate(range(self.longest, 0, -1), 1):
            if known := [s for g in grams(word, n) if (s := self.gram_scores.get(g)) is not None]:
                return tuple(sum(x) / len(known) - PENALTY * step for x in zip(*known))
        return (0.0,) * len(self.langs)


class Scorer(dict):
    """Predicts by a model; maps words met so far to rows of their scores and starts anew when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((CACHE, len(model.langs)))

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.rows[k] = self.model.word_score(word)
        return k

    def total(self, found: list[str]) -> np.ndarray:
        out = np.zeros(len(self.model.langs))
        for at in range(0, len(found), CACHE // 4):
            part = found[at : at + CACHE // 4]
            if len(self) + len(part) > CACHE:
                self.clear()
            out += self.rows[np.fromiter(map(self.__getitem__, part), np.int32, len(part))].sum(0)
        return out

    def predict(self, text: str) -> tuple[str, float]:
        found = words(text)
        if not self.model.langs or not has_letter(found):
            return "und", 0.0
        total = self.total(found)
        p = np.exp((total - total.max()) / np.sqrt(len(found)))
        k = int(np.argmax(total))
        return self.model.langs[k], float(p[k] / p.sum())


def chosen_rows(labelled: DataFrame, max_fit_rows: int, max_fit_chars: int) -> DataFrame:
    """doc_id and lang of the training sample: rows of each language by hash, within its part of both bounds."""
    slim = labelled.select("doc_id", "lang", F.length("text").alias("size"), F.xxhash64("doc_id", F.lit(5)).alias("h"))
    sizes = materialize(slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    parts = max(1, sizes.count())
    rows, chars = max(LEAST_ROWS, max_fit_rows // parts), max_fit_chars // parts
    # Twice as many as wanted by a threshold on the hash come first, so that no language is put in order as a whole.
    likely = slim.join(broadcast_if_small(sizes), "lang").where((F.col("n") <= 2 * rows) | (F.pmod("h", F.lit(1 << 30)) * F.col("n") < F.lit(2 * rows * (1 << 30))))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "doc_id", "size")
    ranked = likely.withColumn("r", F.row_number().over(order)).withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("r") <= rows) & ((F.col("sum") <= chars) | (F.col("r") == 1))).select("doc_id", "lang").distinct()


def fit(docs: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, longest: int = LONGEST, max_fit_chars: int = MAX_FIT_CHARS) -> Model:
    """docs: doc_id, text and lang, the training rows only."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")

    def rows_of(lang: str, part: Counter) -> Iterator[pa.RecordBatch]:
        items = iter(part.items())
        while some := list(islice(items, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([g for g, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["lang", "gram", "n"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for t, lang in zip(texts(part), part.column(1).to_pylist()):
                    seen[lang].update(words(t))
                if sum(map(len, seen.values())) > FLUSH:
                    for of in seen.items():
                        yield from rows_of(*of)
                    seen.clear()
        for of in seen.items():
            yield from rows_of(*of)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, w, n in zip(*(c.to_pylist() for c in b.columns)):
                for k in range(1, longest + 1):
                    for g in grams(w, k):
                        seen[lang][g] += n
            for of in seen.items():
                yield from rows_of(*of)

    counts, schema = ["lang", "gram", "n"], "lang string, gram string, n long"
    with scratch():
        chosen = broadcast_if_small(materialize(chosen_rows(labelled, max_fit_rows, max_fit_chars)))
        sample = labelled.join(chosen, ["doc_id", "lang"]).select("text", "lang")
        total = lambda rows: materialize(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).select(*counts))
        of_words = total(sample.mapInArrow(count_words, schema))
        of_grams = total(of_words.repartition("gram").mapInArrow(count_grams, schema))  # each word's n-grams once, not each text's
        langs = sorted(r.lang for r in of_words.select("lang").distinct().collect())
        # The sample's bounds bound these: a hash, a language and a count for each word or n-gram.
        found = [t.select(F.xxhash64("gram").alias("h"), F.array_position(F.lit(langs), F.col("lang")).cast("int").alias("lang"), "n").toArrow() if langs else None for t in (of_words, of_grams)]
    return Model(langs, *[Scores(*frequencies(t, len(langs))) if t is not None else {} for t in found], longest)


def frequencies(counted: pa.Table, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and log frequencies by language from rows of h, lang (from 1) and n."""
    hashes, at = np.unique(counted["h"].to_numpy(), return_inverse=True)
    n = np.zeros((len(hashes), langs))
    np.add.at(n, (at, counted["lang"].to_numpy() - 1), counted["n"].to_numpy())
    total = np.maximum(n.sum(0), 1)
    return hashes, np.log((n + (n / total).mean(1, keepdims=True)) / (total + 1))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by max_fit_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Scorer(shared.value)
        for b in batches:
            found = [x for at in range(0, b.num_rows, 256) for x in map(m.predict, texts(b.slice(at, 256)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
