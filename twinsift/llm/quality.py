"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Three views of a text's words give n-grams: the words themselves (1 and 2), their shapes (1 to 3: how they begin, whether all
letters are upper case, their last three signs) and how they repeat the words just before (1, 2 and 4). An n-gram counts once
per text. Indicators are scaled by the log of the ratio of the two classes' smoothed counts, over all training rows; then a
linear hinge-loss model is fitted by dual coordinate descent on at most ``max_fit_rows`` training rows with ``max_fit_entries``
n-grams in all (taken in order of a hash of the id; documented bounds). One in ten of these is held back to turn margins into
probabilities.

Only the text is read for a score. Null and empty texts have no n-gram and get the score of the intercept. If only one class
is known, scores are that class's share; without any training row they are 0.5. Repeated rows count as often as they come, and an
empty table gives an empty result. Rows tied in the order by hash have one id and label; those with fewer n-grams come first. Long
texts are hashed in slices that end between words; each begins with the words before it, so that the n-grams are those of the
whole text. Columns other than id, text and label aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, scratch, texts

BITS = 18
SIZE = 1 << BITS
SLICE = 1 << 22
#: Bytes of short texts that are worked on together: n-grams of a block take some eighty times its size while they are sorted.
BLOCK = SLICE // 8
MAX_FIT_ROWS, MAX_FIT_ENTRIES = 10_000, 20_000_000
#: Words of a text that an n-gram may depend on: four in a row, each compared with four before it.
CONTEXT = 8

_TABLE = np.random.default_rng(20260101).integers(0, 1 << 63, 16 * 256, dtype=np.uint64) | np.uint64(1)
_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, (9, 10, 11, 12, 13, 32))
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_LOWER = np.where(_UPPER, _BYTE + 32, _BYTE)
#: For shapes: letters are one class, digits another, other signs stand for themselves.
_CLASS = np.where(_LETTER, 1, np.where((_BYTE >= 48) & (_BYTE <= 57), 2, _BYTE)).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def slices(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > SLICE:
        end = min((e for e in (raw.find(s, at + SLICE) for s in (b" ", b"\n")) if e >= 0), default=len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The part and the hash (ASCII letters as lower case) of each word."""
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    gap = _SPACE[data]
    start = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
    length = end - start
    inside = np.flatnonzero(~gap)
    first_of = np.cumsum(length) - length
    place = np.arange(len(inside)) - np.repeat(first_of, length)
    word = _mix(np.add.reduceat(_TABLE[_LOWER[data[inside]] + 256 * (place & 15)], first_of))
    return np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right"), word


def word_blocks(docs: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of documents as (first document, document of each word, word hash)."""
    for first, held in blocks(docs):
        if len(held) == 1 and len(held[0]) > SLICE:
            word = np.concatenate([word_hashes([s])[1] for s in slices(held[0])])
            yield first, np.zeros(len(word), np.int64), word
        else:
            yield (first, *word_hashes(held))


def blocks(docs: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of documents of some MB as (first document, UTF-8 texts); one longer than SLICE stands alone."""
    held, size, first = [], 0, 0
    for k, t in enumerate(docs):
        raw = t.encode()
        if held and size + len(raw) > min(BLOCK, SLICE):  # a text over SLICE stands alone, whatever the two are
            yield first, held
            held, size, first = [], 0, k
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def ngrams(parts: list[bytes], skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (part, n-gram) pairs as two arrays, sorted by part. n-grams are hashes below SIZE. The first ``skip`` words are context:
    no n-gram ends there."""
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    ends_of = np.cumsum([len(p) + 1 for p in parts])
    gap = _SPACE[data]
    start = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
    length = end - start
    part = np.searchsorted(ends_of, start, side="right")
    inside = np.flatnonzero(~gap)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    letters = data[inside]
    first_of = np.cumsum(length) - length
    word = _mix(np.add.reduceat(_TABLE[_LOWER[letters] + 256 * (place & 15)], first_of))
    n_upper = np.add.reduceat(_UPPER[letters].astype(np.int32), first_of)
    n_letter = np.add.reduceat(_LETTER[letters].astype(np.int32), first_of)
    shape = _CLASS[data[start]] * np.uint64(4) + _UPPER[data[start]] * np.uint64(2) + ((n_upper > 1) & (2 * n_upper > n_letter))
    for back in (1, 2, 3):
        shape = shape * np.uint64(256) + np.where(length >= back, _CLASS[data[np.maximum(end - back, 0)]], np.uint64(0))
    shape = _mix(shape)

    def ago(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """x as it was k words before, and whether that word is in the same part."""
        old = np.concatenate((x[:1].repeat(min(k, len(x))), x[:-k]))[: len(x)]
        was = np.concatenate((np.full(min(k, len(x)), -1), part[:-k]))[: len(x)]
        return old, was == part

    repeat = np.zeros(len(word), np.uint64)
    for k, bit in ((1, 1), (2, 2), (3, 2), (4, 2)):
        old, same = ago(word, k)
        repeat |= np.where(same & (old == word), np.uint64(bit), np.uint64(0))
    found_part, found = [], []

    def add(view: int, grams: np.ndarray, keep: np.ndarray | None = None) -> None:
        g = _pair(grams, np.full(len(grams), view, np.uint64)) >> np.uint64(64 - BITS)
        p = part
        if keep is not None:
            g, p = g[keep], p[keep]
        elif skip:
            g, p = g[skip:], p[skip:]
        found.append(g.astype(np.int64))
        found_part.append(p)

    for view, x, wide in ((1, word, 2), (2, shape, 3), (3, repeat, 4)):
        grams, kept = x, np.arange(len(x)) >= skip
        add(view * 10 + 1, grams)
        for k in range(1, wide):
            old, same = ago(x, k)
            grams, kept = _pair(grams, old), kept & same
            if (view, k) != (3, 2):
                add(view * 10 + k + 1, grams, kept)
    both = np.unique(np.concatenate(found_part).astype(np.int64) << BITS | np.concatenate(found))
    return both >> BITS, both & (SIZE - 1)


def indicators(docs: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of documents as (first document, document of each n-gram, n-gram)."""
    for first, held in blocks(docs):
        if len(held) == 1 and len(held[0]) > SLICE:
            seen, before = np.zeros(SIZE, bool), []
            for s in slices(held[0]):
                seen[ngrams([b" ".join([*before, s])], len(before))[1]] = True
                before = b" ".join([*before, s]).rsplit(None, CONTEXT)[-CONTEXT:]
            yield first, np.zeros(int(seen.sum()), np.int64), np.flatnonzero(seen)
        else:
            yield (first, *ngrams(held))


@dataclass
class Model:
    weights: np.ndarray  # of n-grams, ratio included
    squares: np.ndarray  # of the ratios: a text's n-grams have unit length
    intercept: float
    slope: float
    shift: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))

    def margins(self, docs: list[str]) -> np.ndarray:
        out = np.full(len(docs), self.intercept)
        for first, doc, gram in indicators(docs):
            if len(doc):
                part = np.bincount(doc, self.weights[gram])
                out[first : first + len(part)] += part / np.sqrt(np.maximum(np.bincount(doc, self.squares[gram]), 1e-9))
        return out


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of label 0 and 1 hold each n-gram (2 x SIZE), and how many texts there are of each, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * SIZE + 2, np.int64)
        for b in batches:
            label = b.column(1).to_numpy()
            counts[2 * SIZE :] += np.bincount(label, minlength=2)
            for first, doc, gram in indicators(texts(b)):
                counts[: 2 * SIZE] += np.bincount(label[first + doc] * SIZE + gram, minlength=2 * SIZE)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["k", "n"])

    sums = labelled.select("text", F.col("label").cast("long")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * SIZE + 2, np.int64)  # its size is fixed by BITS
    out[sums["k"].to_numpy()] = sums["n"].to_numpy()
    return out[: 2 * SIZE].reshape(2, SIZE), out[2 * SIZE :]


def log_ratio(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p = counts + smooth
    p = p / p.sum(1, keepdims=True)
    return np.log(p[1] / p[0])


def gram_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The n-grams of each row of a binary column, as views of one buffer."""
    held = column.cast(pa.large_binary()).combine_chunks()
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else []
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
    return [data[s:e].view(np.int32) for s, e in zip(ends[:-1], ends[1:])]


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear model with hinge loss on rows of n-grams, each with its ratio as value."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    # In one piece, which goes back to the system: thousands of small ones would stay with the driver.
    flat = ratio[np.concatenate([np.zeros(0, np.int32), *rows])]
    values = np.split(flat, np.cumsum([len(r) for r in rows])[:-1])
    # Rows are scaled to unit length, so that one bound serves short and long texts.
    norm = np.array([1 / np.sqrt(max(v @ v, 1e-9)) for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * ((w[rows[i]] @ values[i]) * norm[i] + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * norm[i] * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def calibrate(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins and labels, by Newton's method with a slight pull to zero."""
    x, t = np.stack([margin, np.ones(len(margin))], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        grad = x.T @ (p - label) + 1e-2 * t
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        t = t - step
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, max_fit_entries: int = MAX_FIT_ENTRIES) -> Model:
    """docs: doc_id and text. labels: doc_id and label (0 or 1), the training rows only."""
    labels = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    labelled = docs.select("doc_id", "text").join(broadcast_if_small(labels, 1_000_000), "doc_id")
    counts, totals = class_counts(labelled)
    if not totals.all():
        share = 0.5 if not totals.any() else float(totals[1] > 0)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    ratio = log_ratio(counts)
    chosen = F.broadcast(labels.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "label").limit(max_fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [np.zeros(0, np.int32)] * b.num_rows
            for first, doc, gram in indicators(texts(b)):
                cuts = np.searchsorted(doc, np.arange(doc[-1] + 2)) if len(doc) else []
                for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                    grams[first + k] = gram[s:e].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.tobytes() for g in grams], pa.binary()), b.column(2), pa.array([len(g) for g in grams], pa.int64())], ["doc_id", "grams", "label", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch():
        table = materialize(docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(run, f"doc_id {kind}, grams binary, label int, n long").withColumn("key", F.xxhash64("doc_id", "label", F.lit(3))))
        # The sample's size in bytes is bounded before it comes to the driver: rows by key until the n-grams are enough.
        sizes = table.select("key", "n").orderBy("key", "n").limit(max_fit_rows).toArrow()
        enough = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), max_fit_entries, side="right"))
        last = sizes["key"][min(max(enough, 1), sizes.num_rows) - 1].as_py() if sizes.num_rows else 0
        sample = table.where(F.col("key") <= last).orderBy("key", "n").limit(max(enough, 1)).select("doc_id", "grams", "label").toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    rows, label = gram_rows(sample["grams"]), sample["label"].to_numpy()
    del sample
    y = np.where(label > 0, 1.0, -1.0)
    aside = np.arange(len(rows)) % 10 == 9
    if len(set(label[~aside])) < 2 or len(set(label[aside])) < 2:
        aside = np.zeros(len(rows), bool)
    w, bias = dual_descent([r for r, a in zip(rows, aside) if not a], y[~aside], ratio)
    weights, squares = w * ratio, ratio**2
    held = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
    margin = np.array([weights[rows[i]].sum() / np.sqrt(max(squares[rows[i]].sum(), 1e-9)) + bias for i in held])
    model = Model(weights, squares, bias, *calibrate(margin, label[held]))
    del rows
    pa.default_memory_pool().release_unused()
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the probability of label 1."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(model.margins(texts(b))))], ["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


def keep_documents(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score at least this."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(model.margins(texts(b, text_col))) >= least))

    return docs.mapInArrow(run, docs.schema)
