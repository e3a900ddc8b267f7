"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log-ratio of their smoothed counts in the two classes; a linear model with hinge loss is
fitted on the scaled, unit-length vectors by dual coordinate descent, and a logistic curve over its margins gives scores.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_doc, only, slices, trim
from .text_units import Slots, list_sizes

U = np.uint64
#: Features are hashed into 2**BITS bins.
BITS = 20
#: Bytes of text whose features are made at once: each byte takes about 60 of memory.
STEP = 1 << 20
#: Labelled documents to fit on at most: those of the smallest hashes.
SAMPLE = 8_000


def _shape(word: str) -> str:
    """Upper case, lower case and digits as one letter each, other characters as they are; runs of one kind keep two."""
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out[-2:] != [k, k]:
            out.append(k)
    return "".join(out)


def _hashes() -> Slots:
    return only(("hashes",), _hash_slots)


def _hash_slots() -> Slots:
    """Two numbers per word, of its lower case and of its shape."""

    def resolve(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = [h for w in words for h in (xxhash.xxh64_intdigest(w.lower().encode()), xxhash.xxh64_intdigest(_shape(w).encode(), 1))]
        return np.array(flat, U), np.full(len(words), 2, np.int32)

    return Slots(resolve, 120_000, U)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of the distinct indicators of each text: words, pairs of words, shapes, runs of two and three shapes, and how many lines and words are repeats."""
    texts = pc.fill_null(texts, "")
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    sizes = list_sizes(lists)
    coded = lists.flatten().dictionary_encode()
    names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    both = _hashes().gather(_hashes().codes(names))[0].reshape(-1, 2)
    word, shape = both[at, 0], both[at, 1]
    row = np.repeat(np.arange(len(sizes)), sizes)
    k = U(0x9E3779B97F4A7C15)
    same2, same3 = row[1:] == row[:-1], row[2:] == row[:-2]
    pairs = ((word[:-1] * k + word[1:]) * k)[same2], (shape[:-1] * k + shape[1:] + U(3))[same2]
    triple = (((shape[:-2] * k + shape[1:-1]) * k + shape[2:]) + U(5))[same3]
    rows = np.concatenate((row, row[1:][same2], row, row[1:][same2], row[2:][same3]))
    hashes = np.concatenate((word, pairs[0], shape, pairs[1], triple))
    keys = np.unique(rows.astype(np.int64) << BITS | _bin(hashes))
    # how much a text repeats itself, in tenths
    repeats = []
    words_apart = np.bincount((np.unique(row.astype(np.int64) << 32 | at) >> 32).astype(np.int64), minlength=len(sizes)) if len(at) else np.zeros(len(sizes), int)
    for i, t in enumerate(texts.to_pylist()):
        lines = [x for x in t.split("\n") if x.strip()]
        share = 10 - 10 * len(set(lines)) // max(1, len(lines))
        repeats.append((i, f"lines:{share}"))
        repeats.append((i, f"words:{10 - 10 * int(words_apart[i]) // max(1, int(sizes[i]))}:{int(np.log2(sizes[i] + 1)) // 2}"))
    extra = np.array([i << BITS | int(_bin(np.array([xxhash.xxh64_intdigest(x.encode(), 2)], U))[0]) for i, x in repeats], np.int64)
    keys = np.unique(np.concatenate((keys, extra)))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _bin(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))); margin = weights . unit vector of ratio over the text's bins."""

    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, bins = features(texts)
        r = self.ratio[bins].astype(np.float64)
        n = len(texts)
        norm = np.sqrt(np.bincount(row, r * r, n))
        margin = np.bincount(row, r * self.weights[bins], n) / np.where(norm > 0, norm, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def fit(samples: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 20, seed: int = 0) -> Model:
    """samples: the bins of each text; labels: 0 or 1. With one class or none, every score is the smoothed share of label 1."""
    size = 1 << BITS
    y = np.where(labels == 1, 1.0, -1.0)
    n1, n0 = int((labels == 1).sum()), int((labels != 1).sum())
    prior = (n1 + 1) / (n1 + n0 + 2)
    if not n1 or not n0:
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, float(np.log(prior / (1 - prior))))
    p, q = np.ones(size), np.ones(size)
    for x, label in zip(samples, labels):
        (p if label == 1 else q)[x] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p == 1) & (q == 1)] = 0  # never seen
    rows = [ratio[x] / max(1e-12, np.sqrt((ratio[x] ** 2).sum())) for x in samples]
    # dual coordinate descent for the L1 hinge loss; the two classes weigh the same in total
    cost = np.where(y > 0, c * len(y) / (2 * n1), c * len(y) / (2 * n0))
    w, alpha, random = np.zeros(size), np.zeros(len(y)), np.random.default_rng(seed)
    diagonal = np.array([float(r @ r) for r in rows])
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(y)):
            if diagonal[i] <= 0:
                continue
            g = y[i] * float(w[samples[i]] @ rows[i]) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), cost[i])
            if new != alpha[i]:
                w[samples[i]] += (new - alpha[i]) * y[i] * rows[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    margins = np.array([float(w[x] @ r) for x, r in zip(samples, rows)])
    slope, shift = _logistic(margins, (labels == 1).astype(float))
    return Model(ratio.astype(np.float32), w.astype(np.float32), slope, shift)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with softened targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        g, h = s - t, s * (1 - s) + 1e-9
        ga, gb = float(g @ m) + 1e-6 * a, float(g.sum())
        haa, hab, hbb = float(h @ (m * m)) + 1e-6, float(h @ m), float(h.sum())
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def held_out(key: Column, folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, modulo folds; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents that are not held out.

    Labels other than 0 and 1, null ones, and ids with both labels are left out; of an id's several texts the one of the smallest hash counts.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where((F.col("quality") == F.col("other")) & ~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("label_id"), "quality")
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # `sample` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                row, bins = features(part.column("text"))
                lists = np.split(bins.astype(np.int32), np.searchsorted(row, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), part.column("quality").cast(pa.int32()), pa.array([x.tobytes() for x in lists], pa.binary())], names=["doc_id", "hash", "quality", "bins"])

    found = texts.select("doc_id", "text", F.xxhash64("text").alias("hash"), "quality").mapInArrow(run, "doc_id long, hash long, quality int, bins binary")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("hash", "quality", "bins")).alias("x")).select("doc_id", "x.quality", "x.bins").collect()  # `sample` rows at most
    rows.sort(key=lambda r: r["doc_id"])
    bins, labels_ = [np.frombuffer(r["bins"], np.int32) for r in rows], np.array([r["quality"] for r in rows])
    model = fit(bins, labels_)
    del rows, bins
    gc.collect()
    trim()  # the driver goes on to other steps
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted per input row; 1 is predicted from the threshold on.

    Null and empty texts get the score of a text without words; very long ones are read whole; repeated rows get equal scores; an empty table gives no rows; without
    usable labels all scores are 0.5; columns beyond doc_id and text play no part in a score.

    Scale: the model is fitted on a bounded sample (SAMPLE) and has a fixed size; scoring is a map over the scan, STEP bytes at a time.
    """
    texts = by_doc(docs)
    model = docs.sparkSession.sparkContext.broadcast(train(texts, labels, sample))  # 8 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                s = model.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores the threshold or more.

    Null and empty texts have the score of a text without words; repeated rows stay or go together; without usable labels all stay (0.5) at
    thresholds up to 0.5; an empty table gives an empty one; columns beyond doc_id and text play no part and may have any names.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(by_doc(docs), labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                yield part.filter(pa.array(model.value.scores(part.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
