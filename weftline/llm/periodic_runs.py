"""Runs of repeating words: aligned blocks of power-of-two lengths, found again by an automaton over word numbers, seed exact extensions.

A run of period q and 4 q words or more holds, for the power of two b with b <= q < 2 b, an aligned block of b words that
occurs again q words on. So blocks of each length are searched for at the distances b to 2 b - 1, and what is found is extended.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import exact_docs
from .common import slices, strings

#: A run has LEAST words and TIMES its period or more.
LEAST, TIMES = 6, 4
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, from some place on made periodic in every tenth document by the checksum of its id; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def since_last(numbers: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """How many words ago each word last stood in its document; very far where it didn't."""
    out = np.full(len(numbers), 1 << 62, np.int64)
    if len(numbers):
        key = numbers.astype(np.int64) * (int(docs[-1]) + 1) + docs
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        out[order[again + 1]] = order[again + 1] - order[again]
    return out


def stretches(last: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(block length, start, end) of stretches that can hold all but the first period of a run: each of their words stood there less than two block lengths before."""
    b = 1
    while True:
        near = last < 2 * b
        edges = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= max(LEAST - 1, (TIMES - 1) * b) if b == 1 else ends - starts >= (TIMES - 1) * b
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            yield b, s, e
        b *= 2
        if (TIMES - 1) * b > len(last):
            return


def seeds(x: np.ndarray, b: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of aligned blocks of b words in x[start:end] that occur again at a distance from b to 2 b - 1, by distance."""
    at = np.arange(-(-start // b) * b, end - 2 * b + 1, b)
    if not len(at):
        return at, at
    words = tuple(x[start:end].tolist())
    tree, kind, own = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, np.empty(len(at), np.int64)
    for i, p in enumerate((at - start).tolist()):
        block = words[p : p + b]
        own[i] = kind.setdefault(block, len(kind))
        tree.add_word(block, kind[block])
    tree.make_automaton()
    found = np.array([(k, e) for e, k in tree.iter(words)], np.int64).reshape(-1, 2)
    width = end - start + 2 * b + 1
    keys = np.sort(found[:, 0] * width + found[:, 1] - b + 1)
    low, high = (np.searchsorted(keys, own * width + at - start + d) for d in (b, 2 * b))
    count = high - low
    places = np.repeat(at, count)
    which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    distances = keys[which] % width + start - places
    order = np.lexsort((places, distances))
    return places[order], distances[order]


def extended(x: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """The widest [start, end) around x[p : p + q] within which words q apart are equal."""
    i, step = p, 64
    while i > 0:
        a = max(0, i - step)
        bad = np.flatnonzero(x[a:i] != x[a + q : i + q])
        if len(bad):
            i = a + int(bad[-1]) + 1
            break
        i, step = a, 2 * step
    j, step, n = p, 64, len(x) - q
    while j < n:
        z = min(n, j + step)
        bad = np.flatnonzero(x[j:z] != x[j + q : z + q])
        if len(bad):
            j += int(bad[0])
            break
        j, step = z, 2 * step
    return i, j + q


def prime_divisors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] * (n > 1)


def find_runs(x: np.ndarray, parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the numbers x, by start, then period; parts are those of `stretches` in x, by block length."""
    found: set[tuple[int, int, int]] = set()
    by_scale: dict[int, list[tuple[int, int, int]]] = {}  # (start, end, period) of the runs of each block length
    for b, s, e in parts:
        places, distances = seeds(x, b, max(0, s - 2 * b + 1), e)
        known, known_q = (0, 0), 0
        for p, q in zip(places.tolist(), distances.tolist()):
            if q == known_q and known[0] <= p and p + q + b <= known[1]:
                continue
            if _inside(by_scale, p, p + q + b, q):  # part of a run of a divisor: no run of period q holds it
                continue
            known, known_q = extended(x, p, q), q
            a, z = known
            if z - a < max(LEAST, TIMES * q) or (a, z - a, q) in found:
                continue
            # so long a stretch that its smallest period divides q
            if any(np.array_equal(x[a : z - q // d], x[a + q // d : z]) for d in prime_divisors(q)):
                continue
            found.add((a, z - a, q))
            bisect.insort(by_scale.setdefault(b, []), (a, z, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _inside(by_scale: dict[int, list[tuple[int, int, int]]], start: int, end: int, q: int) -> bool:
    for runs in by_scale.values():
        i = bisect.bisect_right(runs, (start, 1 << 62, 0))
        if any(z >= end and r < q and q % r == 0 for _, z, r in runs[max(0, i - 3) : i]):
            return True
    return False


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256 of every whole text.

    A run is a widest stretch of words with smallest period q and max(6, 4 q) words or more. Words that a run holds beyond its
    first q are left out of the collapsed text. Null and empty texts have no words and no runs: null columns and the digests of
    nothing. A null id leaves the words as they are; repeated rows give a row each; an empty table gives none; other columns
    play no part.

    Scale: one pass over the rows without a shuffle. A stretch is only searched where each of its words stood there shortly
    before, which takes one sort of a slice's words; an automaton holds the blocks of one length within one such stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _slice(part)

    return exact_docs(docs, text, key).mapInArrow(run, SCHEMA)


def _slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column("doc_id").to_pylist()
    words = [repeated_tail(t.encode().split(), i) for i, t in zip(ids, strings(batch.column("text")))]
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    numbers = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode().indices.to_numpy()
    docs = np.repeat(np.arange(len(words)), sizes)
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for b, s, e in stretches(since_last(numbers, docs)):
        k = int(docs[s])  # a document's first word stood nowhere before, so no stretch spans two
        parts.setdefault(k, []).append((b, s - int(first[k]), e - int(first[k])))
    rows = []
    for k, (i, ws) in enumerate(zip(ids, words)):
        runs = find_runs(numbers[first[k] : first[k + 1]], parts[k]) if k in parts else []
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        if runs:
            drop = np.zeros(len(ws) + 1, np.int64)
            for s, n, q in runs:
                drop[s + q] += 1
                drop[s + n] -= 1
            ws = [w for w, d in zip(ws, (np.cumsum(drop) > 0).tolist()) if not d]
            s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            best = (s, n, q, 1000 * n // q)
        else:
            best = (None,) * 4
        rows.append((i, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(ws)).hexdigest()))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 6 else pa.string()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int64() if i < 6 else pa.string()) for i in range(8)], names=names)
