"""Benchmark decontamination: pigeonhole edit matching.

A test item of m characters has a budget of k = m // PER_EDIT edits. Cut into k + 1 pieces, a copy within the budget holds one
piece unchanged: pieces are found by an automaton over all of them, and each hit is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_doc, slices, strings

#: Characters of an item for each edit that its copies may have.
PER_EDIT = 12
#: Bytes of items that are searched for, and sent to the workers, at once.
BLOCK = 16 << 20


def normalized(text: str | None) -> str:
    """Lower-cased, white space as single spaces, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(item_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of the item to any substring of the text, and where the first such ends."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    get = item_masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        plus = down | (full & ~(d | up))
        minus = up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(d | plus))
        down = plus & d
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Searches for a block of items: (item_id, normalized text)."""

    def __init__(self, items: list[tuple[int, str]], per_edit: int = PER_EDIT):
        self.items = [(i, t, len(t) // per_edit, masks(t)) for i, t in items if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget, _) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, end, characters) of the best match of each item that the normalized text holds within its budget.

        Windows around the hits of an item's pieces are merged before any is verified, so a text that repeats itself is searched once for each item.
        """
        if not self.any or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                _, item, budget, _ = self.items[n]
                start = end + 1 - size - offset  # where the item would begin
                lo, hi = max(0, start - 2 * budget), min(len(text), start + len(item) + 2 * budget)
                known = windows.setdefault(n, [])
                if known and known[-1][0] <= hi and lo <= known[-1][1]:  # hits come by their ends, so most windows meet the last one
                    known[-1][0], known[-1][1] = min(lo, known[-1][0]), max(hi, known[-1][1])
                else:
                    known.append([lo, hi])
        found = []
        for n, known in windows.items():
            item_id, item, budget, item_masks = self.items[n]
            best = None
            for lo, hi in merged(known):
                distance, at = best_match(item_masks, len(item), text[lo:hi])
                if distance <= budget and (best is None or (distance, lo + at) < best):
                    best = (distance, lo + at)
                if best and best[0] == 0:
                    break
            if best:
                found.append((item_id, *best, len(item)))
        return sorted(found, key=lambda x: (x[0] is None, x))


def merged(windows: list[list[int]]) -> list[tuple[int, int]]:
    """The windows in order, those that meet put together: each place of a text is searched once for an item."""
    out: list[list[int]] = []
    for lo, hi in sorted(windows):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items block by block; one block is on the driver at a time. Items with an equal id are one each; empty ones match nothing."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    block, size, none = [], 0, True
    for r in rows.toLocalIterator():
        t = normalized(r["text"])
        if not t:
            continue
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r["item_id"], t))
        size, none = size + len(t), False
    if block or none:
        yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, per_edit: int = PER_EDIT) -> DataFrame:
    """doc_id, item_id, distance, match_end, item_chars: each document and test item of which it holds a copy within the edit budget.

    distance is the least one over the whole text; match_end is where the match ends in the normalized text (lower case, white
    space as single spaces). Null and empty texts and items match nothing; very long texts are searched whole; repeated rows give repeated
    matches; a null item_id is reported as null; empty tables give no rows; other columns play no part.

    Scale: a map over the scan, once for each BLOCK bytes of items, so that what is sent to workers has a fixed bound.
    """
    texts, parts = by_doc(docs), []
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK bytes at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Matcher(shared.value, per_edit)
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = [(doc, *m) for doc, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text"))) for m in own.matches(normalized(text))]
                    columns = list(zip(*rows)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "match_end", "item_chars"])

        parts.append(texts.mapInArrow(run, "doc_id long, item_id long, distance long, match_end long, item_chars long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, per_edit: int = PER_EDIT) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no test item within its edit budget.

    Null and empty texts stay; repeated rows stay or go together; with an empty benchmark all stay; an empty table gives an empty one; only the
    column text is read, whatever other columns there are.
    """
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Matcher(shared.value, per_edit)
            for batch in batches:
                for part in slices(batch, "text"):
                    clean = np.array([not own.matches(normalized(t)) for t in strings(part.column("text"))], bool)
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
