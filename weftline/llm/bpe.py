"""Byte-pair vocabularies read from tokenizer files: symbols, ranked merges, exact merging and pair checks."""

from __future__ import annotations

import functools
import heapq
import json


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    own = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """One BPE vocabulary: ids of symbols and the merge table (pair of ids -> merged id, by rank)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: list[str] = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in (*self.ids.items(), *self.special.items()):
            self.tokens[i] = token
        symbols = byte_symbols()
        self.first = [self.ids[c] for c in symbols]
        self.last = [self.ids[c + self.suffix] for c in symbols]
        self.rank: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key, new = self.ids[a] << 20 | self.ids[b], self.ids[a + b]
            if key not in self.rank:
                self.rank[key], self.merged[key] = r, new
                self.halves.setdefault(new, (self.ids[a], self.ids[b]))
        self.pairs: dict[int, bool] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pretoken: always the lowest-ranked pair next, the leftmost of equal ones."""
        if not piece:
            return []
        first = self.first
        ids = [first[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.rank.get
        keys = [a << 20 | b for a, b in zip(ids, ids[1:])]
        ranks = [get(k, 1 << 30) for k in keys]
        while ranks:
            low = min(ranks)
            if low == 1 << 30:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [self.merged[ids[i] << 20 | ids[i + 1]]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], 1 << 30)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], 1 << 30)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list: n log n for pieces of any length."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self.rank
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.merged[a << 20 | b]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x, live in zip(ids, alive) if live]

    def stays(self, left: int, right: int) -> bool:
        """Whether the text of two tokens in a row encodes to just these two: no merge crosses between them."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        """Undo the merges of both sides from the latest on; a crossing pair that outranks the next undone merge would have been merged."""
        rank, halves = self.rank, self.halves
        made = lambda t: rank[halves[t][0] << 20 | halves[t][1]] if t in halves else -1
        limit = 1 << 30
        rl, rr = made(left), made(right)
        while True:
            cross = rank.get(left << 20 | right)
            # a crossing pair is taken before a merge of the same rank to its right (leftmost first), after one to its left
            if cross is not None and cross < limit:
                return False
            if rl < 0 and rr < 0:
                return True
            if rl > rr:  # of equal merges the left one came first
                limit, left = rl, halves[left][1]
                rl = made(left)
            else:
                limit, right = rr + 1, halves[right][0]
                rr = made(right)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
