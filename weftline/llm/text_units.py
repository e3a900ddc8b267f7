"""Cutting whole texts into units that a tokenizer treats alone, and a bounded table of what they encode to.

A text of millions of words has few distinct ones: each unit is resolved once per worker and table filling,
and texts are put together from the table by array operations.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text that are cut into units at once: each distinct unit is looked up once in them.
UNITS = 8 << 20
#: Where Python and the tokenizers library may part: controls, what is beyond Latin Extended-A, and the one letter whose lower case is two.
ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9fİ]|[^\x00-ſ]")
#: What stands for a special token among words; no normal text has NUL at the start of a word of an even text.
MARK = "\0special:"  # NUL makes it odd
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Rows that take the plain Python way below; all others are lower-cased and split by Arrow.
ODD_ROW = "[\\x00-\\x08\\x0e-\\x1f\\x7f-\\xa0İ]|[^\\x00-ſ]|<\\|"
#: White space that makes a cut at every space wrong, and what marks special strings.
WIDE_ROW = "  | [\\t\\n\\r]|[\\t\\n\\r] | \\z|<\\||[\\x00\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _lists(texts: pa.Array, odd: str, even_way: Callable[[pa.Array], pa.Array], odd_way: Callable[[str], list[str]]) -> pa.Array:
    """A list of units per text; rows that match `odd` go through odd_way one by one."""
    texts = pc.fill_null(texts, "")
    is_odd = pc.match_substring_regex(texts, odd)
    if not pc.any(is_odd).as_py():
        return even_way(texts)
    even = even_way(texts.filter(pc.invert(is_odd)))
    rest = pa.array([odd_way(t) for t in texts.filter(is_odd).to_pylist()], pa.list_(pa.string()))
    flags = is_odd.to_numpy(zero_copy_only=False)
    order = np.empty(len(flags), np.int64)
    order[~flags], order[flags] = np.arange(len(even)), np.arange(len(even), len(flags))
    return pa.concat_arrays([even.cast(rest.type), rest]).take(pa.array(order))


def word_units(texts: pa.Array, path: str, special: Iterable[str]) -> pa.Array:
    """White-space separated words after the word tokenizer's normalization; special tokens come as MARK + content."""

    def odd_way(text: str) -> list[str]:
        out: list[str] = []
        for part in _parts(text, special):
            out += [part] if part.startswith(MARK) else [w for w in library(path).normalizer.normalize_str(part).split(" ") if w]
        return out

    def even_way(texts: pa.Array) -> pa.Array:
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        if not pc.any(pc.equal(words.flatten(), "")).as_py():
            return words
        return pa.array([[w for w in x if w] for x in words.to_pylist()], words.type)

    # white space at an end would give an empty word
    return _lists(pc.ascii_trim_whitespace(texts), ODD_ROW, even_way, odd_way)


def byte_units(texts: pa.Array, special: Iterable[str]) -> pa.Array:
    """Parts cut before a space that a non-space follows: the byte tokenizer's pattern never crosses such a cut."""

    def odd_way(text: str) -> list[str]:
        out: list[str] = []
        for part in _parts(text, special):
            out += [part] if part.startswith(MARK) else [u for u in _RUN.split(part) if u]
        return out

    return _lists(texts, WIDE_ROW, lambda t: pc.split_pattern(pc.replace_substring(t, " ", "\0 "), "\0"), odd_way)


def _parts(text: str, special: Iterable[str]) -> list[str]:
    """The text cut at special strings, which come as MARK + content."""
    if not any(s in text for s in special):
        return [text] if text else []
    return [MARK + x if x in special else x for x in re.split("(" + "|".join(map(re.escape, special)) + ")", text) if x]


def word_pieces(word: str) -> list[str]:
    return [word] if word.isalpha() else WORD_PIECES.findall(word)


_RUN = regex.compile(r"(?= \S)")


class _Index(dict):
    """unit -> slot; a unit not seen before gets the next slot and waits to be resolved."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.waiting.append(unit)
        slot = self[unit] = len(self)
        return slot


class Slots:
    """A table from units to arrays of numbers. resolve(units) -> (all numbers in a row, how many each unit has).

    Beyond `most` units the table keeps only those that came back, so that memory stays bounded whatever the corpus holds.
    """

    def __init__(self, resolve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 150_000, dtype=np.int32):
        self.resolve, self.most, self.dtype = resolve, most, dtype
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.flat = np.empty(1 << 16, self.dtype)
        self.used = 0
        self.starts, self.sizes, self.seen = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def shrink(self) -> None:
        """Keep the units seen in several calls, half the table at most."""
        seen = self.seen[: len(self.index)]
        least = max(1, int(np.partition(seen, -self.most // 2)[-self.most // 2]))
        keep = np.flatnonzero(seen > least)
        units = list(self.index)
        flat, sizes = self.gather(keep)
        held = [units[i] for i in keep.tolist()]
        self.clear()
        resolve, self.resolve = self.resolve, lambda _: (flat, sizes)
        self.codes(held)
        self.resolve = resolve

    def codes(self, units: list[str]) -> np.ndarray:
        if len(self.index) > self.most:
            self.shrink()
        codes = np.fromiter(map(self.index.__getitem__, units), np.int32, len(units))
        if waiting := self.index.waiting:
            self.index.waiting = []
            first = len(self.index) - len(waiting)
            flat, sizes = self.resolve(waiting)
            for name, need in (("flat", self.used + len(flat)), ("starts", len(self.index)), ("sizes", len(self.index)), ("seen", len(self.index))):
                if len(getattr(self, name)) < need:
                    grown = np.zeros(max(need, 3 * len(getattr(self, name)) // 2), getattr(self, name).dtype)
                    grown[: len(getattr(self, name))] = getattr(self, name)
                    setattr(self, name, grown)
            self.flat[self.used : self.used + len(flat)] = flat
            self.sizes[first : len(self.index)] = sizes
            self.starts[first : len(self.index)] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
            self.used += len(flat)
        self.seen[codes] += 1  # once a call, however often a unit comes in it
        return codes

    def lookup(self, units: pa.Array) -> np.ndarray:
        """codes() of an Arrow column: only its distinct units are looked up one by one."""
        coded = units.dictionary_encode()
        return self.codes(coded.dictionary.to_pylist())[coded.indices.to_numpy()]

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the units in a row, and how many each has."""
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[codes] - (ends - sizes), sizes)
        return self.flat[at], sizes


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def per_text(sizes: np.ndarray, counts) -> np.ndarray:
    """Sums of the units' sizes text by text; counts: units of each text."""
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    ends = np.cumsum(counts, dtype=np.int64)
    return total[ends] - total[ends - np.asarray(counts, dtype=np.int64)]


class WordEncoder:
    """Ids of the word tokenizer for whole texts: units from the table, pieces resolved by `piece_ids`."""

    def __init__(self, path: str, special: dict[str, int], piece_ids: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], odd_ids: Callable[[str], list[int]], most: int = 150_000):
        self.path, self.special, self.odd_ids = path, special, odd_ids
        self.pieces = Slots(piece_ids, most)
        self.words = Slots(self._resolve, most)

    def _resolve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if ODD.search("\n".join(words)) is None:
            lists = [[w] if w.isalpha() else WORD_PIECES.findall(w) for w in words]
            flat, sizes = self.pieces.gather(self.pieces.codes([p for x in lists for p in x]))
            return flat, per_text(sizes, [len(x) for x in lists]).astype(np.int32)
        lists, alone = [], {}
        for i, w in enumerate(words):
            if odd := ODD.search(w):
                alone[i] = [self.special[w[len(MARK) :]]] if w.startswith(MARK) else self.odd_ids(w)
            lists.append([] if odd else word_pieces(w))
        flat, sizes = self.pieces.gather(self.pieces.codes([p for x in lists for p in x]))
        out = per_text(sizes, [len(x) for x in lists]).astype(np.int32)
        parts = np.split(flat, np.cumsum(out)[:-1])
        for i, ids in alone.items():
            parts[i], out[i] = np.asarray(ids, np.int32), len(ids)
        return np.concatenate(parts), out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        units = word_units(texts, self.path, self.special)
        flat, sizes = self.words.gather(self.words.lookup(units.flatten()))
        return flat, per_text(sizes, list_sizes(units))
