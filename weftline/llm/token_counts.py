"""Token counts: dynamic programming over prefixes gives the exact count at every prefix, without encoding again.

For byte-pair merges, the encoding of a prefix ends in the one token t for which the encoding of what stands before t
ends in a token that stays apart from t. So count(i) = count(i - len(t)) + 1, from left to right.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import Vocabulary, byte_symbols, vocabulary
from .common import by_doc, only, slices
from .text_units import BYTE_PIECES, MARK, UNITS, Slots, byte_units, list_sizes, per_text


_BLANK = regex.compile(r"\s+")


def _plain(unit: str) -> str:
    return unit[len(MARK) :] if unit.startswith(MARK) else unit


class PrefixCounter:
    """Counts of a byte-level vocabulary for whole texts and all their prefixes."""

    def __init__(self, path: str, most: int = 250_000):
        self.vocab: Vocabulary = vocabulary(path)
        back = {c: b for b, c in enumerate(byte_symbols())}
        self.tokens = {bytes(back[c] for c in t): i for t, i in self.vocab.ids.items()}
        self._suffixes()
        self.pieces = Slots(self._count_pieces, most)
        self.units = Slots(self._count_units, most)

    def _suffixes(self) -> None:
        """An automaton over the tokens' bytes: each state knows the tokens that end there, longest first."""
        self.go: dict[int, int] = {}
        self.out: list[tuple[tuple[int, int], ...]] = [()]
        depth, edge, own = [0], [(0, 0)], {}
        for token, i in self.tokens.items():
            at = 0
            for b in token:
                to = self.go.get(at << 8 | b)
                if to is None:
                    to = self.go[at << 8 | b] = len(depth)
                    depth.append(depth[at] + 1)
                    edge.append((at, b))
                at = to
            own[at] = (len(token), i)
        self.tree, self.fail = dict(self.go), [0] * len(depth)
        self.out = [()] * len(depth)
        for at in sorted(range(1, len(depth)), key=depth.__getitem__):
            up, b = edge[at]
            self.fail[at] = self._next(self.fail[up], b) if up else 0
            self.out[at] = ((own[at],) if at in own else ()) + self.out[self.fail[at]]

    def _next(self, at: int, b: int) -> int:
        state = at
        while (to := self.tree.get(state << 8 | b)) is None and state:
            state = self.fail[state]
        if len(self.go) < 2_000_000:
            self.go[at << 8 | b] = to or 0
        return to or 0

    def prefix_table(self, pieces: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(piece, token counts of its prefixes of 0, 1, 2, ... bytes), in the order of the bytes; shared prefixes are computed once."""
        go, out, stays, known = self.go.get, self.out, self.vocab.stays, self.vocab.pairs.get
        counts, last, states, before = [0], [-1], [0], b""
        for piece in sorted(pieces):
            same = len(commonprefix((piece, before)))
            del counts[same + 1 :], last[same + 1 :], states[same + 1 :]
            at = states[same]
            for end in range(same, len(piece)):
                b = piece[end]
                to = go(at << 8 | b)
                at = self._next(at, b) if to is None else to
                for size, t in out[at]:
                    start = end + 1 - size
                    if start == 0 or (known(last[start] << 20 | t) or stays(last[start], t)):
                        counts.append(counts[start] + 1)
                        last.append(t)
                        break
                states.append(at)
            before = piece
            yield piece, counts

    def _count_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = {piece: counts[-1] for piece, counts in self.prefix_table([p.encode() for p in new])}
        return np.asarray([found[p.encode()] for p in new], np.int32), np.ones(len(new), np.int32)

    def _count_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [[] if u.startswith(MARK) else BYTE_PIECES.findall(u) for u in units]
        counts, _ = self.pieces.gather(self.pieces.codes([p for x in lists for p in x]))
        sums = per_text(counts, [len(x) for x in lists])
        sums[[i for i, u in enumerate(units) if u.startswith(MARK)]] = 1
        return sums.astype(np.int32), np.ones(len(units), np.int32)

    def count(self, texts: pa.Array, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text and, with a limit, the characters of its longest prefix of at most so many tokens."""
        lists = byte_units(texts, self.vocab.special)
        units = lists.flatten().dictionary_encode()
        names, at = units.dictionary.to_pylist(), units.indices.to_numpy()
        each, _ = self.units.gather(self.units.codes(names))
        sums = np.concatenate(([0], np.cumsum(each[at], dtype=np.int64)))
        ends = np.concatenate(([0], np.cumsum(list_sizes(lists))))
        totals = sums[ends[1:]] - sums[ends[:-1]]
        fits = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if limit is not None:
            lengths = np.concatenate(([0], np.cumsum(np.array([len(_plain(u)) for u in names], np.int64)[at])))
            for i in np.flatnonzero(totals > limit).tolist():
                a = int(ends[i])
                k = int(np.searchsorted(sums[a : ends[i + 1] + 1], sums[a] + limit, side="right")) - 1 + a  # the units before k fit
                before = names[at[k - 1]] if k > a else ""
                fits[i] = lengths[k] - lengths[a] + self._fit(before, names[at[k]], int(sums[a] + limit - sums[k]))
        return totals, fits

    def _fit(self, before: str, unit: str, left: int) -> int:
        """Characters of the unit that goes over which still fit within `left` tokens."""
        if unit.startswith(MARK):  # cut within a special string, its start is plain text and goes with the unit before it
            head = "" if before.startswith(MARK) else before
            body, left = head + _plain(unit), left + self._within(head, len(head))
            fits = (cut for cut in range(len(body) - 1, len(head), -1) if self._within(body, cut) <= left)
            return next(fits, len(head)) - len(head)
        cuts = self._cuts(unit, left)
        return max((i + 1 for i, n in enumerate(cuts) if n <= left), default=0)

    def _cuts(self, unit: str, most: int | None = None) -> list[int]:
        """Token counts of unit[:1], unit[:2], ...; with `most`, up to where no longer prefix can have so few.

        A prefix has the unit's pieces up to its last one, which the piece's table counts. Only a cut within white space (the run
        before the cut is one piece) or within a contraction is cut anew, from at most a few characters on.
        """
        out: list[int] = []
        spent, before = 0, ""
        over = 0
        for piece in BYTE_PIECES.findall(unit):
            blank = before if before and _BLANK.fullmatch(before) else ""
            table = self._table(blank + piece if _BLANK.fullmatch(piece) else piece)
            if _BLANK.fullmatch(piece):
                base = spent - (self._piece(blank) if blank else 0)
                out += [base + n for n in table[len(blank) + 1 :]]
            else:
                few = min(3, len(piece))
                base = spent - (self._piece(blank) if blank else 0)
                out += [base + self._within(blank + piece[:c], len(blank) + c) for c in range(1, few + 1)]
                out += [spent + n for n in table[few + 1 :]]
            spent, before = spent + self._piece(piece), piece
            over += most is not None and spent > most
            if over == 2:
                break
        return out

    def _table(self, piece: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, 2, ... characters of a piece."""
        counts = next(iter(self.prefix_table([piece.encode()])))[1]
        if piece.isascii():
            return list(counts)
        ends = np.cumsum([0, *(len(c.encode()) for c in piece)])
        return [counts[i] for i in ends]

    def _piece(self, piece: str) -> int:
        return int(self.pieces.gather(self.pieces.codes([piece]))[0][0])

    def prefixes(self, text: str) -> list[int]:
        """The token count of text[:i] for every i from 0 to its length."""
        out, total, head, spent = [0], 0, "", 0
        for unit in byte_units(pa.array([text]), self.vocab.special)[0].as_py():
            body = _plain(unit)
            if not body:
                continue
            if unit.startswith(MARK):
                out += [total - spent + n for n in self._cuts(head + body)[len(head) : -1]]
                total, head, spent = total + 1, "", 0
                out.append(total)
            else:
                cuts = self._cuts(body)
                out += [total + n for n in cuts]
                head, spent = body, cuts[-1]
                total += spent
        return out

    def _within(self, unit: str, cut: int) -> int:
        return sum(map(self._piece, BYTE_PIECES.findall(unit[:cut])))


def counter(path: str) -> PrefixCounter:
    return only(("counts", path), lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the characters of the longest prefix of at most `limit` tokens.

    One row per input row, null texts as empty (0 tokens, 0 bytes), null and repeated doc_ids as they are; special strings
    in a text count as one token; an empty table gives no rows; other columns play no part.

    Scale: a map over the scan of two columns, no shuffle; workers hold 8 MB of text and a bounded table at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", UNITS):
                totals, fits = own.count(part.column("text"), limit)
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(totals), pa.array(totals > limit), pa.array(fits)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return by_doc(docs, text, key).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
