"""Bytes covered by strings of a given length that also start in a document with a smaller id.

A string is known by an anchor, the smallest hash of the short grams within it, so equal strings have equal anchors at equal places.
Strings that start next to each other and share an anchor are one piece of text, cut in two at the anchor. Pieces whose anchor
stands in one document only are settled; the others go where their anchor's hash sends them, each distinct one of a pack of documents
once. There the right parts and the reversed left parts are sorted as suffixes: prefix polynomial hashes and binary search find how
far two of them agree, mergesort needs a logarithm of their length for a comparison, and the bytes of neighbours are compared in
the end, so no collision can tell.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import exact_docs
from .common import forget, fresh_path, put, take, trim, written

#: Bytes of a gram, of a pack of documents, and of text for each bucket of anchors; window starts hashed at once.
GRAM, PACK, BUCKET, STEP = 24, 2 << 20, 8 << 20, 1 << 16
#: An anchor with more distinct pieces than this sends single strings, dealt by their own hashes, in place of pieces.
HOT = 1 << 12
#: The least number of buckets, and pieces sorted at once.
BUCKETS, SORTED = 64, 1 << 15
NO_ID = (1 << 63) - 1
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


class Hashes:
    """Hashes of any substring of some bytes from the hashes of all prefixes, modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix, self.inverse = np.zeros(n + 1, np.uint64), _powers(pow(_BASE, -1, 1 << 64), n + 1)
        np.cumsum(_BYTES[data] * _powers(_BASE, n), out=self.prefix[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1); a worker keeps those for PACK bytes."""
    if base in _kept and len(_kept[base]) >= n:
        return _kept[base][:n]
    out = np.full(max(n, 1), base & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    out = np.cumprod(out)[:n]
    if n <= 2 * PACK:
        _kept[base] = out
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(data: np.ndarray, ends: np.ndarray, width: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start of the first string, number of strings, anchor's place, anchor's hash) of each piece of documents that end at ends."""
    n, span = len(data), width - GRAM + 1
    if n < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    starts = np.concatenate(([0], ends[:-1]))
    out: list[tuple] = []
    for a in range(0, n - width + 1, STEP):
        z = min(n - width + 1, a + STEP)
        value = mixed((hashes.prefix[a + GRAM : z + width] - hashes.prefix[a : z + width - GRAM]) * hashes.inverse[a : z + width - GRAM])
        place, size = np.zeros(len(value), np.uint8), 1
        grams = value
        while size < span:
            by = min(size, span - size)
            left, right = value[:-by], value[by:]
            place = np.where(left <= right, place[:-by], place[by:] + np.uint8(by))
            value = np.minimum(left, right)
            size += by
        valid = np.zeros(z - a + 1, np.int32)
        for_docs = slice(*np.searchsorted(ends, [a, z + width]))
        s, e = starts[for_docs.start : for_docs.stop + 1], ends[for_docs.start : for_docs.stop + 1]
        has = e - s >= width
        s, e = np.clip(s[has] - a, 0, z - a), np.clip(e[has] - width + 1 - a, 0, z - a)
        np.add.at(valid, s, 1)
        np.add.at(valid, e, -1)
        at = np.flatnonzero(np.cumsum(valid[:-1]))
        out.append((at + a, at + place[at], grams[at + place[at]], np.full(len(at), a)))
    at = np.concatenate([x[0] for x in out])
    anchor = np.concatenate([x[1] + x[3] for x in out])
    value = np.concatenate([x[2] for x in out])
    if not len(at):
        return at, at, anchor, value
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]))))
    return at[first], np.diff(np.append(first, len(at))), anchor[first], value[first]


def padded(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """A row of bytes for each substring, zeros behind."""
    at = start[:, None] + np.arange(width)
    return np.where(np.arange(width) < length[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def alike(data: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each substring the first one with the same key that it equals byte by byte; itself where a key's first one differs."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    first = np.empty(len(key), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = np.flatnonzero(first != np.arange(len(first)))
    width = int(length.max(initial=1))
    for a in range(0, len(again), SORTED):
        x = again[a : a + SORTED]
        y = first[x]
        same = (length[x] == length[y]) & (padded(data, start[x], length[x], width) == padded(data, start[y], length[y], width)).all(1)
        first[x[~same]] = x[~same]
    return first


class Suffixes:
    """Some substrings of some bytes in groups; each group's are sorted by merging, compared by hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray):
        self.data, self.start, self.length, self.group, self.hashes = data, start, length, group, Hashes(data)
        self.order = self._sort()
        self.common = self._common()

    def agree(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bytes two substrings have in common from their start, by binary search over hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        sx, sy = self.start[x], self.start[y]
        px, py, ix, iy = self.hashes.prefix[sx], self.hashes.prefix[sy], self.hashes.inverse[sx], self.hashes.inverse[sy]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            half = (low + high + 1) // 2
            same = (self.hashes.prefix[sx + half] - px) * ix == (self.hashes.prefix[sy + half] - py) * iy
            low, high = np.where(same & open_, half, low), np.where(~same & open_, half - 1, high)

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as a substring stands before, with or behind another one."""
        n = self.agree(x, y)
        lx, ly = self.length[x], self.length[y]
        bx = np.where(n < lx, self.data[np.minimum(self.start[x] + n, len(self.data) - 1)].astype(np.int16), -1)
        by = np.where(n < ly, self.data[np.minimum(self.start[y] + n, len(self.data) - 1)].astype(np.int16), -1)
        return np.sign(bx - by)

    def _sort(self) -> np.ndarray:
        """Merges runs of 1, 2, 4, .. of each group, all groups at once: an element's place is its own plus its rank in the other run."""
        order = np.argsort(self.group, kind="stable")
        g = self.group[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(g)))
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        inside = np.arange(len(g)) - begin
        run = 1
        while run < size.max(initial=0):
            own = np.flatnonzero(end - begin > run)
            j, b, e = inside[own], begin[own], end[own]
            mine = j // run
            low = np.minimum(b + (mine ^ 1) * run, e)
            high = np.minimum(low + run, e)
            from_, x, right = low.copy(), order[own], mine % 2 == 1
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                half = (low[open_] + high[open_]) // 2
                way = self.before(order[half], x[open_])
                less = (way < 0) | ((way == 0) & right[open_])  # equal ones keep their order
                low[open_], high[open_] = np.where(less, half + 1, low[open_]), np.where(less, high[open_], half)
            place = b + mine // 2 * 2 * run + j % run + low - from_
            merged = order.copy()
            merged[place] = x
            held = np.zeros(len(order), bool)
            held[place] = True
            for g in np.unique(self.group[order[own[~held[own]]]]).tolist():  # a collision has given two of them one place
                at = np.flatnonzero(self.group[order] == g)
                merged[at] = self._by_bytes(order[at])
            order, run = merged, 2 * run
        return order

    def _by_bytes(self, own: np.ndarray) -> list[int]:
        return sorted(own.tolist(), key=lambda i: self.data[self.start[i] : self.start[i] + self.length[i]].tobytes())

    def _common(self) -> np.ndarray:
        """Bytes that each substring in order has in common with the one before it in its group, 0 for a group's first; bytes are compared, and groups that a collision has misled are sorted again."""
        found = self._neighbours()
        if found is None:
            for g in np.unique(self.group[self.order[self._wrong]]).tolist():
                at = np.flatnonzero(self.group[self.order] == g)
                self.order[at] = self._by_bytes(self.order[at])
            found = self._neighbours()
        return found

    def _neighbours(self) -> np.ndarray | None:
        common, wrong = np.zeros(len(self.order), np.int64), []
        width = int(self.length.max(initial=0))
        follows = np.flatnonzero(np.concatenate(([False], self.group[self.order[1:]] == self.group[self.order[:-1]])))
        for a in range(0, len(follows), SORTED):
            at = follows[a : a + SORTED]
            x, y = self.order[at - 1], self.order[at]
            bx, by = padded(self.data, self.start[x], self.length[x], width + 1), padded(self.data, self.start[y], self.length[y], width + 1)
            short = np.minimum(self.length[x], self.length[y])
            differs = (bx != by) | (np.arange(width + 1) >= short[:, None])
            n = differs.argmax(1)
            common[at] = n
            rows = np.arange(len(at))
            bad = np.where(n < short, bx[rows, n] > by[rows, n], self.length[x] > self.length[y])
            wrong.append(at[bad])
        self._wrong = np.concatenate(wrong) if wrong else np.zeros(0, np.int64)
        return None if len(self._wrong) else common


def covered(data: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, first: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Bits of the strings of each piece, of distinct pieces with first as smallest id, that also stand in a piece of the same group with a smaller id.

    Two strings at the same distance o before their anchors are equal if the left parts agree for o bytes and the right parts for the rest.
    """
    n = len(start)
    right = Suffixes(data, anchor, start + count + width - 1 - anchor, group)
    left = Suffixes(data[::-1], len(data) - anchor, anchor - start, group)
    bits = np.zeros(n, np.uint32)
    before = anchor - start
    for o in range(width - GRAM + 1):
        own = np.flatnonzero((before >= o) & (before - o < count))
        if not len(own):
            continue
        kinds = np.zeros(n, np.int64)
        for side, least in ((left, o), (right, width - o)):
            g = side.group[side.order]
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (side.common[1:] < least)))
            kind = np.empty(n, np.int64)
            kind[side.order] = np.cumsum(new)
            kinds = kinds * (n + 1) + kind
        k = kinds[own]
        order = np.argsort(k, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], k[order][1:] != k[order][:-1])))
        least = np.minimum.reduceat(first[own][order], cuts)
        hit = own[order][np.repeat(least, np.diff(np.append(cuts, len(order)))) < first[own][order]]
        bits[hit] |= np.uint32(1) << (before[hit] - o).astype(np.uint32)
    return bits


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays, all but the last of one length, behind a header of 9 bytes; compressed where that pays, so that a message of one row stays small."""
    raw = b"".join(x.tobytes() for x in arrays)
    small = len(raw) < 1024
    return struct.pack("<II?", len(arrays[0]), len(raw), small) + (raw if small else pa.compress(raw, "zstd", asbytes=True))


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    n, size, small = struct.unpack_from("<II?", blob)
    raw = memoryview(blob)[9:] if small else pa.decompress(memoryview(blob)[9:], size, "zstd", asbytes=True)
    out, at = [], 0
    for i, kind in enumerate(kinds):
        many = n if i < len(kinds) - 1 or len(kinds) == 1 else (size - at) // np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, kind, many, at))
        at += out[-1].nbytes
    return out


def packs_of(docs: DataFrame) -> DataFrame:
    """pack, n_bytes, ids, texts: documents by about PACK bytes, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], names=["pack", "n_bytes", "ids", "texts"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = (text.as_py() or "").encode()
                if ids and size + len(text) > PACK:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield row()

    path = fresh_path(docs.sparkSession, "packs")
    docs.mapInArrow(run, "pack long, n_bytes long, ids array<long>, texts array<binary>").write.option("compression", "zstd").parquet(path)
    out = docs.sparkSession.read.parquet(path)
    out.written_path = path
    return out


class Pack:
    """A pack's distinct texts one after another, with their pieces."""

    def __init__(self, ids: list[int | None], texts: list[bytes], width: int):
        least: dict[bytes, int] = {}
        for i, t in zip(ids, texts):
            i = NO_ID if i is None else i
            least[t] = min(i, least.get(t, NO_ID))
        self.least, self.width = least, width
        self.data = np.frombuffer(b"".join(least), np.uint8)
        self.ends = np.cumsum([len(t) for t in least], dtype=np.int64) if least else np.zeros(0, np.int64)
        self.ids = np.array(list(least.values()), np.int64)
        self.hashes = Hashes(self.data)
        self.start, self.count, self.anchor, key = pieces(self.data, self.ends, width, self.hashes)
        self.key = mixed(key ^ np.uint64(_BASE))  # anchors are the smallest hashes: mixed again, they fill all buckets alike
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.length = self.count + width - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, whether two documents have it, how many distinct pieces) of the pack's anchors, by hash."""
        order = np.argsort(self.key, kind="stable")
        k = self.key[order]
        cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        doc = self.doc[order]
        two = np.minimum.reduceat(doc, cuts) != np.maximum.reduceat(doc, cuts) if len(k) else np.zeros(0, bool)
        whole = mixed(self.hashes.of(self.start, self.length))
        distinct = np.unique(whole, return_index=True)[1]
        return k[cuts], two, np.bincount(np.searchsorted(k[cuts], self.key[distinct]), minlength=len(cuts))


def _bucket_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its rows) of ascending buckets."""
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    for a, z in zip(cuts.tolist(), np.append(cuts, len(bucket))[1:].tolist()):
        yield int(bucket[a]), slice(a, z)


def _row(pack: int, bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"pack": pa.array([pack], pa.int64()), "bucket": pa.array([bucket], pa.int64()), "data": pa.array([blob], pa.binary())})


MESSAGE = "pack long, bucket long, data binary"


def dedup_substrings(docs: DataFrame, width: int = 50, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text as UTF-8: bytes covered by a string of `width` bytes that also starts in a
    document with a smaller id are removed, strings judged on the input. width is from 25 to 55.

    Null and empty texts have no bytes. A null id counts as the largest one, and rows of equal ids never remove each other's bytes,
    so each of several rows without an id stays as it is unless a row with an id holds its strings. Repeated rows give a row each;
    an empty table gives none; other columns play no part.

    Scale: texts are packed by PACK bytes and never move again. Hashes of anchors, 4 bytes for about 15 bytes of text, go
    to buckets in number proportional to the text, and a bit comes back; then the pieces that share an anchor with another document
    go, once for each pack, and a bit for each string comes back. An anchor with many distinct pieces sends single strings by their own hashes, so
    however frequent one is, a bucket gets equal strings once from each pack. What comes back waits in one file a pack in the shared folder.
    """
    assert GRAM < width <= GRAM + 31
    spark = docs.sparkSession
    packs = packs_of(exact_docs(docs, text, key))
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    bits = (max(BUCKETS, -(-total // BUCKET)) - 1).bit_length()
    folder = fresh_path(spark, "suffixes")

    def each(f):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    number = batch.column("pack")[i].as_py()
                    yield from f(number, batch.column("ids")[i].as_py(), batch.column("texts")[i].as_py())
                    trim()

        return run

    def send_anchors(number: int, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        keys, two, distinct = Pack(ids, texts, width).anchors()
        low = (keys >> np.uint64(32 - bits) if bits < 32 else keys).astype(np.uint32)  # 32 bits below those of the bucket: what they confuse only goes further than it had to
        for bucket, rows in _by_bucket(_bucket_of(keys, bits)):
            yield _row(number, bucket, _packed(low[rows], two[rows], np.minimum(distinct[rows], 1 << 15).astype(np.uint16)))

    def screen(rows: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_py(), np.uint32, bool, np.uint16) for x in rows.column("data")]
        sizes = [len(p[0]) for p in parts]
        k, two, n = (np.concatenate(x) for x in zip(*parts))
        kinds, back = np.unique(k, return_inverse=True)
        shared = (np.bincount(back, minlength=len(kinds)) > 1) | (np.bincount(back, two, len(kinds)) > 0)
        many = np.bincount(back, n, len(kinds)) > hot
        flags = (shared.astype(np.uint8) | (many.astype(np.uint8) << 1))[back]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return pa.table({"pack": rows.column("pack"), "bucket": rows.column("bucket"), "data": pa.array([_packed(flags[a:z]) for a, z in zip(cuts, cuts[1:])], pa.binary())})

    def keep(name: str):
        def run(rows: pa.Table) -> pa.Table:
            number = rows.column("pack")[0].as_py()
            put(folder, f"{name}-{number}", dict(zip(rows.column("bucket").to_pylist(), rows.column("data").to_pylist())))
            return pa.table({"pack": pa.array([number], pa.int64())})

        return run

    def deliver(messages: DataFrame, answer, name: str) -> None:
        """Answers to each bucket's messages, kept by pack."""
        messages.groupBy("bucket").applyInArrow(answer, MESSAGE).groupBy("pack").applyInArrow(keep(name), "pack long").agg(F.count("*")).first()

    def send_pieces(number: int, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        pack = Pack(ids, texts, width)
        keys, _, _ = pack.anchors()
        flags, found = np.zeros(len(keys), np.uint8), take(folder, f"flags-{number}") if len(keys) else {}
        for bucket, rows in _by_bucket(_bucket_of(keys, bits)):
            flags[rows] = _unpacked(found[bucket], np.uint8)[0]
        flags = flags[np.searchsorted(keys, pack.key)]
        own = np.flatnonzero(flags & 1)
        many = flags[own] > 1
        start, count, anchor, doc, key = (np.concatenate((x[own[~many]], np.repeat(x[own[many]], pack.count[own[many]]))) for x in (pack.start, pack.count, pack.anchor, pack.doc, pack.key))
        single = slice(int((~many).sum()), None)
        turn = np.arange(len(start[single])) - np.repeat(np.cumsum(pack.count[own[many]]) - pack.count[own[many]], pack.count[own[many]])
        start[single] += turn
        count[single] = 1
        length = count + width - 1
        key[single] = mixed(pack.hashes.of(start[single], width) ^ np.uint64(_BASE))
        whole = mixed(pack.hashes.of(start, length) ^ mixed(key))
        first = alike(pack.data, start, length, whole)
        sent = np.unique(first)
        sent = sent[np.argsort(key[sent], kind="stable")]
        place = np.empty(len(start), np.int64)
        place[sent] = np.arange(len(sent))
        least = np.full(len(sent), NO_ID, np.int64)
        np.minimum.at(least, place[first], pack.ids[doc])
        put(folder, f"sent-{number}", _packed(start, count.astype(np.uint8), place[first].astype(np.int32), pack.ids[doc] > least[place[first]], _bucket_of(key[sent], bits)))
        for bucket, rows in _by_bucket(_bucket_of(key[sent], bits)):
            at = sent[rows]
            yield _row(number, bucket, _packed(key[at], count[at].astype(np.uint8), (anchor[at] - start[at]).astype(np.uint8), least[rows], _together(pack.data, start[at], length[at])))

    def compare(rows: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_py(), np.uint64, np.uint8, np.uint8, np.int64, np.uint8) for x in rows.column("data")]
        sizes = [len(p[0]) for p in parts]
        key, count, before, least, data = (np.concatenate(x) for x in zip(*parts))
        del parts
        count, before = count.astype(np.int64), before.astype(np.int64)
        length = count + width - 1
        start = np.cumsum(length) - length
        bits_of = answers(data, start, count, start + before, least, key, width)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        out = pa.table({"pack": rows.column("pack"), "bucket": rows.column("bucket"), "data": pa.array([_packed(bits_of[a:z]) for a, z in zip(cuts, cuts[1:])], pa.binary())})
        trim()
        return out

    def finish(number: int, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for i, t in zip(ids, texts):
            least[t] = min(NO_ID if i is None else i, least.get(t, NO_ID))
        data, ends = np.frombuffer(b"".join(least), np.uint8), np.cumsum([len(t) for t in least], dtype=np.int64)
        start, count, place, later, buckets = _unpacked(take(folder, f"sent-{number}"), np.int64, np.uint8, np.int32, bool, np.int64)
        marks = np.zeros(len(data) + 1, np.int32)
        if len(start):
            found = take(folder, f"bits-{number}")
            bits_of = np.concatenate([_unpacked(found[b], np.uint32)[0] for b, _ in _by_bucket(buckets)])[place]
            count = count.astype(np.int64)
            every = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
            bits_of = np.where(later, every, bits_of)
            whole, some = bits_of == every, (bits_of != every) & (bits_of > 0)
            np.add.at(marks, start[whole], 1)
            np.add.at(marks, start[whole] + count[whole] + width - 1, -1)
            for i in range(width - GRAM + 1):
                at = start[some & ((bits_of >> np.uint32(i)) & np.uint32(1) > 0)] + i
                np.add.at(marks, at, 1)
                np.add.at(marks, at + width, -1)
        gone = np.cumsum(marks[:-1]) > 0
        known = {}
        for t, a, z in zip(least, np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()):
            g = gone[a:z]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0])
            known[t] = (int(np.count_nonzero(g)), spans, hashlib.sha256(data[a:z][~g].tobytes() if spans else t).hexdigest())
        out = []
        for i, t in zip(ids, texts):
            if len(t) >= width and least[t] < (NO_ID if i is None else i):
                out.append((i, len(t), len(t), 1, hashlib.sha256(b"").hexdigest()))  # a copy within the pack has a smaller id
            else:
                out.append((i, len(t), *known[t]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*out))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    deliver(packs.mapInArrow(each(send_anchors), MESSAGE), screen, "flags")
    forget()
    deliver(packs.mapInArrow(each(send_pieces), MESSAGE), compare, "bits")
    forget()
    out = written(packs.mapInArrow(each(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "kept")
    forget(packs, folders=(folder,))
    return out


def _together(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)
    return data[at]


def answers(data: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, least: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """Bits of the strings of each piece that also stand in a piece with a smaller id; pieces meet those of their key."""
    length = count + width - 1
    whole = np.empty(len(start), np.uint64)
    for a in range(0, len(start), SORTED):
        own = slice(a, a + SORTED)
        whole[own] = Hashes(data[start[a] : start[own][-1] + length[own][-1]]).of(start[own] - start[a], length[own])
    first = alike(data, start, length, mixed(whole ^ mixed(key)))
    distinct = np.unique(first)
    place = np.empty(len(start), np.int64)
    place[distinct] = np.arange(len(distinct))
    smallest = np.full(len(distinct), NO_ID, np.int64)
    np.minimum.at(smallest, place[first], least)
    bits = np.zeros(len(distinct), np.uint32)
    order = distinct[np.argsort(key[distinct], kind="stable")]
    k = key[order]
    cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cuts, len(k)))
    several = np.repeat(sizes, sizes) > 1
    order, k = order[several], k[several]
    edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    ends = np.append(edges, len(k))[1:]
    a = 0
    while a < len(k):
        z = int(ends[min(np.searchsorted(ends, a + SORTED), len(ends) - 1)])  # whole groups, about SORTED pieces
        own = order[a:z]
        text = _together(data, start[own], length[own])
        at = np.cumsum(length[own]) - length[own]
        group = np.cumsum(np.concatenate(([True], k[a:z][1:] != k[a:z][:-1])))
        bits[place[own]] = covered(text, at, count[own], at + anchor[own] - start[own], smallest[place[own]], group, width)
        a = z
    every = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    return np.where(least > smallest[place[first]], every, bits[place[first]])
