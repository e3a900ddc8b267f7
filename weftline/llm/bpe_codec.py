"""BPE encoding and decoding over a lexicon compiled into a minimal acyclic transducer.

Frequent pieces and their ids are compiled into an automaton whose equal suffixes are shared. Each transition holds a
number; the numbers along a piece's path add up to its rank among the lexicon's pieces, and the rank points to its ids in one
flat array. The whole is one file of flat arrays that workers memory-map. Pieces that it doesn't have are merged exactly.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols, vocabulary
from .common import by_doc, forget, fresh_path, only, slices, trim, write_bytes, written
from .text_units import ODD, UNITS, WordEncoder, library, word_pieces, word_units

MAGIC = b"LEXICON1"


def build_lexicon(words: Iterable[bytes], ids_of) -> bytes:
    """The file of the minimal transducer of the words, which are sorted here; ids_of(word) gives the ids."""
    register: dict[tuple, int] = {}
    states: list[list] = [[False, {}]]  # final, {byte: state}
    path, before, kept = [0], b"", []

    def minimize(down_to: int) -> None:
        while len(path) - 1 > down_to:
            child = path.pop()
            parent, b = path[-1], before[len(path) - 1]
            key = (states[child][0], tuple(states[child][1].items()))
            if (same := register.setdefault(key, child)) != child:
                states[parent][1][b] = same
                states[child] = None  # nothing else leads there

    for word in sorted(set(words)):
        kept.append(word)
        same = len(os.path.commonprefix((word, before)))
        minimize(same)
        before = word
        for b in word[same:]:
            states.append([False, {}])
            states[path[-1]][1][b] = len(states) - 1
            path.append(len(states) - 1)
        states[path[-1]][0] = True
    minimize(0)

    order: list[int] = []  # children before parents
    done, stack = set(), [(0, False)]
    while stack:
        s, ready = stack.pop()
        if ready:
            order.append(s)
        elif s not in done:
            done.add(s)
            stack.append((s, True))
            stack += [(t, False) for t in states[s][1].values() if t not in done]
    number = {s: i for i, s in enumerate(reversed(order))}  # the root is 0
    below: dict[int, int] = {}
    rows = []
    for s in order:
        total = int(states[s][0])
        for b, t in sorted(states[s][1].items()):
            rows.append((number[s] << 8 | b, number[t], total))
            total += below[t]
        below[s] = total
    rows.sort()
    final = np.zeros(max(1, len(number)), np.uint8)
    final[[number[s] for s in order if states[s][0]]] = 1
    ids = [ids_of(w) for w in kept]
    arrays = [
        np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32), final,
        np.cumsum([0, *map(len, ids)]).astype(np.int64), np.array([i for x in ids for i in x], np.int32), np.array([max(map(len, kept), default=0)], np.int64),
    ]
    head, at, body = [], 8 + 8 * len(arrays) * 2, []
    for a in arrays:
        at += -at % 8
        head += [at, len(a)]
        body.append((at, a.tobytes()))
        at += a.nbytes
    out = bytearray(at)
    out[:8] = MAGIC
    struct.pack_into(f"<{len(head)}q", out, 8, *head)
    for where, data in body:
        out[where : where + len(data)] = data
    return bytes(out)


class Lexicon:
    """A memory-mapped lexicon file; find() walks all words at once, byte by byte."""

    KINDS = (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32, np.int64)

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        head = np.frombuffer(data[8 : 8 + 16 * len(self.KINDS)], np.int64)
        views = [np.frombuffer(data, k, count=int(n), offset=int(at)) for k, at, n in zip(self.KINDS, head[::2], head[1::2])]
        self.keys, self.targets, self.adds, self.final, self.offsets, self.ids, longest = views
        self.longest = int(longest[0])

    def find(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words that the lexicon doesn't have."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        rank = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((sizes <= self.longest) & (sizes > 0))
        if not len(live) or not len(self.keys):
            return rank
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i in range(self.longest):
            ended = live[sizes[live] == i]
            won = ended[self.final[state[ended]] == 1]
            rank[won] = total[won]
            live = live[sizes[live] > i]
            if not len(live):
                return rank
            key = state[live] << 8 | data[starts[live] + i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.targets[at]
            total[live] += self.adds[at]
        won = live[self.final[state[live]] == 1]
        rank[won] = total[won]
        return rank


def codec_encoder(tokenizer: str, lexicon: str) -> WordEncoder:
    return only(("codec", tokenizer, lexicon), lambda: _codec_encoder(tokenizer, lexicon))


def _codec_encoder(tokenizer: str, lexicon: str) -> WordEncoder:
    vocab, known = vocabulary(tokenizer), Lexicon(lexicon)
    back = {c: b for b, c in enumerate(byte_symbols())}

    def pieces(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [p.encode() for p in new]
        ranks = known.find(words)
        merged = {i: vocab.encode_piece(words[i]) for i in np.flatnonzero(ranks < 0).tolist()}
        offsets, ids = known.offsets, known.ids
        lists = [merged[i] if r < 0 else ids[offsets[r] : offsets[r + 1]].tolist() for i, r in enumerate(ranks.tolist())]
        return np.array([i for x in lists for i in x], np.int32), np.fromiter(map(len, lists), np.int32, len(lists))

    def odd(word: str) -> list[int]:
        """The library's own rules of characters cut the word; the merges are ours."""
        return [i for p, _ in library(tokenizer).pre_tokenizer.pre_tokenize_str(word) for i in vocab.encode_piece(bytes(back[c] for c in p))]

    return WordEncoder(tokenizer, vocab.special, pieces, odd)


def piece_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(piece, n): how often each piece occurs in all whole texts; odd words count as one piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = vocabulary(tokenizer).special
        for batch in batches:
            for part in slices(batch, "text", UNITS):
                counts = word_units(part.column("text"), tokenizer, special).flatten().value_counts()
                words, n = counts.field("values").to_pylist(), counts.field("counts").to_pylist()
                lists = [[] if ODD.search(w) else word_pieces(w) for w in words]
                flat = pa.array([p for x in lists for p in x], pa.string()).dictionary_encode()
                sums = np.bincount(flat.indices.to_numpy(), np.repeat(n, [len(x) for x in lists]), len(flat.dictionary)) if len(flat) else []
                yield pa.RecordBatch.from_arrays([flat.dictionary, pa.array(np.asarray(sums).astype(np.int64))], names=["piece", "n"])

    return by_doc(docs).select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


#: Steps of a doubling by which counts are told apart where the lexicon ends.
STEPS = 16


def compile_lexicon(docs: DataFrame, tokenizer: str, size: int) -> str:
    """Compile the most frequent pieces of all texts, `size` at most, and send the file to all executors; return its name.

    How many pieces have about which count is one small aggregate (a row for each step of a STEPS-th of a doubling). It tells from which step on
    the pieces are no more than `size`, and only these come to the driver.
    """
    spark, vocab = docs.sparkSession, vocabulary(tokenizer)
    counts = written(piece_counts(docs, tokenizer).where("n > 1").select("piece", F.floor(F.log2("n") * STEPS).alias("step")), "pieces")
    room, least = size, None
    for row in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # 64 * STEPS rows at most
        if row["count"] > room:
            break
        room, least = room - row["count"], row["step"]
    top = counts.where(F.col("step") >= least).select("piece").collect() if least is not None else []  # `size` rows at most
    forget(counts)
    path = fresh_path(spark, "lexicon") + ".bin"  # a session keeps one path per name
    write_bytes(spark, path, build_lexicon((r["piece"].encode() for r in top), vocab.encode_piece))
    spark.sparkContext.addFile(path)
    del top
    trim()
    return path.rpartition("/")[2]


def spaced(tokens: list[str]) -> pa.Array:
    return pa.array([f"{t} " for t in tokens], pa.large_string())


def joined(tokens: pa.Array, ids: np.ndarray, ends: list[int]) -> list[memoryview]:
    """UTF-8 of the spaced() tokens of each text's ids, whose places are given by ends (0 first), with single spaces between: all are put together at once."""
    found = tokens.take(pa.array(ids))
    data = memoryview(found.buffers()[2] or b"")
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset :] if len(found) else np.zeros(1, np.int64)
    at = offsets[np.asarray(ends)].tolist()
    return [data[a : max(a, b - 1)] for a, b in zip(at, at[1:])]


def encode_decode(docs: DataFrame, tokenizer: str, lexicon_size: int = 1 << 15, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per input row; `keep` adds "ids" (array<int>), "decoded" (string) or both.

    Ids are those of the tokenizer file for the whole text, special strings in it included, without added ones; the decoded
    text is the tokens put together with spaces, as the file names no decoder. Null texts are empty: no ids, an empty decoded
    text. Repeated rows give repeated results; an empty table gives no rows (and an empty lexicon); other columns play no part.

    Scale: pass one counts pieces (partial sums before the only shuffle); the lexicon is bounded by `lexicon_size`, a matter of
    speed alone, as other pieces are merged exactly. Pass two is a map over the scan, 8 MB of text at a time.
    """
    name = compile_lexicon(docs, tokenizer, lexicon_size)
    more = "".join(f", {x} {kind}" for x, kind in (("ids", "array<int>"), ("decoded", "string")) if x in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec_encoder(tokenizer, SparkFiles.get(name))
        tokens = spaced(vocabulary(tokenizer).tokens)
        for batch in batches:
            for part in slices(batch, "text", UNITS):
                flat, sizes = encoder.encode(part.column("text"))
                ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).tolist()
                raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
                shas = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:])]
                parts = joined(tokens, flat, ends)
                texts = [hashlib.sha256(x).hexdigest() for x in parts]
                lists = [flat[a:b] for a, b in zip(ends, ends[1:])] if "ids" in keep else []
                decoded = [str(x, "utf-8") for x in parts] if "decoded" in keep else []
                columns = [part.column("doc_id"), pa.array(sizes), pa.array(shas), pa.array(texts)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                for name_, kept in (("ids", pa.array(lists, pa.list_(pa.int32()))), ("decoded", pa.array(decoded, pa.string()))):
                    if name_ in keep:
                        columns, names = [*columns, kept], [*names, name_]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return by_doc(docs).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def decode(ids: Iterable[int], tokenizer: str) -> str:
    """Text of ids, special tokens kept; ids without a token are skipped."""
    tokens = vocabulary(tokenizer).tokens
    return " ".join(tokens[i] for i in ids if 0 <= i < len(tokens))
