"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

A record file holds, for each document in ascending doc_id order,

    length     8 bytes, little-endian unsigned: bytes of the payload
    mask(crc)  4 bytes: masked CRC-32 of the length field
    payload    whether there is a doc_id (1 byte), doc_id (8 bytes, signed), width (1 byte: 2 or 4), then the ids, little-endian of that width
    mask(crc)  4 bytes: masked CRC-32 of the payload

and its index file holds one little-endian (has doc_id, doc_id, byte offset, first token, tokens) of five signed 64-bit numbers per
record, so that a reader can shuffle records without touching the record file. mask(c) rotates c right by 15 bits
and adds a constant, so that checksums of data which itself holds checksums stay sound.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_doc, filesystem, fresh_path, only, slices
from .text_units import UNITS, WordEncoder, library

#: Added to a rotated checksum; the constant of the common record format.
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<?qB")
INDEX = np.dtype([("has_id", "<i8"), ("doc_id", "<i8"), ("offset", "<i8"), ("start", "<i8"), ("n_tokens", "<i8")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = BODY.pack(doc_id is not None, doc_id or 0, width) + ids.astype("<u2" if width == 2 else "<u4").tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_records(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record of a file, every length and payload checked."""
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError("record file ends within a length field")
        size, check = HEAD.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError("checksum of a length field doesn't hold")
        body = stream.read(size + 4)
        if len(body) < size + 4 or masked(body[:size]) != int.from_bytes(body[size:], "little"):
            raise ValueError("checksum of a record doesn't hold")
        has_id, doc_id, width = BODY.unpack_from(body)
        yield doc_id if has_id else None, np.frombuffer(body, "<u2" if width == 2 else "<u4", offset=BODY.size, count=(size - BODY.size) // width).astype(np.uint32)


def library_encoder(path: str) -> WordEncoder:
    return only(("library", path), lambda: _library_encoder(path))


def _library_encoder(path: str) -> WordEncoder:
    """Ids by the tokenizers library: distinct pieces are encoded many at a time, split at the ends of words."""
    tok = library(path)
    vocab = tok.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def pieces(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for i in range(0, len(new), 256):
            group = new[i : i + 256]
            ids = np.asarray(tok.encode(" ".join(group), add_special_tokens=False).ids, np.int32)
            at = np.flatnonzero(ends[ids])
            if len(at) != len(group):  # a piece that the library cuts further
                each = [x.ids for x in tok.encode_batch_fast(group, add_special_tokens=False)]
                ids, size = np.asarray([i for x in each for i in x], np.int32), np.asarray([len(x) for x in each])
            else:
                size = np.diff(at, prepend=-1)
            flat.append(ids)
            sizes.append(size)
        return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.empty(0, np.int32), np.empty(0, np.int32))

    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    odd = lambda w: [t.id for piece, _ in tok.pre_tokenizer.pre_tokenize_str(w) for t in tok.model.tokenize(piece)]
    return WordEncoder(path, special, pieces, odd)


def write_token_records(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text, append end_id, write record and index files; return one row per file in doc_id order.

    Rows: file, index, first_doc, n_docs, n_tokens, start (ids of all files before). Null and empty texts give the end id
    alone; very long ones are one record; rows with an equal doc_id stay separate records, in the order of a hash of their texts; rows with
    a null doc_id come first; an empty table writes no file; other columns play no part.

    Scale: one range shuffle by doc_id and that hash, so an id with many rows is split too; then each task writes its own file and index as it
    goes, and sends back one small row per file. A task
    writes under a name of its own and renames it when whole, so a lost or doubled task leaves no half file in the list.
    """
    spark = docs.sparkSession
    out = out or fresh_path(spark, "token-records")
    store, root = filesystem(out)
    store.create_dir(root, recursive=True)
    # out of range of a 2-byte width only if the vocabulary is
    from .bpe import vocabulary

    width = 2 if max(len(vocabulary(tokenizer).tokens), end_id + 1) <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        store, root = filesystem(out)
        name, stream, index, first, docs_, offset, start = f"{root}/{uuid.uuid4().hex}", None, None, None, 0, 0, 0
        for batch in batches:
            for part in slices(batch, "text", UNITS):
                flat, sizes = encoder.encode(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                if stream is None:
                    stream, index = store.open_output_stream(f"{name}.tmp"), store.open_output_stream(f"{name}.idx")
                    first = ids[0], part.column("hash")[0].as_py()
                at, records, rows = 0, [], np.zeros(len(ids), INDEX)
                for i, (doc_id, n) in enumerate(zip(ids, sizes.tolist())):
                    record = frame(doc_id, np.append(flat[at : at + n], end_id), width)
                    at += n
                    rows[i] = doc_id is not None, doc_id or 0, offset, start, n + 1
                    offset, start = offset + len(record), start + n + 1
                    records.append(record)
                stream.write(b"".join(records))
                index.write(rows.tobytes())
                docs_ += len(ids)
        if stream is not None:
            stream.close()
            index.close()
            store.move(f"{name}.tmp", f"{name}.rec")
            yield pa.RecordBatch.from_pydict({"name": pa.array([name.rpartition("/")[2]]), "first_doc": pa.array([first[0]], pa.int64()), "hash": pa.array([first[1]], pa.int64()), "n_docs": pa.array([docs_], pa.int64()), "n_tokens": pa.array([start], pa.int64())})

    keyed = by_doc(docs, text, key).withColumn("hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    files = ordered.mapInArrow(write, "name string, first_doc long, hash long, n_docs long, n_tokens long").collect()  # a row per file
    start, rows = 0, []
    for f in sorted(files, key=lambda f: (f["first_doc"] is not None, f["first_doc"], f["hash"]) if f["first_doc"] is not None else (False, 0, f["hash"])):
        rows.append((f"{out}/{f['name']}.rec", f"{out}/{f['name']}.idx", f["first_doc"], f["n_docs"], f["n_tokens"], start))
        start += f["n_tokens"]
    return spark.createDataFrame(rows, "file string, index string, first_doc long, n_docs long, n_tokens long, start long")


#: Records whose index rows are held at once.
READ = 10_000


def _index_rows(stream) -> Iterator[np.ndarray]:
    while data := stream.read(READ * INDEX.itemsize):
        yield np.frombuffer(data, INDEX)


def read_token_records(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record of the files that write_token_records() lists, checked against the index.

    A record whose checksums don't hold, or that differs from its index row, ends the query with an error. No files give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = filesystem(row["file"])
                with store.open_input_stream(filesystem(row["index"])[1]) as index, store.open_input_stream(path, buffer_size=1 << 20) as f:
                    records = read_records(f)
                    for part in _index_rows(index):
                        found = []
                        for at in part.tolist():
                            doc_id, ids = next(records, (None, np.empty(0)))
                            if (at[0] == 1, at[4]) != (doc_id is not None, len(ids)) or at[1] != (doc_id or 0):
                                raise ValueError("index and records differ")
                            found.append((doc_id, row["start"] + at[3], len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    if next(records, None) is not None:
                        raise ValueError("index and records differ")

    n = max(1, files.count())
    return files.select("file", "index", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shuffled_offsets(spark: SparkSession, files: DataFrame, seed: int) -> DataFrame:
    """(file, doc_id, offset, start, n_tokens) of every record in a seeded random order, from the index files alone.

    Null ids, repeated ids and empty texts have rows as all records have; no files give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = filesystem(row["index"])
                with store.open_input_stream(path) as f:
                    for part in _index_rows(f):
                        ids = pa.array(part["doc_id"].copy(), mask=part["has_id"] == 0)
                        yield pa.RecordBatch.from_pydict({"file": pa.array([row["file"]] * len(part)), "doc_id": ids, "offset": part["offset"].copy(), "start": part["start"] + row["start"], "n_tokens": part["n_tokens"].copy()})

    return files.select("file", "index", "start").mapInArrow(read, "file string, doc_id long, offset long, start long, n_tokens long").orderBy(F.xxhash64("file", "offset", F.lit(seed)))
