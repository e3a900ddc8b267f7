import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from weftline.llm import bpe_codec, token_output  # noqa: E402
from weftline.llm.bpe import vocabulary  # noqa: E402
from weftline.llm.token_counts import PrefixCounter, count_tokens  # noqa: E402

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = ["a", "the", "'s", "'re", "'", " ", "  ", "\n", " \n", "é", "ÀB", "1", "²", "中文", "\x1c", "\xa0", "\x85", "...", "<|endoftext|>", "<|startoftext|>", "<|", "Σ", "İ", "é", "😀", "ß", "<|ENDOFTEXT|>", "thinking", "﻿", "\0"]
SCHEMA = "text string, doc_id long, file string, n int"


def texts(n: int) -> list[str]:
    r = random.Random(5)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(n)]


def docs(spark):
    rows = [(t, i) for i, t in enumerate(texts(60))] + [(None, 100), ("", 101), ("same", 102), ("same", 102), ("x" * 30_000, 103), ("word " * 20_000, 104), ("no id", None)]
    return spark.createDataFrame([(t, i, "clash", 1) for t, i in rows], SCHEMA), rows


def test_prefix_counts_are_exact():
    lib, own = Tokenizer.from_file(BYTES), PrefixCounter(BYTES, most=50)
    for t in texts(250):
        want = [len(lib.encode(t[:i]).ids) for i in range(len(t) + 1)]
        assert own.prefixes(t) == want
        for limit in (1, 2, 4):
            total, fits = own.count(pa.array([t]), limit)
            assert total[0] == want[-1] and fits[0] == max(i for i, n in enumerate(want) if n <= limit)


def test_count_query(spark):
    df, rows = docs(spark)
    lib = Tokenizer.from_file(BYTES)
    got = sorted((tuple(r) for r in count_tokens(df, BYTES, 512).drop("fit_chars").collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(lib.encode(t or "").ids), n > 512) for t, i in rows), key=str)
    assert got == want
    assert count_tokens(df.limit(0), BYTES, 512).count() == 0


def test_codec_equals_library(spark):
    df, rows = docs(spark)
    lib = Tokenizer.from_file(WORDS)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for size in (5, 1000):
        got = bpe_codec.encode_decode(df, WORDS, size, keep=("ids", "decoded")).collect()
        want = {}
        for t, i in rows:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want[(i, sha(b"".join(x.to_bytes(4, "little") for x in ids)))] = (len(ids), lib.decode(ids, skip_special_tokens=False), ids)
        assert len(got) == len(rows)
        for r in got:
            n, text, ids = want[(r["doc_id"], r["ids_sha256"])]
            assert (r["n_tokens"], r["decoded"], r["decoded_sha256"], list(r["ids"])) == (n, text, sha(text.encode()), ids)
            assert bpe_codec.decode(ids, WORDS) == text
    assert bpe_codec.encode_decode(df.limit(0), WORDS, 5).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = [w.encode() for w in ("a", "tap", "taps", "top", "tops", "stop", "stops")]
    data = bpe_codec.build_lexicon(words, vocabulary(WORDS).encode_piece)
    (tmp_path / "l").write_bytes(data)
    lexicon = bpe_codec.Lexicon(str(tmp_path / "l"))
    ranks = lexicon.find([*words, b"to", b"tapsx", b"", b"zzzzzzzzzzzz"])
    assert sorted(ranks[:7]) == list(range(7)) and (ranks[7:] == -1).all()
    for w, r in zip(words, ranks):
        assert lexicon.ids[lexicon.offsets[r] : lexicon.offsets[r + 1]].tolist() == vocabulary(WORDS).encode_piece(w)
    assert len(lexicon.final) <= 9  # suffixes are shared


def test_long_pieces_merge_alike():
    v = vocabulary(BYTES)
    r = random.Random(1)
    for _ in range(30):
        piece = "".join(r.choice("abtheion") for _ in range(r.randint(65, 300))).encode()
        slow = [v.first[b] for b in piece]
        while (best := min(((v.rank[k], i) for i in range(len(slow) - 1) if (k := slow[i] << 20 | slow[i + 1]) in v.rank), default=None)) is not None:
            i = best[1]
            slow[i : i + 2] = [v.merged[slow[i] << 20 | slow[i + 1]]]
        assert v.encode_piece(piece) == slow


def test_token_records(spark, tmp_path):
    df, rows = docs(spark)
    lib = Tokenizer.from_file(WORDS)
    files = token_output.write_token_records(df, WORDS, 2, f"file://{tmp_path}")
    got = sorted((tuple(r) for r in token_output.read_token_records(files).collect()), key=lambda x: x[1])
    start, want = 0, []
    for t, i in sorted(rows, key=lambda x: -1 if x[1] is None else x[1]):  # null ids come first
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert got == want
    offsets = token_output.shuffled_offsets(spark, files, 1).collect()
    assert sorted((r["doc_id"] for r in offsets), key=lambda x: -1 if x is None else x) == [w[0] for w in want] != [r["doc_id"] for r in offsets]
    assert token_output.read_token_records(token_output.write_token_records(df.limit(0), WORDS, 2, f"file://{tmp_path}/none")).count() == 0


def test_one_id_of_many_rows_is_split_over_files(spark, tmp_path):
    df = spark.createDataFrame([(f"text {i % 40}", 7 if i % 3 else None) for i in range(600)], "text string, doc_id long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table this small would be one file
    try:
        files = token_output.write_token_records(df, WORDS, 2, f"file://{tmp_path}")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((tuple(r) for r in token_output.read_token_records(files).collect()), key=lambda x: x[1])
    assert files.count() > 2 and len(got) == 600 and [x[0] for x in got] == [None] * 200 + [7] * 400
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_lexicon_takes_the_most_frequent_pieces(spark):
    df = spark.createDataFrame([("a " * 50 + "b " * 40 + "c " * 3 + "d " * 3 + "e", i) for i in range(4)], "text string, doc_id long")
    name = bpe_codec.compile_lexicon(df, WORDS, 3)
    from pyspark import SparkFiles

    lexicon = bpe_codec.Lexicon(SparkFiles.get(name))
    assert (lexicon.find([b"a", b"b"]) >= 0).all() and (lexicon.find([b"c", b"d", b"e"]) == -1).all()  # c and d are as frequent: there is room for one


def test_broken_records_are_found(tmp_path):
    import io

    import numpy as np

    data = token_output.frame(7, np.array([1, 2, 3]), 2)
    assert next(token_output.read_records(io.BytesIO(data)))[1].tolist() == [1, 2, 3]
    for i in range(len(data)):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            list(token_output.read_records(io.BytesIO(bytes(broken))))


def test_texts_of_ids_are_joined_at_once():
    tokens = ["a", "", "né", "日本</w>"]
    ids, ends = np.array([3, 0, 2, 1, 1, 0], np.int32), [0, 0, 3, 4, 4, 6, 6]
    got = [str(x, "utf-8") for x in bpe_codec.joined(bpe_codec.spaced(tokens), ids, ends)]
    assert got == [" ".join(tokens[i] for i in ids[a:b]) for a, b in zip(ends, ends[1:])]
    assert bpe_codec.joined(bpe_codec.spaced(tokens), ids[:0], [0, 0, 0]) == [b"", b""]
