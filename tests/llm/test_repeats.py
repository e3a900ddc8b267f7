import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from weftline.llm import hard_negatives, periodic_runs, suffix_dedup

EXTRA = "text string, doc_id long, own string, pack int, bucket int, Text string, data binary, DOC_ID int"


def frame(spark, rows):
    return spark.createDataFrame([(t, i, "x", 1, 2, "y", b"z", 4) for i, t in rows], EXTRA)


# ---- substrings that earlier documents hold


def brute_kept(rows, width):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - width + 1):
            w = b[a : a + width]
            first[w] = min(first.get(w, 1 << 70), 1 << 70 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for a in range(len(b) - width + 1):
            if first[b[a : a + width]] < (1 << 70 if i is None else i):
                gone[a : a + width] = [True] * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [word(k) for k in (30, 49, 50, 51, 75, 120, 400)]
    rows = [(None, passages[4]), (None, None), (3, None), (4, ""), (5, "a" * 300), (6, "b" + "a" * 120 + "b"), (7, "ab" * 90), (8, "x" + "ab" * 40), (9, word(2000))]
    for i in range(10, 60):
        rows.append((i, "".join(r.choice(passages) if r.random() < 0.5 else word(r.randint(1, 90)) for _ in range(r.randint(1, 6)))))
    near = word(600)
    for i in range(60, 90):
        k = r.randrange(600)
        rows.append((i, near[:k] + r.choice("xyz") + near[k + 1 :]))
    rows += [(15, rows[20][1]), rows[12], (None, rows[30][1]), (2, rows[70][1]), (91, rows[70][1] + "tail")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, hot", [(50, 4096), (50, 1), (26, 2), (55, 0)])
def test_dedup_substrings(spark, width, hot):
    rows = corpus(width)
    got = suffix_dedup.dedup_substrings(frame(spark, rows).repartition(3), width, hot=hot)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_kept(rows, width)


def test_dedup_empty(spark):
    df = frame(spark, [(1, "a" * 60)])
    assert suffix_dedup.dedup_substrings(df.limit(0)).count() == 0
    assert [tuple(x)[1:4] for x in suffix_dedup.dedup_substrings(df).collect()] == [(60, 0, 0)]


def test_suffixes_in_order_in_spite_of_collisions():
    one = "a"
    for _ in range(11):  # Thue-Morse words collide modulo 2^64 whatever the base is
        one += one.translate({97: 98, 98: 97})
    other = one.translate({97: 98, 98: 97})
    r = random.Random(4)
    parts = [one.encode(), other.encode(), b"", one[:1500].encode()] + [bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(300)]
    group = np.array([0] * 4 + [r.randint(0, 5) for _ in range(300)])
    length = np.array([len(p) for p in parts])
    found = suffix_dedup.Suffixes(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length, group)
    assert [(int(group[i]), parts[i]) for i in found.order] == sorted((int(g), p) for g, p in zip(group, parts))
    for k in range(1, len(parts)):
        x, y = (parts[found.order[j]] for j in (k - 1, k))
        same = next((n for n, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert found.common[k] == (same if group[found.order[k]] == group[found.order[k - 1]] else 0)


def test_pieces_hold_every_string_once():
    r = random.Random(2)
    for seed in range(20):
        texts = [bytes(r.choice(b"ab" if seed % 2 else b"abcdefgh") for _ in range(r.choice([0, 10, 49, 50, 51, 200, 3000]))) for _ in range(8)]
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        start, count, anchor, _ = suffix_dedup.pieces(data, ends, 50, suffix_dedup.Hashes(data))
        got = sorted(int(s) + k for s, n in zip(start, count) for k in range(n))
        assert got == [a + k for a, t in zip(ends - [len(t) for t in texts], texts) for k in range(len(t) - 49)]
        assert ((anchor >= start + count - 1) & (anchor - start <= 26)).all() and count.max(initial=0) <= 27
        at = {}
        for s, n, p in zip(start.tolist(), count.tolist(), anchor.tolist()):
            for k in range(s, s + n):
                assert at.setdefault(data[k : k + 50].tobytes(), p - k) == p - k  # the place of the anchor depends on the string alone


# ---- runs


def brute_runs(w):
    out = []
    n = len(w)
    for q in range(1, n // 4 + 1):
        a = 0
        while a + q < n:
            if w[a] != w[a + q]:
                a += 1
                continue
            z = a
            while z + q < n and w[z] == w[z + q]:
                z += 1
            if z - a + q >= max(6, 4 * q) and not any(all(w[i] == w[i + d] for i in range(a, z + q - d)) for d in range(1, q)):
                out.append((a, z - a + q, q))
            a = z
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_row(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n, old = h // 10, len(w), list(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [old[k] if k < a else old[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), digest("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()), digest(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def periodic_texts(seed):
    r = random.Random(seed)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a a a\x1fa", "a " * 200, "a b " * 100 + "a", "a a b " * 60 + "a a b b " * 40, ("a " * 9 + "b ") * 12]
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    out.append(" ".join(fib[-1]))
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 5)):
            unit = [r.choice("abcdef") for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 16, 31, 33]))]
            many = r.randint(1, 9) * len(unit) + r.randrange(len(unit))
            words += (unit * 10)[:many] + [r.choice("abxyz") for _ in range(r.randint(0, 12))]
        out.append(r.choice([" ", "\n", " \x0b"]).join(words))
    return out


def test_periodic_runs(spark):
    texts = periodic_texts(1)
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, texts[8]), (None, None), (7, texts[9]), (7, texts[9]), (-4, texts[10])]
    got = periodic_runs.periodic_runs(frame(spark, rows).repartition(3)).collect()
    assert sorted((tuple(x) for x in got), key=str) == sorted((brute_row(i, t) for i, t in rows), key=str)
    assert sum(x["n_runs"] > 0 for x in got) > 100
    assert periodic_runs.periodic_runs(frame(spark, rows).limit(0)).count() == 0


def test_one_long_text():
    x = np.zeros(60_000, np.int64)
    x[40_000:] = np.arange(20_000) % 5000
    assert periodic_runs.find_runs(x, sorted(periodic_runs.stretches(periodic_runs.since_last(x, x * 0)))) == [(0, 40_001, 1), (40_000, 20_000, 5000)]


# ---- hard negatives


def brute_negatives(rows, every=100):
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or x != x or abs(x * 256) == float("inf") for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for i, label, v in kept:
        if i % every:
            continue
        scores = [(sum(a * b for a, b in zip(v, u)), j, m) for j, m, u in kept if j != i and len(u) == len(v)]
        best = sorted(((s, j) for s, j, m in scores if m == label), key=lambda x: (-x[0], x[1]))[:5]
        for s, j in best:
            near = sorted(((t, k) for t, k, m in scores if m != label and 30 * s <= 100 * t <= 90 * s), key=lambda x: (-x[0], x[1]))[:10]
            out += [(i, j, n + 1, k, s, t) for n, (t, k) in enumerate(near)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(v, i, m, 1, 2, "x", 5) for i, m, v in rows], "embedding array<double>, vec_id long, label int, rank int, block int, Label string, VEC_ID int")


def test_hard_negatives(spark):
    r = random.Random(3)
    rows = [(i, r.randint(0, 9), [r.gauss(0, 1) for _ in range(6)]) for i in range(900)]
    common = [0.5, 0.25, -1.0, 0.75, 2.0, 1.0]
    rows += [(i, r.randint(0, 3), common) for i in range(900, 1400)]
    rows += [(1500, 1, [0.0] * 6), (1600, None, common), (1601, 2, None), (1602, 2, [None] + common[1:]), (1603, 2, [float("nan")] * 6), (1604, 2, [float("inf")] * 6), (None, 1, common), (1700, 3, [1e307] * 6)]
    rows += [(2000 + i, i % 3, [float(i), 1.5, 2.5]) for i in range(0, 400)] + [(5000, 1, []), (5001, 2, []), (5002, 1, [])]
    got = hard_negatives.hard_negatives(vectors(spark, rows).repartition(5))
    assert sorted(tuple(x) for x in got.collect()) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(vectors(spark, rows).limit(0)).count() == 0


def test_hard_negatives_beyond_doubles(spark):
    r = random.Random(5)
    rows = [(50 * i, i % 2, [r.randint(1, 1 << 21) + 0.0 for _ in range(5)]) for i in range(40)]
    got = hard_negatives.hard_negatives(vectors(spark, rows))
    want = brute_negatives(rows)
    assert max(x[4] for x in want) > 1 << 53
    assert sorted(tuple(x) for x in got.collect()) == want


def test_repeated_vectors_count_each(spark):
    rows = [(100, 1, [1.0, 1.0])] + [(101, 1, [1.0, 0.5])] * 3 + [(103, 2, [0.5, 0.5])] * 2
    got = collections.Counter(tuple(x) for x in hard_negatives.hard_negatives(vectors(spark, rows)).collect())
    s, t = 256 * 256 + 256 * 128, 2 * 256 * 128
    assert got == {(100, 101, 1, 103, s, t): 3, (100, 101, 2, 103, s, t): 3}
