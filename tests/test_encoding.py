import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.encoding import encoded, mean_pooled


def plain(flat, mask, width, most):
    if flat is None or mask is None:
        return [0.0] * width
    used = [i for i, m in enumerate(mask[:most]) if m]
    return [sum(flat[i * width + j] for i in used) / max(len(used), 1) for j in range(width)]


@pytest.mark.parametrize("most", [1, 4, 256])
def test_pooling_equals_plain_code(spark, most):
    r = random.Random(most)
    rows = [(0, None, None), (1, [], []), (2, [1.0, 2.0, 3.0], [0])]
    for i in range(3, 200):
        n = r.randint(0, 9)
        mask = [r.choice([0, 1, 1]) for _ in range(n)] if i % 2 else [1] * r.randint(0, n) + [0] * n  # padded behind
        rows.append((i, [r.gauss(0, 1) for _ in range(3 * len(mask))], mask))
    df = spark.createDataFrame(rows, "id long, flat array<double>, mask array<int>")
    got = {x["id"]: x["v"] for x in df.repartition(3).select("id", mean_pooled(F.col("flat"), F.col("mask"), 3, most).alias("v")).collect()}
    for i, flat, mask in rows:
        assert got[i] == pytest.approx(plain(flat, mask, 3, most), abs=1e-12)


def test_wrong_width_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1, 1])], "flat array<double>, mask array<int>")
    with pytest.raises(Exception, match="numbers for each"):
        df.select(mean_pooled(F.col("flat"), F.col("mask"), 2)).collect()


def test_texts(spark):
    docs = spark.createDataFrame([(1, "One two a"), (2, None), (3, "one " * 400)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "vec_id long, embedding array<double>")
    got = {x["doc_id"]: x for x in encoded(docs, "doc_id", "text", vectors, "vec_id", "embedding", 2).collect()}
    import hashlib

    at = lambda w: int(hashlib.sha1(w.encode()).hexdigest()[:8], 16) % 7
    assert got[1]["tokens"] == 3 and got[1]["encoding"] == [(at("one") + at("two")) / 2, 1.0]
    assert got[2]["tokens"] == 0 and got[2]["encoding"] == [0.0, 0.0]
    assert got[3]["tokens"] == 256 and got[3]["encoding"] == [float(at("one")), 1.0]


def test_vectors_in_many_files(spark, monkeypatch):
    from weftline.operators import encoding as E

    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(r.randint(0, 30)))) for i in range(300)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i // 2 if i < 4 else i, None if i == 9 else [r.gauss(0, 1), float(i)]) for i in range(50)], "vec_id long, embedding array<float>")
    one = {x["doc_id"]: x for x in encoded(docs, "doc_id", "text", vectors, "vec_id", "embedding", 2).collect()}
    monkeypatch.setattr(E, "BLOCK_BYTES", 64)
    out = encoded(docs.repartition(3), "doc_id", "text", vectors, "vec_id", "embedding", 2)
    got = {x["doc_id"]: x for x in out.collect()}
    assert len(got) == 300 and all(got[i]["tokens"] == one[i]["tokens"] and got[i]["encoding"] == pytest.approx(one[i]["encoding"]) for i in one)
    assert "Exchange" not in encoded(docs, "doc_id", "text", vectors, "vec_id", "embedding", 2)._jdf.queryExecution().executedPlan().toString()
