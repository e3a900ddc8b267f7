from pyspark.sql import functions as F

from weftline.operators import features as E


def test_terms(spark):
    df = spark.createDataFrame([("The cat sat a", ), (None,), ("one",)], "t string")
    rows = df.select(E.word_terms("t").alias("w"), E.word_terms("t", 3).alias("x"), E.char_terms("t").alias("c")).collect()
    assert rows[0]["w"] == ["the", "cat", "sat", "the cat", "cat sat"]
    assert rows[0]["x"][-1] == "the cat sat"
    assert rows[1]["w"] == [] == rows[1]["c"] and rows[2]["w"] == ["one"]
    assert rows[2]["c"] == [" on", "one", "ne ", " one", "one ", " one "]
    assert " a " in rows[0]["c"]


def test_tfidf_has_unit_length(spark):
    df = spark.createDataFrame([(i, f"common word{i % 3} word{i % 5}") for i in range(30)], "id long, t string")
    w = E.tfidf(df, "id", E.word_terms("t", 1), max_df=0.9)
    assert w.where("term = 'common'").count() == 0
    assert all(abs(r["s"] - 1) < 1e-9 for r in w.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect())


def test_text_block(spark):
    df = spark.createDataFrame([(f"alpha beta{i % 2}",) for i in range(10)], "t string")
    model, weigh = E.text_block(df, "t", 100)
    out = weigh.transform(model.transform(df.withColumn("t_terms", E.word_terms("t")))).first()["t_w"]
    assert abs(out.norm(2) - 1) < 1e-9


def test_tfidf_shuffles_no_rows(spark, monkeypatch):
    import math
    from collections import Counter, defaultdict

    rows = [(i // 2 if i < 6 else None if i == 7 else i, " ".join(f"w{(i * j) % 17}" for j in range(i % 11))) for i in range(90)]
    df = spark.createDataFrame([*rows, (500, None)], "id long, t string")
    tf = defaultdict(Counter)
    for i, t in rows:
        tf[i].update(t.split() + [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:])])
    freq = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(92 / (1 + n)) + 1 for w, n in freq.items() if 3 <= n <= 0.6 * 91}
    want = {}
    for i, c in tf.items():
        own = {w: (1 + math.log(n)) * idf[w] for w, n in c.items() if w in idf}
        want |= {(i, w): x / math.sqrt(sum(y * y for y in own.values())) for w, x in own.items()}
    for pack, size in ((1 << 22, 32 << 20), (40, 60)):
        monkeypatch.setattr(E, "PACK", pack)
        monkeypatch.setattr(E, "BLOCK_BYTES", size)
        out = E.tfidf(df.repartition(3), "id", E.word_terms("t"))
        got = {(r["id"], r["term"]): r["weight"] for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    once = E.tfidf(df.where("id > 7"), "id", E.word_terms("t"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
