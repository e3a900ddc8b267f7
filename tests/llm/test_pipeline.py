import random

import corpus_pipeline
from tests.llm.test_text_ops import brute_components
from weftline.llm import quality


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(1)
    good = lambda n: " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(300)}" for _ in range(n)) + "."
    bad = lambda n: " ".join(r.choice(["BUY!!", "NOW!!", "PILLS###"]) + str(r.randrange(300)) for _ in range(n))
    item = good(25)
    rows = [(i, bad(50) if i % 4 == 0 else good(50)) for i in range(160)]
    rows += [(200 + i, rows[1][1] + (" extra" if i else "")) for i in range(3)] + [(300, good(10) + " " + item.upper() + " " + good(10)), (301, item)]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    kept = {x["doc_id"] for x in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    left = [(i, t) for i, t in rows if i in kept]
    want = {i for i, _, c in brute_components(left, 5, 4, 5) if i == c} - {300, 301}
    out = corpus_pipeline.run(spark, path).collect()
    assert {x["doc_id"] for x in out} == want and len(out) == len(want)
    assert {1} == want & {1, 200, 201, 202} and not any(i % 4 == 0 for i in want if i < 160)

    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, path)
        assert stage.columns == docs.columns, name


def test_stages_of_null_empty_long_repeated_and_clashing_rows(spark, tmp_path):
    path = str(tmp_path)
    good = lambda i: "a good text " + " ".join(f"{'bcdfghklmnprst'[(i * 5 + j * j) % 14]}{'aeiou'[(i + j) % 5]}{i * 17 + j}" for j in range(16))
    long = " ".join(f"long{i % 7919}" for i in range(120_000)) + " good text"
    rows = [(i, good(i) if i % 4 else "BUY!! NOW!! PILLS###" + str(i)) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \n "), (None, good(200)), (None, good(1)), (5, good(5)), (5, good(300)), (103, long), (104, long)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, c long, stays boolean, item_id string"
    docs = spark.createDataFrame([(i, t, None, "s", None, 1, True, "x") for i, t in rows], schema)
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(80)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, good(7)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    empty, kept = docs.limit(0), docs
    for name, stage in corpus_pipeline.STAGES:
        empty, kept = (stage(spark, x, path) for x in (empty, kept))
        kept.write.parquet(f"{path}/{name}")
        kept = spark.read.parquet(f"{path}/{name}")
        assert empty.count() == 0, name
        if name != "tokenize":
            assert kept.columns == docs.columns, name
        if name == "near_duplicates":
            ids = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["text"]) for x in kept.where("length(trim(text)) > 2").collect())
            # the null id's copy of 1 goes, its own text stays; of 103 and 104 the first stays; both texts of 5 stay once
            assert [i for i, t in ids if t == long] == [103] and (-1, good(200)) in ids and (-1, good(1)) not in ids
            assert [i for i, t in ids if t in (good(5), good(300))] == [5, 5]
    out = kept.collect()
    assert 7 not in {x["doc_id"] for x in out} and {x["doc_id"] for x in out} >= {1, 2, 5, 103, None}
    assert all(x["n_tokens"] == len(x["ids"]) for x in out) and max(x["n_tokens"] for x in out) > 120_000
