"""What a worker holds at once, where it once held copies of all that its group was sent."""

import tracemalloc

import numpy as np
import pandas as pd

from weftline.llm import common, graphs, lm_score


def test_a_partition_of_pairs_is_merged_without_copies_of_all_chunks(tmp_path):
    rng = np.random.default_rng(0)
    words, chunks = np.sort(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)), 60
    rows = []
    for chunk in range(chunks):
        keys = np.unique(rng.integers(0, len(words), 30_000) * len(words) + rng.integers(0, 4, 30_000))
        n = rng.integers(0, 3, len(keys))
        b, w = keys // len(words), keys % len(words)
        rows.append((0, chunk, lm_score.pack(words), lm_score.pack(w.astype(np.uint32)), lm_score.pack(lm_score.steps(b)), lm_score.pack(n.astype(np.uint32)), keys, n))
    frame = pd.DataFrame(rows, columns=["p", "chunk", "names", "word", "before", "counts", "keys", "n"])
    sent = frame.drop(columns=["keys", "n"])
    folder = f"file://{tmp_path}"
    tracemalloc.start()
    out = lm_score.gather(folder, 2)(sent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * chunks * (len(words) + 2 * 30_000)  # the names and pairs of all chunks were held several times over
    pairs = lm_score.Pairs(folder, 0)
    keys, place = np.unique(np.concatenate(frame["keys"].tolist()), return_inverse=True)
    assert (pairs.before * len(words) + pairs.word == keys).all() and pairs.words == len(words)
    assert (pairs.n == np.bincount(place, np.concatenate(frame["n"].tolist()))).all()
    for own, asked in zip(frame["keys"], pairs.asked):
        assert (keys[lm_score.risen(lm_score.unpack(asked, np.uint32))] == own).all()
    assert (np.concatenate([lm_score.unpack(x, np.uint64) for x in out["words"]]) == words).all()


def test_merged_numbers_are_distinct_and_sorted():
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 500, n) for n in (0, 7, 300, 1, 2000, 40)]
    assert (lm_score.merged(lists, most=100) == np.unique(np.concatenate(lists))).all()
    assert len(lm_score.merged([np.empty(0, np.uint64)])) == 0


def test_only_keys_of_filtered_rows_reach_python(spark):
    """The pipeline's near_duplicates: whole rows, texts twice over, went to a worker and back to be filtered by id."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    kept, gone = (graphs.maybe_in(rows, "doc_id", rows.where("doc_id < 20").select("doc_id"), "doc_id", inside=x) for x in (True, False))
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()
    assert {r[0] for r in kept.collect()} >= set(range(20)) and not {r[0] for r in gone.collect()} & set(range(20))
    assert kept.count() + gone.count() == 50


def test_a_worker_lets_go_of_what_another_operator_held():
    common.only(("table",), lambda: bytearray(1 << 20))
    common.let_go()
    assert not common._held
