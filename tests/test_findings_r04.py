"""Cases of the findings of round 4 that existing tests didn't meet."""

import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from weftline import queries as Q
from weftline.operators import features as E
from weftline.plans import cleaning
from weftline.plans.views import raw_postings


def documents(spark, tmp_path, texts):
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def by_sql(name, d):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    return sorted(con.execute(Q.oracle_sql()[name]).fetchall(), key=repr)


def test_only_stated_pay_is_counted(spark, tmp_path):
    """amounts of the documents' own texts, and words of pay at their ends, made other rows count."""
    d = documents(spark, tmp_path, ["die&&& 0759539412582376$$$ den", "a $5", "b 3 tr", "un unetre", "0759539412582376$$$", "c", None, "lương 5 triệu"])
    assert sorted(map(tuple, Q.queries()["prj_resolve"](spark, d).collect()), key=repr) == by_sql("prj_resolve", d)


@pytest.mark.parametrize("name", ["fn_mask_salary", "fn_is_pay"])
def test_words_of_the_text_are_no_pay_of_the_input(spark, tmp_path, name):
    """'net' in another word within 40 characters of an amount made it pay."""
    d = documents(spark, tmp_path, [None, "un unetre", "", "gross 5", "un unetre", "net", "a b", "income of 5 tr", "unetre", "salary x"])
    assert sorted(map(tuple, Q.queries()[name](spark, d).collect()), key=repr) == by_sql(name, d)


def python_steps(df):
    """(functions called, columns held in their queue) of each step of Python functions in a plan."""
    found, nodes = [], [df._jdf.queryExecution().sparkPlan()]
    while nodes:
        n = nodes.pop()
        kids = n.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
        if n.nodeName() == "ArrowEvalPython":
            found.append((n.udfs().size(), kids.apply(0).output().size()))
    return found


@pytest.mark.parametrize("extra", [(), ("doc_id",)])
def test_cleaning_after_dropping_copies_holds_each_text_once(spark, tmp_path, extra):
    """F1, F2, F3, F4: the queue of rows before Python held hundreds of columns (9.9 GB for 0.1 GB of documents), and texts were composed and expanded many times."""
    raw = raw_postings(spark, documents(spark, tmp_path, ["nv hòa\nb", "nv hòa\nb", None]))
    steps = python_steps(cleaning.clean(raw, extra=extra))
    assert steps and all(calls <= 20 and columns <= 60 for calls, columns in steps)
    assert cleaning.clean(raw, extra=extra).count() == 3 and cleaning.clean(raw.union(raw), extra=extra).count() == 3


def test_counting_terms_holds_few_numbers_for_each():
    """some 48 bytes of numbers a term were held at once when the terms of a pack were counted."""
    words = pa.array([f"t{i * i % 1009}" for i in range(400_000)])
    lists = pa.ListArray.from_arrays(pa.array([*range(0, 400_000, 500), 400_000], pa.int32()), words)
    tracemalloc.start()
    row, code, tf, names = E.counted(lists)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * len(words)
    want = {(r, t): n for r in range(0, 800, 97) for t, n in Counter(words[r * 500 : r * 500 + 500].to_pylist()).items()}
    got = {(r, names[c].as_py()): n for r, c, n in zip(row.tolist(), code.tolist(), tf.tolist()) if r % 97 == 0}
    assert got == want and int(tf.sum()) == len(words)
    assert [row[a:b].tolist() for a, b in E.whole_rows(row)] and all(a == 0 or row[a - 1] != row[a] for a, _ in E.whole_rows(row))
