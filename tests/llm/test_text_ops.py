import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, decontaminate, html_text, lm_score, ngram_join, quality, url_filter
from weftline.llm.graphs import components

EXTRA = "text string, doc_id long, own string, n int, c int, sig int"


def frame(spark, rows):
    return spark.createDataFrame([(t, i, "x", 1, 2, 3) for i, t in rows], EXTRA)


def vocabulary(r, n, size):
    return " ".join(r.choice([f"w{i}" for i in range(size)]) for _ in range(n))


# ---- URL filter


def test_urls(spark):
    urls = ["http://a.com/en/1", "http://a.EXAMPLE.com/en/75?q", "https://example.com/en/8", "http://com/en/", "http://xcom/en/", "http://a.net/de/8", "http://example.net/de/8x", "http://b.example.net/de/9#f", "no scheme", "", None, "http://a.org/es/", "http://a.org", "://a.com/en/x", "http://a.com:80/en/", "http://a.com/en/\n1"]
    rules = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
    df = spark.createDataFrame([(i // 2, u, "clash", "clash") for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host string, rule string")

    def judge(u):
        if u is None or "://" not in u:
            return ("", "", None, "allow")
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = sorted((tuple(r) for r in url_filter.filter_urls(df, url_filter.rule_table(spark, rules)).collect()), key=str)
    assert got == sorted(((i // 2, *judge(u)) for i, u in enumerate(urls + urls[:2])), key=str)
    assert url_filter.filter_urls(df.limit(0), url_filter.rule_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, url_filter.rule_table(spark, ())).collect()} == {"allow"}


# ---- n-gram join


def brute_components(rows, words, s, t):
    sets, parent = [], {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and t * both >= s * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sorted(((i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("words, s, t", [(4, 85, 100), (5, 4, 5)])
def test_ngram_join(spark, words, s, t):
    r = random.Random(words)
    rows, n = [], 0
    passage = vocabulary(r, 60, 50)
    for size in [*range(0, 30), 60, 120, 300]:
        base = vocabulary(r, size, 30).split()
        for edits in (0, 0, 1, 2, 5, 12):
            copy = list(base)
            for _ in range(edits):
                if copy:
                    copy[r.randrange(len(copy))] = f"e{r.randrange(99)}"
            rows.append((n, " ".join(copy).upper() if edits == 0 and n % 2 else " ".join(copy)))
            n += 1
    rows += [(n + i, passage + " " + vocabulary(r, 8 + i, 500)) for i in range(40)] + [(None, "null id text of five words"), (3, None), (9999, " \t "), (9998, "null id text of five words")]
    got = sorted((tuple(x) for x in ngram_join.ngram_join(frame(spark, rows), words, (s, t)).collect()), key=str)
    assert got == brute_components(rows, words, s, t)


def test_shared_passages_are_refined_without_losing_links(spark, monkeypatch):
    """Signatures of many sets take the way over rare elements; results stay those of brute force."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    r, rows = random.Random(3), []
    passage = vocabulary(r, 60, 50)
    for i in range(60):
        own = vocabulary(r, r.choice([2, 5, 12, 30]), 400)
        rows += [(2 * i, f"{passage} {own}"), (2 * i + 1, f"{passage} {own} {vocabulary(r, r.choice([0, 1, 4]), 400)}")]
    got = sorted((tuple(x) for x in ngram_join.ngram_join(frame(spark, rows), 4, (85, 100)).collect()), key=str)
    assert got == brute_components(rows, 4, 85, 100)
    assert len({x[2] for x in got}) > 20


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_signatures_find_every_linked_pair():
    r = np.random.default_rng(0)
    plan = ngram_join.Plan(85, 100)
    for n in [*range(1, 60), 100, 250]:
        for _ in range(8):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.int64).view(np.uint64) << np.uint64(1))
            drop = int(r.integers(0, 1 + n // 6))
            b = np.unique(np.concatenate((a[drop:], r.integers(0, 2**63, int(r.integers(0, 2)), dtype=np.int64).view(np.uint64))))
            if len(b) and ngram_join.linked(a, b, 85, 100):
                sig = [set(np.concatenate(plan.signatures(x)[0]).tolist()) for x in (a, b)]
                assert sig[0] & sig[1]
                assert ngram_join.histograms_allow(ngram_join.histogram(a), ngram_join.histogram(b), len(a), len(b), 85, 100)


def test_one_of_each(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (2, text), (2, text), (3, "other words that are not the same at all"), (3, "x"), (None, text), (4, None)]
    kept = sorted(tuple(r)[:2] for r in ngram_join.one_of_each(frame(spark, rows)).select("doc_id", F.coalesce("text", F.lit("")), "own", "sig").collect())
    assert kept == [(1, text), (3, "other words that are not the same at all"), (3, "x"), (4, "")]  # the null id is a copy of 1
    alone = [(None, text), (None, text), (None, ""), (None, None), (7, "far other words in this row than there are above")]
    kept = sorted((tuple(r) for r in ngram_join.one_of_each(frame(spark, alone)).select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("-"))).collect()))
    assert kept == [(-1, ""), (-1, "-"), (-1, text), (7, alone[-1][1])]
    assert ngram_join.one_of_each(frame(spark, rows).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}


def test_sets_that_are_never_safe_take_every_seed():
    plan = ngram_join.Plan(4, 5)
    groups, _, cuts = plan.cuts(plan.bands(12)[0])
    own = np.arange(12, dtype=np.uint64)  # all in one partition of the first seed
    found = plan.signatures(own)[0]
    assert len(found) > 2 and all(len(x) for x in found)
    empty = plan.cuts
    plan.cuts = lambda band: (groups, 0, cuts)  # no signature is sure to be common
    every = plan.signatures(own)[0]  # so no seed is safe, and the elements of the prefix filter come last
    plan.cuts = empty
    assert len(every) == (ngram_join.SEEDS + 1) * len(plan.bands(12))


# ---- decontamination


def test_myers_and_pieces():
    r = random.Random(3)

    def slow(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            row, up = [i] + row[1:], row
            for j, b in enumerate(text, 1):
                row[j] = min(up[j] + 1, row[j - 1] + 1, up[j - 1] + (a != b))
        return min(row)

    for _ in range(200):
        item, text = ("".join(r.choice("abc ") for _ in range(r.randint(1, k))) for k in (20, 60))
        assert decontaminate.best_match(decontaminate.masks(item), len(item), text)[0] == slow(item, text)
    for _ in range(100):
        item = vocabulary(r, 30, 400)
        budget = len(item) // decontaminate.PER_EDIT
        copy = list(item)
        for _ in range(r.randint(0, budget)):
            copy[r.randrange(len(copy))] = r.choice("xyz")
        text = vocabulary(r, 40, 400) + " " + "".join(copy) + " " + vocabulary(r, 40, 400)
        assert decontaminate.Matcher([(5, item)]).matches(text)


def test_distance_and_end_against_brute_force():
    r = random.Random(5)

    def slow(item, text):
        """(distance, end) of the first substring that is nearest to the item."""
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            row, up = [i] + row[1:], row
            for j, b in enumerate(text, 1):
                row[j] = min(up[j] + 1, row[j - 1] + 1, up[j - 1] + (a != b))
        return min((d, j) for j, d in enumerate(row))

    for _ in range(40):
        items = [(k, vocabulary(r, 12, 40)) for k in range(3)]
        text = vocabulary(r, 5, 40)
        for _ in range(r.randint(0, 4)):
            copy = list(r.choice(items)[1])
            for _ in range(r.randint(0, 7)):
                copy[r.randrange(len(copy))] = r.choice("xyz ")
            text += " " + "".join(copy) + " " + vocabulary(r, r.randint(1, 8), 40)
        text = decontaminate.normalized(text)
        want = [(k, *slow(t, text), len(t)) for k, t in items]
        assert decontaminate.Matcher(items).matches(text) == [w for w in want if w[1] <= w[3] // decontaminate.PER_EDIT]


def test_texts_that_repeat_themselves_are_searched_once():
    item = "the quick brown fox jumps over the lazy dog and runs away from all of it"
    began = time.perf_counter()
    for n in (2_000, 8_000):
        assert decontaminate.Matcher([(1, item)]).matches("the quick brown fox jumps over a dog " * n) == []
    assert time.perf_counter() - began < 20


def test_find_and_drop(spark):
    item = "This is a test item, of quite some words and length."
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (1, item, "x")], "item_id long, text string, doc_id string")
    rows = [(1, f"before {item.upper()}\n\nafter"), (2, item.replace("words", "wordz").replace(" ", "  ")), (3, "clean text that has nothing of the kind"), (4, None), (5, ""), (1, item), (None, item)]
    df = frame(spark, rows)
    found = decontaminate.find_benchmark(df, bench)
    assert sorted(str(r["doc_id"]) for r in found.collect()) == sorted(["1", "2", "1", "None"] * 2)
    assert sorted(str(r["doc_id"]) for r in decontaminate.drop_contaminated(df, bench).collect()) == ["3", "4", "5"]
    assert decontaminate.find_benchmark(df, bench.limit(0)).count() == 0 == decontaminate.find_benchmark(df.limit(0), bench).count()
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(rows)


# ---- nearest neighbours


def test_nearest(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(600, 16))
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(600 + i, v[50].tolist(), 0) for i in range(40)] + [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] + [1.0] * 15, 0), (1150, [None] + [1.0] * 15, 0), (None, v[3].tolist(), 0), (50, v[50].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard long")
    got = collections.defaultdict(list)
    for x in sorted(ann.nearest(df, shard_size=200).collect(), key=lambda x: (x["query_id"], x["rank"])):
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    clean = {i: np.array(x) for i, x, _ in rows if i is not None and x is not None and None not in x and np.isfinite(x).all() and any(x)}
    hits = total = 0
    for q in (i for i in clean if i % 50 == 0):
        cos = {i: float(x @ clean[q] / np.sqrt((x @ x) * (clean[q] @ clean[q]))) for i, x in clean.items() if i != q}
        want = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        assert len(got[q]) == 5 and all(abs(cos[i] - s) < 1e-12 for i, s in got[q])
        hits, total = hits + len(set(want) & {i for i, _ in got[q]}), total + 5
    assert hits / total >= 0.9
    assert [i for i, _ in got[50]] == [600, 601, 602, 603, 604]
    assert ann.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(x["query_id"], x["vec_id"]) for x in ann.nearest(few).collect()] == [(0, 1)]


def test_huge_tiny_and_collinear_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 2e200]), (2, [1e-200, 0.0]), (3, [2.0, 2.0]), (4, [4.0, 4.0]), (5, [0.0, 1e-320])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x["vec_id"], x["score"]) for x in sorted(ann.nearest(df).collect(), key=lambda x: x["rank"])]
    assert [i for i, _ in got] == [3, 4, 1, 2, 5] and got[0][1] == got[1][1] and abs(got[0][1] - 1) < 1e-15
    assert abs(got[2][1] - 3 / math.sqrt(10)) < 1e-15 and all(abs(s - math.sqrt(0.5)) < 1e-15 for _, s in got[3:])


def test_recall_where_queries_visit_few_of_many_cells(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 24))
    v = centres[r.integers(0, 40, 6000)] + 0.6 * r.normal(size=(6000, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    got = collections.defaultdict(set)
    for x in ann.nearest(df, shard_size=100, probes=8).collect():  # of 60 cells
        got[x["query_id"]].add(x["vec_id"])
    queries = range(0, 6000, 50)
    hits = sum(len(got[q] & set(np.argsort(-np.where(np.arange(6000) == q, -9, unit @ unit[q]))[:5].tolist())) for q in queries)
    assert hits / (5 * len(queries)) >= 0.9


# ---- HTML


def test_blocks():
    page = '<html><head><title>t</title><style>p{}</style></head><body><header>h</header><nav><a href="/x">n</a></nav><div class="ad">a</div><article><h1>A &amp; B</h1><p>one<br>two\n three<p>four <b>five</b><script>var x="</p>";</script><aside>s</aside><div class="comments"><p>c</p></div></article><footer>&copy; f</footer>'
    assert html_text.page_blocks(page) == [(-1, "h"), (-1, "n"), (-1, "a"), (2, "A & B"), (2, "one two three"), (2, "four five"), (-1, "s"), (-1, "c"), (-1, "© f")]
    assert html_text.page_blocks("") == [] and html_text.page_blocks("plain < text") == [(0, "plain < text")]
    assert html_text.page_blocks("<p>a<!-- x -->b</p><form>f</form><p hidden>h</p><p>c &nbsp; d &#233;") == [(0, "ab"), (-1, "f"), (-1, "h"), (0, "c d é")]
    assert html_text.page_blocks("<p>a <button>x</button>b</p>") == [(-1, "x"), (0, "a b")]


def test_nesting_takes_time_in_proportion():
    began = time.perf_counter()
    for n in (50_000, 100_000):
        assert html_text.page_blocks("<div>" * n + "t" + "</b>" * n) == [(0, "t")]
        assert len(html_text.page_blocks("<b>" * n + "<p>t</p>" * n)) == n
    assert time.perf_counter() - began < 20


def test_suffix_array_against_brute_force():
    r = random.Random(4)
    streams = [[r.choice("abc") for _ in range(r.randint(0, 40))] for _ in range(12)]
    for long, pages in ((2, 2), (4, 3)):
        got = html_text.shared_tokens(streams, long, pages)
        distinct = {tuple(s) for s in streams}
        for s, cover in zip(streams, got):
            want = [False] * len(s)
            for i in range(len(s) - long + 1):
                piece = tuple(s[i : i + long])
                if sum(any(t[j : j + long] == piece for j in range(len(t) - long + 1)) for t in distinct) >= pages:
                    want[i : i + long] = [True] * long
            assert cover.tolist() == want


def test_extract(spark):
    menu = "home news sport weather travel culture money about us"
    rows = [(i, f"http://h.org/{i}", f"<p>{menu}</p><p>{i} is the text of page {i}</p>") for i in range(5)] + [(9, None, None), (9, "http://h.org/x", ""), (7, "http://h.org/7", "<article><p>kept</p></article><p>other</p>")]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "page_id long, url string, html string, text string, host int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()), key=str)
    want = [(i, t := f"{i} is the text of page {i}", len(t)) for i in range(5)] + [(9, "", 0), (9, "", 0), (7, "kept", 4)]
    # what marked pages have outside of their articles tells the boilerplate of unmarked ones; lines inside of articles stay
    line = "this very line of more than eight words stands everywhere"
    rows += [(100 + i, "http://k.org/", f"<nav>{line}</nav><article><p>{line}</p><p>article {i}</p></article><div>{i}</div>") for i in range(3)]
    rows += [(110, "http://k.org/", f"<p>{line}</p><p>own words {'very ' * 200_000}long</p>")]
    want += [(100 + i, t := f"{line}\n\narticle {i}", len(t)) for i in range(3)] + [(110, t := f"own words {'very ' * 200_000}long", len(t))]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "page_id long, url string, html string, text string, host int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()), key=str)
    assert got == sorted(want, key=str)
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_large_hosts_count_pages_over_all_shards(spark, monkeypatch):
    menu = "home news sport weather travel culture money about us"
    pages = [(i, "http://h.org/x", (f"<p>{menu}</p>" if i % 10 == 0 else "") + "<p>" + " ".join(f"t{i}x{j}" for j in range(30)) + "</p>") for i in range(40)] + [(40, "http://h.org/x", "<p>short</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = lambda: sorted(tuple(r) for r in html_text.extract_text(df).collect())
    one = rows()
    monkeypatch.setattr(html_text, "SHARD", 300)
    many = rows()
    assert many == one and not any(menu in r[2] for r in many)


# ---- quality


def test_quality(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["the", "house", "stands", "on", "a", "hill", "with", "trees."]) for _ in range(40))
    bad = lambda: " ".join(r.choice(["BUY!!", "NOW!!", "cheap###", "pills%%%"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(1000, None), (1001, ""), (None, good()), (5, good())]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(250)] + [(None, 1), (7, None), (1000, 5)], "doc_id long, quality int")
    df = frame(spark, rows)
    got = quality.score_quality(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert sum(by[i]["predicted"] == (1 if i % 3 else 0) for i in range(300)) >= 295
    kept = {x["doc_id"] for x in quality.keep_quality(df, labels).collect()}
    assert {i for i in range(300) if i % 3} - kept == set() and len(kept & {i for i in range(300) if i % 3 == 0}) <= 3
    assert {x["score"] for x in quality.score_quality(df, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), labels).count() == 0


def test_dual_coordinate_descent_against_a_slow_solver():
    """The model's margin loss is that of projected gradient ascent on the same dual."""
    r = np.random.default_rng(2)
    labels = np.array([1, 0] * 15)
    samples = [np.unique(r.integers(0, 40, 12) + (8 if y else 0)) for y in labels]
    model = quality.fit(samples, labels, epochs=2000)
    x = np.zeros((30, 48))
    for i, bins in enumerate(samples):
        ratio = model.ratio[bins].astype(float)
        x[i, bins] = ratio / np.sqrt((ratio**2).sum())
    y = np.where(labels == 1, 1.0, -1.0)
    p, q = (1 + np.array([[b in s for b in range(48)] for s, k in zip(samples, labels) if k == c]).sum(0) for c in (1, 0))
    rest = (1 << quality.BITS) - 48
    want = np.log(p / (p.sum() + rest)) - np.log(q / (q.sum() + rest))
    seen = (p > 1) | (q > 1)
    assert np.allclose(model.ratio[:48][seen], want[seen], atol=1e-5)
    gram, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(30)
    for _ in range(200_000):
        alpha = np.clip(alpha + 0.02 * (1 - gram @ alpha), 0, 1)
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    assert abs(loss(model.weights[:48].astype(float)) - loss((alpha * y) @ x)) < 1e-2


def test_whole_words_make_shapes_and_repeated_ids_are_fixed(spark):
    assert quality._shape("a" * 50 + "1") != quality._shape("a" * 50)
    rows = [(i, f"good text number {i} of many" if i % 2 else "BUY!! NOW!!") for i in range(60)]
    twice = rows + [(3, "BUY!! other"), (4, "good other text")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    one = {r["doc_id"]: r["score"] for r in quality.score_quality(frame(spark, twice), labels).where("doc_id > 10").collect()}
    two = {r["doc_id"]: r["score"] for r in quality.score_quality(frame(spark, twice[::-1]).repartition(3), labels).where("doc_id > 10").collect()}
    assert one == two


def test_keep_quality_of_null_empty_and_nothing(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = [(i, f"good text number {i}" if i % 2 else "BUY!! NOW!!") for i in range(40)] + [(50, None), (51, ""), (None, "good text"), (52, "good text " * 100_000)]
    df = frame(spark, rows)
    by = {r["doc_id"]: r["predicted"] for r in quality.score_quality(df, labels).collect()}
    kept = quality.keep_quality(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, p in by.items() if p}
    assert by[50] == by[51] and quality.keep_quality(df.limit(0), labels).count() == 0 and quality.keep_quality(df, labels.limit(0)).count() == len(rows)


# ---- language model


def test_language_model(spark):
    r = random.Random(8)
    tongues = (["The", "of", *(f"w{k}" for k in range(20))], ["é", "maison", *(f"é{k}" for k in range(20))])
    rows = [(i, " ".join(r.choice(tongues[i % 2]) + r.choice(["", "", "."]) for _ in range(r.randint(0, 60)))) for i in range(200)]
    rows += [(500, None), (501, " \n "), (None, "the of"), (3, "again")]
    got = lm_score.score_texts(frame(spark, rows)).collect()
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((str(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows), key=str)
    assert sorted(((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got), key=str) == want
    assert sum(x["score"] for x in got if x["held_out"]) > sum(x["base_score"] for x in got if x["held_out"])
    assert lm_score.score_texts(frame(spark, rows).limit(0)).count() == 0
    none = lm_score.score_texts(frame(spark, [(i, "a b") for i in range(200) if held(i)])).collect()
    assert none and all(x["train_tokens"] == 0 and x["base_score"] == 0 and x["score"] == 0 for x in none)


def test_tables_are_drawn_as_single_customers_would_sit():
    """draw_tables() against a sampler that moves one customer at a time among tables that are there."""
    r, n, d, others, mine, total = random.Random(1), 7, 0.4, 5.0, 0.6, 9.0
    weight = lambda t, j: (lm_score.STRENGTH + d * (others + t)) * (mine + j) / (total + j)
    tables, seen = [n], collections.Counter()
    for step in range(60_000):
        k = r.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
        t = len(tables)
        k = r.choices(range(t + 1), [*(x - d for x in tables), weight(t, t)])[0]
        if k == t:
            tables.append(1)
        else:
            tables[k] += 1
        seen[len(tables)] += 1
    m = 60_000
    full = np.ones(m)
    got = collections.Counter(lm_score.draw_tables(np.full(m, n), lm_score.Others(d, others * full, mine * full, total * full), np.random.default_rng(2)).astype(int).tolist())
    assert all(abs(got[t] / m - seen[t] / m) < 0.015 for t in range(1, n + 1))


def test_many_customers_are_drawn_as_the_recursion_would():
    r = np.random.default_rng(3)
    for d, p, others in ((0.6, 0.01, 5000), (0.3, 0.001, 100), (0.7, 0.2, 20_000)):
        n, full = np.full(4000, lm_score.EXACT), np.ones(4000)
        o = lm_score.Others(d, others * full, p * full, full, grows=False)
        exact, many = lm_score.draw_tables(n, o, r), lm_score._draw_many(n.astype(float), o, r)
        assert abs(exact.mean() - many.mean()) < 0.03 * exact.mean() + 0.05 and abs(exact.std() - many.std()) < 0.1 * exact.std() + 0.05
        huge = lm_score._draw_many(np.full(10, 5e9), o.of(np.arange(10)), r)
        assert (huge >= 1).all() and huge.mean() > 0.8 * many.mean()


def test_probabilities_of_a_small_model_against_plain_code(spark, monkeypatch):
    """The scores of a small corpus from dictionaries of customers and tables, as the partitions hold them, summing to one over all words."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefgh") + r.choice(["", "", "x"]) for _ in range(r.randint(1, 12)))) for i in range(120)]
    size = sum(len(x.split()) + 1 for _, x in rows)
    monkeypatch.setattr(lm_score, "PART", size // 6)
    parts = -(-size // (size // 6))
    docs = frame(spark, rows)
    texts, folder = (lm_score.fresh_path(spark, x) for x in ("texts", "model"))
    chunks = lm_score.written(lm_score._chunks(docs.select("doc_id", "text").withColumn("held", F.lit(False)), texts), "c")
    got, roots, d1, tokens, known = lm_score.fit_model(chunks, parts, folder, texts)
    names = {}  # the words of each partition, from the chunks alone
    for row in chunks.collect():
        c = lm_score.Chunk(texts, row["chunk"])
        a, b = c.hashes[c.before], c.hashes[c.word]
        for p, x, y in zip(lm_score.pair_home(a, b, parts), a, b):
            names.setdefault(int(p), set()).update((int(x), int(y)))
    n, t, c0, t0, tables = {}, [{} for _ in roots], [{} for _ in roots], [{} for _ in roots], [{} for _ in roots]
    for p, rows_ in got.toPandas().groupby("p"):
        words, pairs = sorted(names[p]), lm_score.Pairs(folder, p)
        for k, (x, a, b, c) in enumerate(lm_score.samples_of(folder, p, lm_score._joined(rows_))):
            held = iter(x.tolist())
            for w, v, m in zip(pairs.word.tolist(), pairs.before.tolist(), pairs.n.tolist()):
                n[words[v], words[w]] = m
                t[k][words[v], words[w]] = next(held) if m > 1 else m
            for i, w in enumerate(words):
                for table, values in ((c0, a), (t0, b), (tables, c)):
                    assert table[k].setdefault(w, int(values[i])) == int(values[i])  # alike in all partitions
    assert len(roots) == lm_score.SAMPLES
    assert sum(n.values()) == tokens and len(c0[0]) == known
    for k, root in enumerate(roots):
        assert all(1 <= t[k][x] <= n[x] for x in n)
        for w in c0[k]:
            assert c0[k][w] == sum(v for (_, b), v in t[k].items() if b == w) and tables[k][w] == sum(v for (a, _), v in t[k].items() if a == w) and 1 <= t0[k][w] <= c0[k][w]
        assert root.customers == sum(c0[k].values()) and root.tables == sum(t0[k].values())

    def chance(a, w):
        out = 0.0
        for k in range(len(roots)):
            p0 = (c0[k].get(w, 0) - roots[k].d * t0[k].get(w, 0) + (1 + roots[k].d * sum(t0[k].values())) / (known + 1)) / (1 + sum(c0[k].values()))
            customers = sum(v for (b, _), v in n.items() if b == a)
            out += (max(n.get((a, w), 0) - d1 * t[k].get((a, w), 0), 0) + (1 + d1 * tables[k].get(a, 0)) * p0) / (1 + customers) / len(roots)
        return out

    for a in [*list(c0[0])[:4], 12345]:
        assert abs(sum(chance(a, w) for w in c0[0]) + chance(a, 777) - 1) < 1e-9
    got = {x["doc_id"]: x["score"] for x in lm_score.score_texts(docs, folds=1, fold=5).collect()}
    name = lambda w: int(lm_score.END) if w is None else lm_score.xxhash.xxh64_intdigest(w.encode())
    want = {i: sum(math.log10(chance(name(a), name(b))) for a, b in zip([None, *x.split()], [*x.split(), None])) for i, x in rows}
    assert len(got) == 120 and all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_words_before_change_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PART", 200)  # many partitions, of the root too
    r = random.Random(9)
    ordered = lambda: " ".join(f"a{k} b{k} c{k}" for k in (r.randrange(6) for _ in range(20)))
    plain = [(i, ordered()) for i in range(150)]
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 7 == 2][:12]
    pairs = []
    for k, i in enumerate(held[0::2]):
        text = ordered()
        words = text.split()
        r.shuffle(words)
        pairs += [(i, text), (held[2 * k + 1], " ".join(words))]
    got = {x["doc_id"]: x for x in lm_score.score_texts(frame(spark, plain + pairs)).collect()}
    for (i, _), (j, _) in zip(pairs[0::2], pairs[1::2]):
        assert got[i]["held_out"] and got[j]["held_out"] and abs(got[i]["base_score"] - got[j]["base_score"]) < 1e-9
        assert got[i]["score"] > got[j]["score"] + 10
