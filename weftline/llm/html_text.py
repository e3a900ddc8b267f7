"""HTML extraction: page structure settles what it can, host suffix arrays settle the rest.

A page is cut into blocks by its structure, which also tells where they stand: in an article, a main part, no marked part, or in
menus, footers, adverts and the like. The token streams of what stands outside of the articles and main parts of a host's pages are put in a
row, suffixes are sorted by doubling, and long substrings that several distinct pages share are found: the host's boilerplate. It is removed from the
blocks of pages without an article or main part, whose unique runs are the text.

Inside articles the array decides nothing: lines that stand there and in adverts or footers of other pages too are text of the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings, written
from .url_filter import url_host

#: Tokens that make a long substring (a power of two), and distinct pages that must share it.
LONG, PAGES = 8, 3
#: Characters of text in one suffix array, about.
SHARD = 8_000_000

# Names that HTML and its common class names give to parts of a page.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set("aside button canvas dialog footer form head iframe menu nav noscript object select svg template".split())
RAW = "script|style|textarea|title|xmp|noembed|noframes"
MARKED = re.compile(r"ad|ads|adv\w*|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|notice\w*|alert|nav|navbar|navigation|menu\w*|sidebar\w*|side-bar|aside|footer\w*|breadcrumb\w*|comment\w*|respond|replies|disqus\w*|share|sharing|social\w*|related\w*|newsletter\w*|subscribe\w*|popup\w*|modal\w*|widget\w*")
MAIN = set("article-body post-content entry-content article-content main-content articlebody".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)


def page_blocks(source: str) -> list[tuple[int, str]]:
    """(rank, text) of the blocks in page order: rank 2 within an article, 1 within a main part, -1 in marked boilerplate, else 0."""
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    aside: list[str] = []  # text of what is skipped
    stack: list[tuple[str, bool, int, int]] = []  # name, skipped, rank, place of the innermost block
    places: dict[str, list[int]] = {}  # of the open elements of a name

    def flush(which: list[str], rank: int) -> None:
        text = " ".join(html.unescape("".join(which)).split())
        which.clear()
        if text:
            out.append((rank, text))

    def rank_now() -> int:
        return stack[-1][2] if stack else 0

    def close(i: int) -> None:
        for name, *_ in stack[i:]:
            places[name].pop()
        del stack[i:]
        if aside and not (stack and stack[-1][1]):
            flush(aside, -1)

    for m in _TAG.finditer(source):
        skipped = stack[-1][1] if stack else False
        if (text := m["text"]) is not None:
            (aside if skipped else buffer).append(text)
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            (aside if skipped else buffer).append(" ")
            continue
        block = name in BLOCKS
        if block:
            flush(aside, -1) if skipped else flush(buffer, rank_now())
        if m["end"] or m["end2"]:
            if places.get(name):
                i = places[name][-1]
                if block or stack[-1][3] <= i:  # an inline end doesn't close blocks
                    close(i)
            continue
        if block:  # ends that may be left out
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ())
            if stack and (i := stack[-1][3]) >= 0 and (stack[i][0] == "p" or stack[i][0] in closes):
                close(i)
            if stack and stack[-1][0] == "head" and name == "body":
                close(len(stack) - 1)
        if name in VOID:
            continue
        skipped, rank, inner = stack[-1][1:] if stack else (False, 0, -1)
        attrs = m["attrs"] or m["attrs2"] or ""
        marks: set[str] = set()
        if "=" in attrs:
            marks = {t.lower() for a in _ATTR.findall(attrs) for t in (a[1] or a[2] or a[3]).split()}
        if not skipped:
            if name in SKIP or name == "header" and not rank or attrs and _HIDDEN.search(attrs):
                skipped = True
            elif marks and name not in ("html", "body", "main") and any(MARKED.fullmatch(t) or MARKED.fullmatch(t.split("-")[0]) and t.split("-")[0] in ("ad", "ads", "cookie", "comment", "comments", "sidebar", "nav", "menu", "footer") for t in marks):
                skipped = True
            elif name == "article":
                rank = 2
            elif name == "main" or marks & MAIN or "main" in marks and re.search(r"role\s*=\s*[\"']?main", attrs):
                rank = max(rank, 1)
        places.setdefault(name, []).append(len(stack))
        stack.append((name, skipped, rank, len(stack) if block else inner))
    if aside:
        flush(aside, -1)
    if not (stack and stack[-1][1]):
        flush(buffer, rank_now())
    return out


def shared_tokens(streams: list[list[str]], long: int = LONG, pages: int = PAGES) -> list[np.ndarray]:
    """For each stream, which tokens lie in a substring of `long` tokens or more that `pages` distinct streams share.

    Equal streams count as one. Suffixes are ordered by their first 1, 2, 4, ... tokens up to `long`; suffixes of equal rank then
    share their first `long` tokens, so that each longer repeat is covered too.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    if not len(sizes) or not sizes.sum():
        return [np.zeros(n, bool) for n in sizes]
    rank = pa.array([t for s in streams for t in s], pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    names: dict[tuple, int] = {}
    alike = np.array([names.setdefault(tuple(s), len(names)) for s in streams])[owner]
    at, step = np.arange(len(rank)), 1
    while step < long:
        after = np.where(at + step < ends, rank[np.minimum(at + step, len(rank) - 1)] + 1, 0)
        _, rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)
        step *= 2
    whole = at + long <= ends
    pairs = np.unique(rank[whole] * (len(names) + 1) + alike[whole])
    distinct = np.bincount(pairs // (len(names) + 1), minlength=int(rank.max()) + 1)
    starts = np.flatnonzero(whole & (distinct[rank] >= pages))
    cover = np.zeros(len(rank) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + long, -1)
    return np.split(np.cumsum(cover[:-1]) > 0, np.cumsum(sizes)[:-1])


def covered(starts: np.ndarray, long: int) -> np.ndarray:
    """Which tokens lie in a window of `long` tokens that is marked at its start; the last long - 1 tokens start none."""
    cover = np.zeros(len(starts) + long, np.int64)
    np.add.at(cover, np.flatnonzero(starts), 1)
    np.add.at(cover, np.flatnonzero(starts) + long, -1)
    return np.cumsum(cover)[: len(starts) + long - 1] > 0


def windows(stream: list[str], long: int = LONG) -> np.ndarray:
    """A 64-bit hash of each run of `long` tokens, in order."""
    if len(stream) < long:
        return np.empty(0, np.int64)
    known: dict[str, int] = {}
    tokens = np.array([known.get(t) or known.setdefault(t, xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))) for t in stream], np.uint64)
    n = len(stream) - long + 1
    out = np.zeros(n, np.uint64)
    for i in range(long):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + n]
    return out.view(np.int64)


def stream_of(blocks: list[str]) -> list[str]:
    """Blocks as one token stream, each block ended by a line break."""
    return [w for b in blocks for w in (*b.split(" "), "\n")]


def without(blocks: list[str], ranks: list[int], shared: np.ndarray) -> str:
    """The blocks that no mark makes boilerplate, less their shared tokens."""
    out, at = [], 0
    for block, rank in zip(blocks, ranks):
        tokens = block.split(" ")
        if rank >= 0:
            kept = [t for t, drop in zip(tokens, shared[at : at + len(tokens)].tolist()) if not drop]
            out += [" ".join(kept)] if kept else []
        at += len(tokens) + 1
    return "\n\n".join(out)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per input row: the main text of each whole page.

    With an article, its blocks are the text; else those of the main part; else all blocks that aren't marked as menus and the like, less
    the runs of LONG tokens or more that the host's suffix array finds on PAGES distinct pages, outside of their articles and main parts.
    Streams that are equal count as one page there, so that copies don't erase each other. Null and empty pages have an empty text; null
    URLs share the empty host; repeated rows and keys stay apart; very long and deeply nested pages take time in proportion to their
    length; an empty table gives no rows; other columns play no part.

    Scale: a map over the scan cuts pages; what stands outside of their main parts is dealt by host, and a host with more than SHARD characters of it
    into several shards by a hash of the stream, each of bounded size. There windows of LONG tokens, as 64-bit hashes, are counted by
    distinct pages over the whole host and the hits applied in each shard, so that PAGES holds host-wide as in one suffix array.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts, blocks, ranks = [], [], []
                for text in strings(part.column("html")):
                    found = page_blocks(text)
                    top = max((r for r, _ in found), default=0)
                    texts.append("\n\n".join(b for r, b in found if r == top) if top > 0 else None)
                    rest = [(r, b) for r, b in found if top <= 0 or r < top]
                    blocks.append([b for _, b in rest])
                    ranks.append([r for r, _ in rest])
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("url"), pa.array(texts, pa.string()), pa.array(blocks, pa.list_(pa.string())), pa.array(ranks, pa.list_(pa.int8()))], names=["k", "url", "text", "blocks", "ranks"])

    kind = dict(pages.dtypes)[key]
    parsed = written(pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.col(source).cast("string").alias("html")).mapInArrow(parse, f"k {kind}, url string, text string, blocks array<string>, ranks array<byte>"), "parsed")
    rest = parsed.select("k", "url", F.col("text").isNull().alias("open"), "blocks", "ranks", url_host(F.col("url")).alias("host"), F.expr("aggregate(blocks, 0L, (s, b) -> s + length(b))").alias("size"))
    shards = rest.groupBy("host").agg(F.ceil(F.sum("size") / SHARD).alias("shards"))
    dealt = rest.join(shards, "host").withColumn("shard", F.pmod(F.xxhash64("blocks"), F.greatest("shards", F.lit(1))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.unique(windows(stream_of(row["blocks"])))
                yield pa.RecordBatch.from_pydict({"host": pa.array([row["host"]], pa.string()), "shard": pa.array([row["shard"]], pa.int64()), "page": pa.array([row["page"]], pa.int64()), "windows": pa.array([own], pa.list_(pa.int64()))})

    # equal streams fall into one shard, so that a shard's distinct pages add up to the host's
    hot = dealt.where("shards > 1").select("host", "shard", F.xxhash64("blocks").alias("page"), "blocks").mapInArrow(cut, "host string, shard long, page long, windows array<long>")
    in_shard = hot.select("host", "shard", "page", F.explode("windows").alias("window")).distinct().groupBy("host", "shard", "window").agg(F.count("*").alias("n"))
    shared = in_shard.groupBy("host", "window").agg(F.sum("n").alias("n"), F.collect_list("shard").alias("in")).where(F.col("n") >= PAGES)
    hits = shared.select("host", F.explode("in").alias("shard"), "window").groupBy("host", "shard").agg(F.collect_list("window").alias("hits"))

    def settle(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        streams = [stream_of(list(b)) for b in frame["blocks"]]
        if len(frame) and frame["shards"].iloc[0] > 1:
            known = np.asarray(found["hits"].iloc[0] if len(found) else [], np.int64)
            marks = [covered(np.isin(own, known), LONG) if len(own) else np.zeros(len(s), bool) for s in streams for own in [windows(s)]]
        else:
            marks = shared_tokens(streams)
        rows = [(k, u, without(list(b), list(r), m)) for k, u, o, b, r, m in zip(frame["k"], frame["url"], frame["open"], frame["blocks"], frame["ranks"], marks) if o]
        return pd.DataFrame(rows, columns=["k", "url", "text"])

    unmarked = dealt.groupBy("host", "shard").cogroup(hits.groupBy("host", "shard")).applyInPandas(settle, f"k {kind}, url string, text string")
    found = parsed.where("text IS NOT NULL").select("k", "url", "text").union(unmarked)
    return found.select(F.col("k").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))
