"""N-gram Jaccard join by PartEnum signatures.

Sets of shingle hashes fall into bands of size. For a band, a share of s/t in common bounds the number k of elements in
which two sets differ. The hash domain is cut into groups of PARTS partitions, more than k / 2 groups: two linked sets differ in
at most one partition of some group, so they agree on one of the subsets of PARTS - 1 of its partitions. Each such subset of each
group is enumerated, and a hash of what its partitions hold is a signature. Subsets that hold nothing give none; a set that has
so many of these that the count fails also takes the next of several hash seeds, and in the end the prefix filter's elements.
A pair is found if one of the two is safe that way, or else there.

Signatures that many sets share without being linked (of passages that occur in many texts) are refined: the sets that meet there
only are compared where they share one of their rarest elements, rarity counted among these sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType, StructField, StructType

from .common import by_doc, forget, let_go, slices, trim, written
from .graphs import bloom, bloom_has, components, maybe_in
from .text_units import list_sizes

U = np.uint64
SEEDS = 4
#: Partitions of a group; its subsets leave out one.
PARTS = 3
#: A signature of more sets than this is left out where a set can spare it, and refined where it still has sets to compare.
FREQUENT = 24


#: Signatures that are looked up in a filter at once.
LOOKUPS = 200_000
#: Shares of the signatures that are counted one after another, which bounds what their shuffle holds on disk.
TURNS = 3


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; with fewer words the whole sequence is one shingle."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(trimmed)
    sizes = list_sizes(lists)
    flat = lists.flatten().dictionary_encode()
    if len(flat) == 0:
        return [np.empty(0, U) for _ in sizes]
    names = flat.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in names), U, len(names))
    w = hashes[flat.indices.to_numpy()]
    empty = U(xxhash.xxh64_intdigest(b""))  # splitting an empty text leaves one
    k = U(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(w) - words + 1), U)
    for i in range(words):
        rolled = rolled * k + w[i : len(w) - words + 1 + i]
    rolled = mix(rolled)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n == 0 or (n == 1 and w[at] == empty):
            out.append(np.empty(0, U))
        else:
            h = U(n)
            with np.errstate(over="ignore"):
                for x in w[at : at + n]:
                    h = h * k + x
            out.append(mix(np.array([h], U)))
        at += n
    return out


def set_key(s: np.ndarray) -> int:
    """The key of a class of equal sets."""
    return int(mix(np.array([np.add.reduce(mix(s ^ U(0xA5A5))) ^ U(len(s))], U))[0].view(np.int64))


class Plan:
    """Bands, partitions and signatures for a share of s/t."""

    def __init__(self, s: int, t: int):
        self.s, self.t = s, t
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 3 // 2))

    @functools.cached_property
    def starts(self) -> np.ndarray:
        return np.array(self.edges, np.int64)

    def bands(self, n: int) -> range:
        """The set's own band and the next one if it can have a partner there."""
        own = lambda m: int(np.searchsorted(self.starts, m, side="right")) - 1
        return range(own(n), own(n * self.t // self.s) + 1)

    @functools.cache
    def cuts(self, band: int) -> tuple[int, int, np.ndarray]:
        """(groups, signatures that linked sets have in common at least, where the partitions of the hash domain begin).

        Without differences one group of one partition is enough. Else the first partition of a group that differs costs all but one
        of its subsets and the second one the last, so k differences cost most where they spread over as many groups as they can.
        A few groups more than needed leave signatures to spare.
        """
        k = 2 * (self.edges[band + 1] - 1) * (self.t - self.s) // (self.t + self.s)
        if k == 0:
            return 1, 1, np.zeros(1, U)
        groups = k // 2 + 1 + k // 10
        common = PARTS * groups - (PARTS - 1) * k if k <= groups else 2 * groups - k
        return groups, common, np.array([(j << 64) // (PARTS * groups) for j in range(PARTS * groups)], U)

    def signatures(self, own: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """Signatures by band, and how many of the own and the next band's the set can spare."""
        out, spare = [], [0, 0]
        for band in self.bands(len(own)):
            groups, common, cuts = self.cuts(band)
            safe = False
            for seed in range(SEEDS):
                h = own if seed == 0 else np.sort(mix(own ^ U(seed * 0x5851F42D4C957F2D & (1 << 64) - 1)))
                at = np.append(np.searchsorted(h, cuts), len(h))
                sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(h + U(0x1234567)), dtype=U)))
                held = (sums[at[1:]] - sums[at[:-1]]).reshape(groups, -1)
                full = np.diff(at).reshape(groups, -1)
                width = held.shape[1]
                subsets, holding = [], []
                for left_out in range(width) if width > 1 else [None]:
                    taken = [j for j in range(width) if j != left_out]
                    h2 = np.zeros(groups, U)
                    for j in taken:
                        h2 = mix(h2 * U(0x9E3779B97F4A7C15) + held[:, j])
                    subsets.append(mix(h2 ^ mix(np.arange(groups, dtype=U) << U(24) | U(taken[0] + width * len(taken) + (left_out or 0) << 16 | band << 8 | seed))))
                    holding.append(full[:, taken].sum(1) > 0)
                holding = np.concatenate(holding)
                out.append(_parity(np.concatenate(subsets)[holding], band))
                left = common - 1 - int((~holding).sum())  # signatures in common beyond one
                if left >= 0:
                    safe = True
                    if seed == 0:
                        spare[band & 1] = left
                    break
            if not safe:
                prefix = own[: prefix_size(len(own), self.s, self.t)]
                out.append(_parity(mix(prefix ^ mix(np.array([band << 8 | 255], U))), band))
        return out, spare


def prefix_size(n: int, s: int, t: int) -> int:
    """In any one order of elements, linked sets share one of so many of their first."""
    return n - -(-n * s // t) + 1


def _parity(signatures: np.ndarray, band: int) -> np.ndarray:
    """The lowest bit tells the set's own band from the next one."""
    return (signatures & ~U(1)) | U(band & 1)


def histogram(own: np.ndarray) -> bytes:
    """Elements of a set by the top bits of their hash: two sets differ in at least as many elements as their histograms do."""
    return np.bincount((own >> U(64 - 8)).astype(np.int64), minlength=256).astype("<u2" if len(own) < 1 << 16 else "<u4").tobytes()


def histograms_allow(a: bytes, b: bytes, na: int, nb: int, s: int, t: int) -> bool:
    """Whether sets of these histograms can be linked: linked sets differ in (na + nb) (t - s) / (t + s) elements at most."""
    x, y = (np.frombuffer(h, "<u2" if n < 1 << 16 else "<u4").astype(np.int64) for h, n in ((a, na), (b, nb)))
    return int(np.abs(x - y).sum()) * (t + s) <= (na + nb) * (t - s)


def linked(a: np.ndarray, b: np.ndarray, s: int, t: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return t * common >= s * (len(a) + len(b) - common)


def _profile(docs: DataFrame, words: int, s: int, t: int) -> DataFrame:
    """A row per document: doc_id, n, key of its set, spare signatures, and its signatures once per key and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        plan, seen = Plan(s, t), set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, even, odd, all_signatures = [], [], [], []
                sets = shingle_sets(part.column("text"), words)
                for own in sets:
                    key = set_key(own) if len(own) else None
                    keys.append(key)
                    if key is None or key in seen:
                        even.append(0), odd.append(0), all_signatures.append(None)
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    signatures, spare = plan.signatures(own)
                    even.append(spare[0]), odd.append(spare[1]), all_signatures.append(np.concatenate(signatures).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(even, pa.int32()), pa.array(odd, pa.int32()), pa.array(all_signatures, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "c", "even", "odd", "signatures"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, c long, even int, odd int, signatures array<long>")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(c, n, histogram, own): the hash sets of the wanted classes, from the text of each one's first document."""
    chosen = classes.join(wanted, "c").select("c", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                rows = [(c, len(x), histogram(x), x.tobytes()) for c, x in zip(part.column("c").to_pylist(), sets) if len(x) and set_key(x) == c]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["c", "n", "histogram", "own"])

    texts = maybe_in(docs, "doc_id", chosen, "id")
    return texts.join(chosen, texts["doc_id"].eqNullSafe(chosen["id"])).select("c", "text").mapInArrow(run, "c long, n long, histogram binary, own binary")


def _verified(pairs: DataFrame, sets: DataFrame, s: int, t: int, rough: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets are linked; `rough` pairs are sifted by the sets' histograms before any set is moved."""
    if rough:
        left, right = (sets.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("histogram").alias(f"h_{x}")) for x in "ab")
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "h_a", "h_b", "n_a", "n_b")

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [histograms_allow(*r, s, t) for r in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        pairs = written(joined.mapInArrow(sift, "a long, b long"), "sifted")
    left, right = (sets.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")
    joined = pairs.join(right, "b").join(left, "a").where(F.least("n_a", "n_b") * t >= F.greatest("n_a", "n_b") * s).select("a", "b", "own_a", "own_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2), batch.column(3))
            keep = [linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), s, t) for x, y in rows]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        trim()

    return joined.mapInArrow(run, "a long, b long").distinct()


def _rows_of(profile: DataFrame, shared: DataFrame) -> DataFrame:
    """(sig, c) of the profile's signatures that may be among the shared ones: a bounded filter before the join."""
    spark = profile.sparkSession
    words, bits = bloom(shared, "sig")
    held = spark.sparkContext.broadcast(words)  # 8 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(list_sizes(batch.column(1))) // LOOKUPS
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                lists = batch.column(1).slice(a, b - a)
                flat, owner = lists.flatten(), np.repeat(batch.column(0).slice(a, b - a).to_numpy(), list_sizes(lists))
                keep = bloom_has(held.value, bits, flat)
                yield pa.RecordBatch.from_arrays([flat.filter(pa.array(keep)), pa.array(owner[keep], pa.int64())], names=["sig", "c"])
        trim()

    return profile.where("signatures IS NOT NULL").select("c", "signatures").mapInArrow(run, "sig long, c long")


def _crossing(members: DataFrame, key: str, s: int, t: int) -> DataFrame:
    """Pairs (a, b) of members (key, c, n, most, part) of one key that are in different parts and may be linked.

    Sizes bound that, and `most`: what a set can have in common with another one of which this key is the first that both have.
    Linked sets of x and y elements have s (x + y) / (s + t) in common at least.
    """
    x, y = members.alias("x"), members.alias("y")
    enough = (F.least("x.most", "y.most") * (s + t) >= (F.col("x.n") + F.col("y.n")) * s) & (F.least("x.n", "y.n") * t >= F.greatest("x.n", "y.n") * s)
    pairs = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.part") < F.col("y.part")) & enough)
    return pairs.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()


def _mixed(members: DataFrame, key: str) -> DataFrame:
    """Members of keys that hold more than one part, with `size`, the number of the key's members: minima meet before the shuffle."""
    spans = members.groupBy(key).agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p < q").select(key, "size")
    return members.join(spans, key)


def _rare_elements(sets: DataFrame, wanted: DataFrame, s: int, t: int) -> DataFrame:
    """(e, c, n, most, part) for the wanted sets (c, part): the elements of each one's prefix, rarest first, that another wanted set has too.

    Elements that one set alone has come first in its prefix and link with nothing, so a text with enough words of its own
    has no row here, whatever passage it shares with others. `most` is the element and all that come after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, n, part, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                e = np.frombuffer(own, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e), *(pa.array(np.full(len(e), x), pa.int64()) for x in (c, n, part))], names=["e", "c", "n", "part"])

    elements = written(sets.join(wanted, "c").select("c", "n", "part", "own").mapInArrow(run, "e long, c long, n long, part long"), "elements")
    common = elements.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    shared = elements.join(common, "e")
    ranked = shared.select("*", F.row_number().over(Window.partitionBy("c").orderBy("df", "e")).alias("rank"), F.count("*").over(Window.partitionBy("c")).alias("held"))
    ranked = ranked.withColumn("most", F.col("held") - F.col("rank") + 1)
    return ranked.where(F.col("most") * t >= F.col("n") * s).select("e", "c", "n", "most", "part")  # the prefix: what can still reach the share


def _groups(docs: DataFrame, words: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, c) of each row, c the key of its set, null without shingles; (c, id, part) of each class of equal sets, part its linked set."""
    s, t = share
    texts = by_doc(docs)
    profile = written(_profile(texts, words, s, t), "profile")
    classes = written(profile.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("even").alias("even"), F.max("odd").alias("odd")), "classes")
    documents = written(profile.select("doc_id", "n", "c"), "documents")

    rows, parts_of = profile.where("signatures IS NOT NULL").select("c", F.explode("signatures").alias("sig")), []
    for turn in range(TURNS):  # a share of the signatures at a time is shuffled and dropped again
        own = rows.where(F.pmod(F.shiftright("sig", 1), F.lit(TURNS)) == turn)
        parts_of.append(written(own.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("freq")).where("lo < hi").select("sig", "freq"), "signatures"))
        forget()
    groups = functools.reduce(DataFrame.union, parts_of)
    shared = written(_rows_of(profile, groups).distinct().join(groups, "sig"), "shared")
    forget(profile, *parts_of)
    ranked = shared.where(F.col("freq") > FREQUENT).join(classes.select("c", "even", "odd"), "c").withColumn("rank", F.row_number().over(Window.partitionBy("c", F.col("sig").bitwiseAND(1)).orderBy(F.desc("freq"), "sig")))
    frequent = ranked.where(F.col("rank") > F.when(F.col("sig").bitwiseAND(1) == 0, F.col("even")).otherwise(F.col("odd"))).select("sig", "c")
    needed = written(shared.where(F.col("freq") <= FREQUENT).select("sig", "c").union(frequent), "needed")
    # a signature's hub is the set that meets most others: of near copies, one that most of them are linked with
    central = shared.groupBy("c").agg(F.sum("freq").alias("score"))
    hubs = needed.join(central, "c").groupBy("sig").agg(F.max(F.struct("score", "c")).alias("hub"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig", F.col("hub.c").alias("hub"), F.col("hub.score").alias("score"))
    kept = written(needed.join(hubs, "sig"), "kept")
    forget(shared, needed)
    star = written(kept.where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b"), "score").distinct(), "star")

    sets = written(_sets(texts, classes, kept.select("c").distinct(), words), "sets")
    first = written(_verified(star.groupBy("b").agg(F.max_by("a", F.struct("score", "a")).alias("a")).select("a", "b"), sets, s, t, rough=True), "links")
    parts = components(first)
    of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    open_ = star.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    links = written(first.union(_verified(open_, sets, s, t, rough=True)), "links")
    parts = components(links)
    forget(first, star)

    mine = kept.where("c <> hub").join(parts.select(F.col("node").alias("c"), "component"), "c", "left").join(classes.select("c", "n"), "c").select("sig", "c", "n", F.coalesce("component", "c").alias("part"))
    mixed = written(_mixed(written(mine, "members"), "sig"), "mixed")
    few = _crossing(mixed.where(F.col("size") <= FREQUENT).withColumn("most", F.col("n")), "sig", s, t)
    rare = written(_rare_elements(sets, mixed.where(F.col("size") > FREQUENT).select("c", "part").distinct(), s, t), "rare")
    crossing = written(few.union(_crossing(_mixed(rare, "e").drop("size"), "e", s, t)).distinct(), "crossing")
    parts = written(components(links.union(_verified(crossing, sets, s, t, rough=True))), "parts")
    forget(kept, links, mixed, rare, crossing, sets)
    return documents, classes.select("c", "id").join(parts.select(F.col("node").alias("c"), "component"), "c", "left").select("c", "id", F.coalesce("component", "c").alias("part"))


def ngram_join(docs: DataFrame, words: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id per input row: documents whose shingle sets have share[0]/share[1] or more in common are linked.

    component_id is the smallest doc_id reachable by links, itself included. Texts without words (null, empty, white space)
    have no shingles, link with nothing and are their own component. Equal sets are one class throughout, so repeated rows and
    repeated doc_ids are no special case; a null doc_id takes part but never names a component unless all of it are null. An
    empty table gives no rows; other columns play no part. The words are cut at ASCII white space after A-Z are lower-cased.

    Scale: copies collapse in each task before anything is shuffled. Signatures grow with the shingles, and never with pairs:
    each signature's sets are compared with its hub only, the set that meets most others (round one: one hub per set), components are formed,
    and only sets of a signature that are still in different components are compared with each other: those of at most FREQUENT
    sets directly, the others where they share an element of their prefixes, rarest first. Very frequent
    signatures (of shared passages) are left out as far as the bound on differences lets a set spare them, which loses no link.
    Minima and counts of a signature meet before the shuffle and are joined back, so that the join's skew handling splits a hot one.
    Nothing is collected; each intermediate result is a table in the shared folder.
    """
    documents, classes = _groups(docs, words, share)
    least = classes.groupBy("part").agg(F.min("id").alias("component_id"))
    named = classes.join(least, "part").select("c", "component_id")
    return documents.join(named, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of docs, all columns as they are, less all but one of each linked group: the one of the smallest doc_id stays.

    A null doc_id comes after all others; among rows of that id the one of the smallest set key stays, and one of rows that are equal
    in both. Rows are told apart by id and set, so a row whose text links with nothing stays whatever id it has. Texts without
    words all stay. Empty tables give empty tables; columns beyond doc_id and text play no part. Only rows whose id may be one of
    a group of several rows pass a shuffle.
    """
    documents, classes = _groups(docs, words, share)
    members = written(documents.where("c IS NOT NULL").join(classes.select("c", "part"), "c").select("doc_id", "c", "part"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("c").alias("c"))
    several = members.groupBy("part").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    doubtful = written(members.join(several, "part").select("doc_id", "c", ((F.col("doc_id").eqNullSafe(F.col("first.id"))) & (F.col("c") == F.col("first.c"))).alias("stays")).distinct(), "doubtful")
    ids = doubtful.select("doc_id").distinct()
    columns = docs.columns
    keyed = docs.select(*(F.col(f"`{x}`").alias(f"_{i}") for i, x in enumerate(columns)), F.col("doc_id").cast("long").alias("__id"))
    text = f"_{columns.index('text')}"

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                keys = [set_key(x) if len(x) else None for x in shingle_sets(part.column("__text"), words)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(keys, pa.int64())], names=[*part.schema.names[:-1], "__c"])

    found = StructType([*keyed.schema.fields, StructField("__c", LongType())])
    sure = maybe_in(keyed, "__id", ids, "doc_id", inside=False)
    maybe = written(maybe_in(keyed, "__id", ids, "doc_id"), "maybe")  # few rows: whole ones pass Python only here
    marked = maybe.withColumn("__text", F.col(text).cast("string")).mapInArrow(key, found).join(doubtful, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__c") == F.col("c")), "left")
    kept = marked.where("stays").dropDuplicates(["__id", "__c"])
    rest = marked.where("stays IS NULL").select(*keyed.columns[:-1]).union(kept.select(*keyed.columns[:-1]))
    return sure.select(*keyed.columns[:-1]).union(rest).toDF(*columns)
