"""Sparse text features: TF-IDF by word and character n-grams, one-hot with a floor, scaled numbers, as ML stages or SQL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizer, MaxAbsScaler, OneHotEncoder, StringIndexerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import forget, fresh_path, put, take, written

#: Words of two characters or more, as the usual vectorizers cut them.
TOKEN = r"(?U)\b\w\w+\b"
#: Most terms of each text block.
BLOCKS = {"job_title": 60_000, "description": 150_000, "requirements": 100_000, "technical_skills_text": 40_000, "qualifications_text": 20_000, "soft_skills_text": 20_000, "benefits_text": 30_000, "languages_text": 1 << 18}


#: Terms that a task counts together, bytes of a file of terms, and rows of weights that are returned at once.
PACK, BLOCK_BYTES, ROWS_OUT = 1 << 21, 32 << 20, 1 << 16


@dataclass(frozen=True)
class PrepConfig:
    """Ablation flags of the feature plan."""

    segment: bool = False
    charfold: bool = False
    province: bool = False
    stopwords: bool = False

    def tag(self) -> str:
        on = [n[:3] for n in ("segment", "charfold", "province", "stopwords") if getattr(self, n)]
        return "+".join(on) or "base"


FULL = PrepConfig(segment=True, charfold=True, province=True)
#: What serving prepares: all but segments.
SERVED = PrepConfig(charfold=True, province=True)


def word_terms(c: Column | str, most: int = 2) -> Column:
    """Lower-cased words and runs of up to `most` words."""

    def runs(words: Column) -> Column:
        out = words
        for n in range(2, most + 1):
            starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
            out = F.concat(out, F.transform(starts, joined(words, n)))
        return out

    def joined(words: Column, n: int):  # a second parameter of the function would be the element's index
        return lambda i: F.concat_ws(" ", *(F.get(words, i - 1 + j) for j in range(n)))

    return X.let(F.regexp_extract_all(F.lower(X.text(c)), F.lit(rf"({TOKEN})"), 1), runs)


def char_terms(c: Column | str, low: int = 3, high: int = 5, fold: bool = True) -> Column:
    """Character n-grams within words, each padded with a space on both sides, over text without accents (fold) or as it is; a word shorter than n counts once whole."""
    words = F.filter(F.split(X.collapse(F.lower(X.fold_accents(c) if fold else X.text(c))), " "), lambda w: w != "")

    def cut(p: Column, n: int):
        return lambda i: F.substring(p, i, n)

    def grams(w: Column) -> Column:
        return X.let(F.concat(F.lit(" "), w, F.lit(" ")), padded)

    def padded(p: Column) -> Column:
        parts = [F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), cut(p, n))).otherwise(F.array(p) if n == low else F.array().cast("array<string>")) for n in range(low, high + 1)]
        return F.concat(*parts)

    return F.flatten(F.transform(words, grams))


def tfidf(df: DataFrame, key: str, terms: Column, min_df: int = 3, max_df: float = 0.6, most: int | None = None) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit length per row.

    Terms of fewer than min_df rows or more than max_df of them go; `most` keeps those of the highest corpus frequency (ties: the term).
    Rows of one key count as one text, each as a row. Terms are counted within packs of rows; only a term's counts are shuffled. Kept terms lie in files
    of BLOCK_BYTES in the shared folder, which a task reads one after another for each pack, so no row's terms are shuffled or sorted.
    """
    spark, rows = df.sparkSession, df.count()
    lists = df.select(key, terms.alias("_terms"))
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        lists = lists.groupBy(key).agg(F.flatten(F.collect_list("_terms")).alias("_terms"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in packs(batches):
            _, code, tf, names = counted(part.column("_terms"))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(code, minlength=len(names))), pa.array(np.bincount(code, tf, len(names)).astype(np.int64))], names=["term", "df", "total"])

    freq = lists.select("_terms").mapInArrow(count, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.lit(rows)))
    if most:
        freq = freq.orderBy(F.desc("total"), "term").limit(most)
    freq = written(freq.select("term", (F.ln((1 + F.lit(rows)) / (1 + F.col("df"))) + 1).alias("x")), "terms")
    files = TermFiles(freq)
    forget(freq)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in packs(batches):
            keys, (rows, codes, tfs, names) = part.column(key), counted(part.column("_terms"))
            del part  # its terms are counted
            idf = files.find(names)
            for a, b in whole_rows(rows):
                row, code, tf = rows[a:b], codes[a:b], tfs[a:b]
                kept = idf[code] > 0
                row, code, tf = row[kept], code[kept], tf[kept]
                w = (1 + np.log(tf)) * idf[code]
                w /= np.sqrt(np.bincount(row - rows[a], w * w))[row - rows[a]]
                for at in range(0, len(row), ROWS_OUT):
                    own = slice(at, at + ROWS_OUT)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[own])), names.take(pa.array(code[own])), pa.array(w[own])], names=[key, "term", "weight"])

    return lists.mapInArrow(weigh, f"`{key}` {df.schema[key].dataType.simpleString()}, term string, weight double")


class TermFiles:
    """Terms and a positive number x for each, in files of about BLOCK_BYTES in the shared folder; tasks read one after another, whatever there are."""

    def __init__(self, terms: DataFrame):
        size = terms.agg(F.sum(F.octet_length("term") + 12)).first()[0] or 0
        blocks, folder = -(-size // BLOCK_BYTES), fresh_path(terms.sparkSession, "term-blocks")

        def keep(block: tuple, table: pa.Table) -> pa.Table:
            put(folder, str(block[0].as_py()), table.select(["term", "x"]))
            return pa.table({"block": [block[0].as_py()]}, pa.schema([("block", pa.int64())]))

        dealt = terms.groupBy(F.pmod(F.xxhash64("term"), F.lit(max(blocks, 1))).alias("block"))
        self.known = sorted(r[0] for r in dealt.applyInArrow(keep, "block long").collect()) if blocks else []  # a number for each file
        self.folder, self._last = folder, (None, None)

    def find(self, names: pa.Array) -> np.ndarray:
        """The number of each name, 0 where it isn't there."""
        out = np.zeros(len(names))
        for number in self.known:
            if self._last[0] != number:
                self._last = number, take(self.folder, str(number)).combine_chunks()
            at = pc.fill_null(pc.index_in(names, value_set=self._last[1].column("term")), -1).to_numpy()
            out[at >= 0] = self._last[1].column("x").to_numpy()[at[at >= 0]]
        return out


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut and put together to about PACK terms each; none is held here while its pack is in use, but for the last one."""
    held, size = [], 0

    def pack() -> pa.RecordBatch:
        out = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            held.append(batch.slice(at, 256))
            size += len(held[-1].column("_terms").flatten())
            if size >= PACK:
                yield pack()
                size = 0
                pa.default_memory_pool().release_unused()
    if held:
        yield pack()


def counted(terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, count) of each list's distinct terms, by row, and the terms that the codes mean; sorted in place, as a worker holds few numbers for each term at once."""
    names = terms.flatten().dictionary_encode()
    n = max(1, len(names.dictionary))
    cell = np.array(pc.list_parent_indices(terms).to_numpy(zero_copy_only=False), np.int64)
    cell *= n
    cell += names.indices.to_numpy()
    names = names.dictionary
    cell.sort()
    first = np.empty(len(cell), bool)
    first[:1] = True
    np.not_equal(cell[1:], cell[:-1], out=first[1:])
    at = np.flatnonzero(first)
    tf = np.diff(at, append=len(cell)).astype(np.int32)
    del at
    cell = cell[first]
    return (cell // n).astype(np.int32), (cell % n).astype(np.int32), tf, names


def whole_rows(row: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ROWS_OUT sorted row numbers, none of which cuts a row."""
    a = 0
    while a < len(row):
        b = min(a + ROWS_OUT, len(row))
        b = int(np.searchsorted(row, row[b - 1], "right"))
        yield a, b
        a = b


class SublinearIdf(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Counts -> TF-IDF with sublinear counts, smooth idf and unit length, given the idf of each slot; saved and loaded with its pipeline."""

    source = Param(Params._dummy(), "source", "column of counts", TypeConverters.toString)
    target = Param(Params._dummy(), "target", "column of weights", TypeConverters.toString)
    idf = Param(Params._dummy(), "idf", "idf of each slot", TypeConverters.toListFloat)

    def __init__(self, source: str | None = None, target: str | None = None, idf: list[float] | None = None):
        super().__init__()
        if source is not None:
            self._set(source=source, target=target, idf=idf)

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        idf = np.asarray(self.getOrDefault("idf"))

        @F.udf(VectorUDT())
        def weigh(v):
            w = (1 + np.log(v.values)) * idf[v.indices]
            n = np.sqrt((w * w).sum())
            return SparseVector(v.size, v.indices, w / n if n else w)

        # kept as a step of its own: merged into the assembler's function it could not run
        return df.withColumn(self.getOrDefault("target"), weigh.asNondeterministic()(self.getOrDefault("source")))


def text_block(df: DataFrame, column: str, most: int, min_df: int = 3, max_df: float = 0.6, grams: int = 2, terms: Column | None = None) -> tuple[PipelineModel, SublinearIdf]:
    """Vocabulary and weights of one field, fitted on the training rows only; terms are words and pairs of words unless given."""
    base = df.withColumn(f"{column}_terms", word_terms(column, grams) if terms is None else terms)
    model = CountVectorizer(inputCol=f"{column}_terms", outputCol=f"{column}_tf", vocabSize=most, minDF=min_df, maxDF=max_df).fit(base)
    n = df.count()
    counts = model.setBinary(True).transform(base).select(f"{column}_tf")
    from pyspark.ml.stat import Summarizer

    import numpy as np

    freq = counts.select(Summarizer.sum(F.col(f"{column}_tf")).alias("s")).first()["s"].toArray() if model.vocabulary else np.zeros(0)

    model.setBinary(False)
    return model, SublinearIdf(f"{column}_tf", f"{column}_w", (np.log((1 + n) / (1 + freq)) + 1).tolist())


def _sized(block: tuple) -> list:
    """A text block and the size of its vectors, which the assembler would else look up in a row."""
    model, weigh = block
    return [model, weigh, VectorSizeHint(inputCol=weigh.getOrDefault("target"), size=max(1, len(model.vocabulary)), handleInvalid="optimistic")]


#: Character n-grams of the titles: terms at most.
CHARS = 120_000
#: Values of a categorical column that get a slot at most, the most frequent ones.
VALUES = 10_000


@dataclass(frozen=True)
class FeaturePlan:
    """What the assembled feature vector is made of: a block of words for each text column, one of character n-grams, one-hot values, numbers."""

    texts: tuple[str, ...]
    chars: str | None = None
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    floor: int = 20
    fold: bool = True
    stopwords: bool = False

    def prepared(self, df: DataFrame) -> DataFrame:
        """Rows with the columns that the fitted stages read: term lists and log1p of numbers. It needs nothing fitted."""
        terms = {f"{c}_terms": word_terms(X.remove_stopwords(c) if self.stopwords else c) for c in self.texts}
        if self.chars:
            terms["chars_terms"] = char_terms(self.chars, fold=self.fold)
        logs = {f"{c}_log": F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in self.numeric}
        values = {f"{c}_value": F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")) for c in self.categorical}
        return df.withColumns(terms | logs | values)

    def fit(self, train: DataFrame, prepared: bool = False) -> PipelineModel:
        """Stages that turn prepared rows into `features`, fitted on training rows; a value of fewer than `floor` rows encodes as an unknown one."""
        rows, stages, parts = train if prepared else self.prepared(train), [], []

        def add(name: str, block: tuple) -> None:
            if block[0].vocabulary:  # a field without any frequent term has no block
                stages.extend(_sized(block))
                parts.append(f"{name}_w")

        for c in self.texts:
            most = BLOCKS.get(c.removesuffix("_seg").removesuffix("_text").removesuffix("_masked"), BLOCKS.get(c, 30_000))
            add(c, text_block(rows, c, most, terms=F.col(f"{c}_terms")))
        if self.chars:
            add("chars", text_block(rows, "chars", CHARS, terms=F.col("chars_terms")))
        if self.categorical:
            often = lambda c: rows.groupBy(f"{c}_value").count().where(F.col("count") >= self.floor).orderBy(F.desc("count"), f"{c}_value").limit(VALUES)
            known = [sorted(r[0] for r in often(c).select(f"{c}_value").collect()) for c in self.categorical]  # VALUES rows
            at, out = [f"{c}_at" for c in self.categorical], [f"{c}_hot" for c in self.categorical]
            index = PipelineModel([StringIndexerModel.from_labels(labels, f"{c}_value", i, "keep") for c, labels, i in zip(self.categorical, known, at)])
            stages += [index, OneHotEncoder(inputCols=at, outputCols=out, dropLast=False).fit(index.transform(rows))]
            parts += out
        if self.numeric:
            raw = VectorAssembler(inputCols=[f"{c}_log" for c in self.numeric], outputCol="numeric_raw")
            stages += [raw, MaxAbsScaler(inputCol="numeric_raw", outputCol="numeric_scaled").fit(raw.transform(rows))]
            parts.append("numeric_scaled")
        return PipelineModel([*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def slots(values: DataFrame, group: str, value: str, floor: int = 20) -> DataFrame:
    """Rows of (group, value) with `slot`, the value's place among the group's values of `floor` rows or more; other rows go."""
    known = values.groupBy(group, value).agg(F.count("*").alias("_n")).where(F.col("_n") >= floor)
    at = known.select(group, value, (F.row_number().over(Window.partitionBy(group).orderBy(value)) - 1).alias("slot"))
    return values.join(at, [group, value])
