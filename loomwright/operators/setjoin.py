"""Set-similarity join of texts' character n-grams with those of a smaller stated side (a benchmark).

Grams are put in order of rarity. A pair that shares the required part of an item's
n grams shares one of its first n - required + 1, so only those are indexed (the
prefix), and grams that most items have are never expanded; for Jaccard the same
holds for the document, and sizes bound what can be similar at all. Candidates are
counted exactly. The best item of each document needs all counts: those of common
grams come from a matrix product over many documents at once, the others from postings.

An index that fits is sent to the tasks, so that no gram is shuffled. A larger side
is joined by its prefixes, with the candidates' counts in a second step.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import char_ngrams, jaccard_of_counts, normalize

#: Bytes of the matrix of common grams, and documents that are multiplied by it at once.
MATRIX_BYTES, ROWS_AT_ONCE = 32_000_000, 64


def required(n: int, least: float) -> int:
    """Grams of a set of n that a similar set shares at least; never too many by rounding."""
    return max(1, ceil(least * n - 1e-9))


def normal(text: str | None) -> str:
    return "".join((text or "").lower().split())


def gram_hashes(text: str, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of a normalised text; of the text itself if it is shorter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(points):
        return np.empty(0, np.uint64)
    width = min(n, len(points))
    h = np.full(len(points) - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ points[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


class GramIndex:
    """Grams of all items by rarity. A gram's number is its place in that order, so 0 is the rarest.

    hashes, numbers: the sorted gram hashes and their numbers; sizes: grams of each
    item; own: each item's gram numbers, ascending; prefix postings: (start, items) by gram number.
    """

    def __init__(self, texts: list[str], n: int, least: float) -> None:
        self.n, self.least = n, least
        each = [gram_hashes(normal(t), n) for t in texts]
        self.sizes = np.array([len(h) for h in each], np.int64)
        item = np.repeat(np.arange(len(each)), self.sizes)
        grams = np.concatenate(each) if each else np.empty(0, np.uint64)
        self.hashes, at, count = np.unique(grams, return_inverse=True, return_counts=True)
        rarest_first = np.lexsort((self.hashes, count))
        self.numbers = np.empty(len(self.hashes), np.int64)
        self.numbers[rarest_first] = np.arange(len(self.hashes))
        numbers, count = self.numbers[at], count[rarest_first]
        order = np.lexsort((numbers, item))
        self.own, self.first = numbers[order], np.concatenate([[0], np.cumsum(self.sizes)])
        if least:
            wanted = np.array([s - required(s, least) + 1 if s else 0 for s in self.sizes.tolist()], np.int64)
            place = np.arange(len(item)) - np.repeat(self.first[:-1], self.sizes)
            some = place < np.repeat(wanted, self.sizes)
            self.start, self.items = self._postings(self.own[some], item[some])
        else:  # all of them; the commonest grams as a matrix
            wide = min(int((count > max(8, len(each) // 32)).sum()), MATRIX_BYTES // 4 // max(1, len(each)))
            self.common = len(count) - wide
            is_common = numbers >= self.common
            self.matrix = np.zeros((wide, len(each)), np.float32)
            self.matrix[numbers[is_common] - self.common, item[is_common]] = 1
            self.start, self.items = self._postings(numbers[~is_common], item[~is_common])

    def _postings(self, numbers: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((items, numbers))
        return np.searchsorted(numbers[order], np.arange(len(self.hashes) + 1)), items[order]

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Ascending numbers of those of some sorted gram hashes that any item has."""
        at = np.searchsorted(self.hashes, hashes)
        at = at[at < len(self.hashes)]  # the hashes are sorted, so these are the first ones
        return np.sort(self.numbers[at[self.hashes[at] == hashes[: len(at)]]])

    def _with(self, numbers: np.ndarray) -> np.ndarray:
        """Items in the postings of some grams, as often as they are there."""
        size = self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(size)
        return self.items[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[numbers] - ends + size, size)]

    def similar(self, hashes: np.ndarray, of_both: bool, mask: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared grams) of the items similar to a document: by Jaccard (of_both), or by the share of the item's own grams.

        mask: False for each gram number; it is so again afterwards.
        """
        a, least = len(hashes), self.least
        if of_both and (not a or required(a, least) > self.sizes.max(initial=0)):
            return []
        numbers = self.found(hashes)
        # What no item has comes before all of these in the document's own prefix.
        head = numbers[: max(0, a - required(a, least) + 1 - (a - len(numbers)))] if of_both else numbers
        items = np.unique(self._with(head))
        if of_both:
            items = items[(self.sizes[items] >= least * a - 1e-9) & (a >= least * self.sizes[items] - 1e-9)]
        mask[numbers] = True
        out = [(i, int(mask[self.own[self.first[i] : self.first[i + 1]]].sum())) for i in items.tolist()]
        mask[numbers] = False
        return [(i, both) for i, both in out if both and (both >= least * (a + self.sizes[i] - both) if of_both else both >= least * self.sizes[i])]

    def shared(self, documents: list[np.ndarray]) -> np.ndarray:
        """Shared grams of each document (its gram hashes) with each item."""
        common = np.zeros((len(documents), len(self.matrix)), np.float32)
        out = np.zeros((len(documents), len(self.sizes)), np.int64)
        for k, hashes in enumerate(documents):
            numbers = self.found(hashes)
            cut = np.searchsorted(numbers, self.common)
            out[k] = np.bincount(self._with(numbers[:cut]), minlength=len(self.sizes))
            common[k, numbers[cut:] - self.common] = 1
        return out + (common @ self.matrix).astype(np.int64)


def by_index(docs: DataFrame, bench: DataFrame, id_col: str, item_col: str, n: int, keep: str, least: float) -> DataFrame:
    """(id, item, _a, _b, _both) by an index in every task. keep: `jaccard` or `containment` of `least` or more, or the `best` Jaccard.

    Grams are 64-bit hashes: an accidental match is a matter of one in billions of texts.
    """
    given = bench.select(item_col, "text").orderBy(item_col).toArrow()  # the caller has checked the size
    items = given.column(0).to_pylist()
    sent = docs.sparkSession.sparkContext.broadcast((GramIndex(given.column(1).to_pylist(), n, 0.0 if keep == "best" else least), items))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, bench.schema[item_col].dataType), *[T.StructField(c, T.LongType()) for c in ("_a", "_b", "_both")]])
    kinds = [pa.array(items[:1]).type, pa.int64(), pa.int64(), pa.int64()]

    def pick(index: GramIndex, documents: list[np.ndarray], mask: np.ndarray):
        """(document, item, shared) to be kept."""
        if index.least:
            for k, hashes in enumerate(documents):
                yield from ((k, i, both) for i, both in index.similar(hashes, keep == "jaccard", mask))
            return
        shared = index.shared(documents)
        for k, hashes in enumerate(documents):
            both = shared[k]
            if keep == "best":
                i = int((both / np.maximum(len(hashes) + index.sizes - both, 1)).argmax()) if len(both) else 0
                some = [i] if len(both) and both[i] else []
            else:
                some = np.flatnonzero(both)
            yield from ((k, int(i), int(both[i])) for i in some)

    def run(batches):
        index, items = sent.value
        mask = np.zeros(len(index.hashes), bool)
        for batch in batches:
            at, rows = [], []
            texts = batch.column(1)
            for lo in range(0, len(texts), ROWS_AT_ONCE):
                documents = [gram_hashes(normal(t), n) for t in texts.slice(lo, ROWS_AT_ONCE).to_pylist()]
                for k, i, both in pick(index, documents, mask):
                    at.append(lo + k)
                    rows.append((items[i], len(documents[k]), int(index.sizes[i]), both))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], schema=pa.schema([pa.field(id_col, ids.type), *[pa.field(f.name, k) for f, k in zip(schema.fields[1:], kinds, strict=True)]]))

    return docs.select(id_col, "text").mapInArrow(run, schema)


def gram_sets(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, _g): the distinct grams of the normalised text."""
    return df.select(F.col(id_col), char_ngrams(normalize(F.col("text")), n).alias("_g"))


def grams_of(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """(id, n_grams, gram): a row for each distinct gram of the normalised text.

    explode_outer: with explode, the optimizer would make the grams twice.
    """
    return gram_sets(df, id_col, n).select(id_col, F.explode_outer("_g").alias("gram"), F.size("_g").alias("n_grams")).where("gram is not null")


def by_join(docs: DataFrame, bench: DataFrame, id_col: str, item_col: str, n: int, keep: str, least: float) -> DataFrame:
    """The same for a side too large to send: without a bound an equi-join on all grams, whose counts are summed
    before they are shuffled; with one, a join on the items' prefixes, and exact counts of the candidates."""
    a, b = grams_of(docs, id_col, n).withColumnRenamed("n_grams", "_a"), grams_of(bench, item_col, n).withColumnRenamed("n_grams", "_b")
    if not least:
        return a.join(b, "gram").groupBy(id_col, item_col, "_a", "_b").agg(F.count("*").alias("_both"))
    often = b.groupBy("gram").agg(F.count("*").alias("_often"))
    place = F.row_number().over(Window.partitionBy(item_col).orderBy("_often", "gram"))  # an item's own grams
    needed = F.greatest(F.lit(1), F.ceil(F.col("_b") * least - 1e-9))
    prefix = b.join(often, "gram").withColumn("_place", place).where(F.col("_place") <= F.col("_b") - needed + 1).select(item_col, "_b", "gram")
    pairs = a.join(prefix, "gram")
    if keep == "jaccard":
        pairs = pairs.where((F.col("_b") >= F.col("_a") * least - 1e-9) & (F.col("_a") >= F.col("_b") * least - 1e-9))
    pairs = pairs.select(id_col, item_col, "_a", "_b").distinct()
    both = pairs.join(gram_sets(docs, id_col, n), id_col).join(gram_sets(bench, item_col, n).withColumnRenamed("_g", "_h"), item_col)
    return both.select(id_col, item_col, "_a", "_b", F.size(F.array_intersect("_g", "_h")).cast("long").alias("_both"))


def jaccard(sums: DataFrame):
    return jaccard_of_counts(F.col("_both"), F.col("_a"), F.col("_b"))
