"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gives integer metrics. Per language and source, each metric is
summed up in a sketch of log-linear buckets (32 to each power of two, so a
quantile is right to 1/32); sketches are plain (group, bucket, count) rows that
merge by adding counts, are the same however the rows are dealt, and have at
most some 2,000 buckets.

Two rounds of sketches give the limits of a group. The fence of the word length
is SPREAD times the distance from median to quartile away from the median, and a
margin. The rates (symbols, repeated lines, repeated words) are then sketched
over the documents within CORE_SPREAD of these distances, the group's usual
text, so that noise doesn't raise them; a group's limit is its own fence from
the quartiles plus TWICE its high quantile. Groups of few documents use the merged
sketch of their language, or else of all. No group raises its own limit: it is
bounded by the fence of its language's and (rates only, as word lengths differ
by language) all groups' merged sketch, there with the smaller of both quartile
distances, and the part from the high quantile never passes CEILING, which is
what a group that is mostly noise gets. Rates are taken over a few more words or
lines than there are, so that one repeated line in a short text is no fault.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import ASCII_SPACE, add_columns, checkpoint, fresh, quoted, values

MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: A group with fewer documents is judged by a wider one; the same for its high quantile.
MIN_GROUP, MIN_TAIL = 50, 400
SPREAD, TAIL_PERCENT, TWICE = 6, 99, 2
#: The spread of word lengths up to which a document is the group's usual text.
CORE_SPREAD = 2
#: Hundredths of a code point added on both sides of the word length.
LENGTH_MARGIN = 100
#: Rates in thousandths: (what is always allowed, the most that a high quantile adds).
CEILING = {"symbols": (15, 60), "dup_lines": (15, 200), "repeats": (15, 150)}
METRICS = ("word_length", *CEILING)
#: Words and lines added to those of a text before a rate is taken.
MORE_WORDS, MORE_LINES = 200, 20
#: Threshold rows up to which they are broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _MULTIPLIERS[k]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    seen: dict[tuple[str, ...], list[int]] = {}
    for i in np.flatnonzero(twice):  # equal hashes are made sure of
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    inside = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                inside[i] += 1
                inside[i + window] -= 1
    return int((np.cumsum(inside)[:-1] > 0).sum())


def base_metrics(text: str | None) -> tuple[int, ...]:
    """Values of BASE for one text."""
    text = text or ""
    spaces = sum(map(text.count, ASCII_SPACE))
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: exactly [\x20\x09-\x0D]
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def with_base_metrics(docs: DataFrame, text_col: str = "text", out: str = "quality", keep_text: bool = True) -> DataFrame:
    """Adds the struct column `out` of BASE (long)."""
    kind = pa.struct([(n, pa.int64()) for n in BASE])
    field = T.StructField(out, T.StructType([T.StructField(n, T.LongType()) for n in BASE]))

    def make():
        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            rows = [base_metrics(t) for t in values(b.column(text_col))]
            cols = zip(*rows, strict=True) if rows else [[]] * len(BASE)
            return [pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(kind))]

        return batch

    return add_columns(docs, [field], make, () if keep_text else (text_col,))


def base_failed(q: str = "quality") -> Column:
    n = F.col(f"{q}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > REPEAT_PERCENT * n)


def _metrics(q: str) -> dict[str, Column]:
    def per(a: str, scale: int, b: str, more: int) -> Column:
        return F.floor(F.col(f"{q}.{a}") * scale / F.greatest(F.col(f"{q}.{b}") + more, F.lit(1))).cast("long")

    return {
        "word_length": per("word_chars", 100, "n_words", 0),
        "symbols": per("n_symbols", 1000, "n_words", MORE_WORDS),
        "dup_lines": per("n_dup_lines", 1000, "n_lines", MORE_LINES),
        "repeats": per("n_repeat_words", 1000, "n_words", MORE_WORDS),
    }


def sketches(measured: DataFrame, q: str = "quality", by: tuple[str, ...] = ("lang", "source"), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(*by, metric, low, n): n documents have a metric in the bucket that begins at low. Union and sum merge sketches."""
    values = {k: v for k, v in _metrics(q).items() if k in metrics}
    rows = measured.where(~base_failed(q)).select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("_v")) for k, v in values.items()))).alias("_m"))
    cut = F.expr("greatest(0, length(bin(_m._v)) - 6)")  # 6 leading bits stay: 32 buckets to a power of two
    rows = rows.select(*by, "_m.metric", cut.alias("_c"), "_m._v").withColumn("low", F.expr("shiftleft(shiftright(_v, _c), _c)"))
    return rows.groupBy(*by, "metric", "low").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, by: tuple[str, str] = ("lang", "source"), spread: int = SPREAD, length_margin: int = LENGTH_MARGIN, groups: DataFrame | None = None) -> DataFrame:
    """(*by, limits map<metric, struct<lo, hi>>) for every group of the sketches, or of `groups` (*by)."""
    a, b = by
    sketch = checkpoint(sketch)
    none = {c: F.lit(None).cast(sketch.schema[c].dataType).alias(c) for c in by}
    wide = sketch.groupBy("metric", "low").agg(F.sum("n").alias("n")).select(F.lit(0).alias("_level"), none[a], none[b], "metric", "low", "n")
    mid = sketch.groupBy(a, "metric", "low").agg(F.sum("n").alias("n")).select(F.lit(1).alias("_level"), a, none[b], "metric", "low", "n")
    every = wide.unionByName(mid).unionByName(sketch.select(F.lit(2).alias("_level"), a, b, "metric", "low", "n"))
    group = Window.partitionBy("_level", a, b, "metric")
    every = every.withColumn("_sum", F.sum("n").over(group.orderBy("low"))).withColumn("_all", F.sum("n").over(group))

    def quantile(p: int) -> Column:
        return F.min(F.when(F.col("_sum") * 100 >= F.col("_all") * p, F.col("low")))

    cut = every.groupBy("_level", a, b, "metric").agg(quantile(25).alias("q1"), quantile(50).alias("q2"), quantile(75).alias("q3"), quantile(TAIL_PERCENT).alias("tail"), F.first("_all").alias("n"))
    cut = checkpoint(cut.groupBy("_level", a, b).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("q1", "q2", "q3", "tail", "n")))).alias("_q")))
    row = cut.where("_level = 0").select("_q").first()  # one row at most
    names = ("q1", "q2", "q3", "tail", "n")
    all_q = {k: F.struct(*(F.lit(row[0][k][x] if row and k in row[0] else None).cast("long").alias(x) for x in names)) for k in METRICS}
    mid = cut.where("_level = 1").select(F.col(a).alias("_by_a"), F.col("_q").alias("_q1"))
    own = cut.where("_level = 2").select(F.col(a).alias("_own_a"), F.col(b).alias("_own_b"), F.col("_q").alias("_q2"))
    groups = groups or cut.where("_level = 2").select(a, b)
    joined = groups.join(own, F.col(a).eqNullSafe(F.col("_own_a")) & F.col(b).eqNullSafe(F.col("_own_b")), "left").join(mid, F.col(a).eqNullSafe(F.col("_by_a")), "left")
    limits = []
    for k in METRICS:
        own, lang, wide_q = F.col("_q2")[k], F.col("_q1")[k], all_q[k]

        def chosen(least: int) -> Column:
            return F.when(own["n"] >= least, own).when(lang["n"] >= least, lang).otherwise(wide_q)

        q = chosen(MIN_GROUP)
        if k in CEILING:
            always, most = CEILING[k]
            margin = always + F.least(F.coalesce(TWICE * chosen(MIN_TAIL)["tail"], F.lit(most)), F.lit(most))
        else:
            margin = length_margin + F.floor(q["q2"] / 32)  # the sketch's error
        lo, hi = [q["q2"] - spread * (q["q2"] - q["q1"]) - margin], [q["q2"] + spread * (q["q3"] - q["q2"]) + margin]
        for cap in [F.when(lang["n"] >= MIN_GROUP, lang)] + ([wide_q] if k in CEILING else []):
            least = spread * F.least(cap["q3"] - cap["q2"], cap["q2"] - cap["q1"]) + margin
            lo.append(cap["q2"] - least)
            hi.append(cap["q2"] + least)
        low = F.lit(None).cast("long") if k in CEILING else F.greatest(*lo)
        limits += [F.lit(k), F.struct(low.alias("lo"), F.least(*hi).cast("long").alias("hi"))]
    return joined.select(a, b, F.create_map(*limits).alias("limits"))


def limits_of(measured: DataFrame, q: str = "quality", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(*by, limits) of stored metrics: of the word length, and of the rates among documents of usual word length."""
    lengths = checkpoint(sketches(measured, q, by, ("word_length",)))
    first = thresholds(lengths, by)
    usual = judged(measured, thresholds(lengths, by, CORE_SPREAD, 0), q, by, "_usual", ("word_length",)).where("_usual")
    rates = thresholds(sketches(usual, q, by, tuple(CEILING)), by, groups=first.select(*by)).select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate(by)), F.col("limits").alias("_rates"))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    both = [x for k in METRICS for x in (F.lit(k), (F.col("_rates") if k in CEILING else F.col("limits"))[k])]
    return checkpoint(first.join(rates, on, "left").select(*by, F.create_map(*both).alias("limits")))


def judged(measured: DataFrame, limits: DataFrame, q: str = "quality", by: tuple[str, ...] = ("lang", "source"), out: str = "kept", metrics: tuple[str, ...] = METRICS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds the boolean column `out`: not base_failed and inside the limits of the row's group.

    The limits are broadcast only after their rows are counted.
    """
    few = limits.count() <= broadcast_rows
    names = fresh(measured, len(by) + 1, out)
    right = limits.select(*(F.col(c).alias(x) for c, x in zip(by, names)), F.col("limits").alias(names[-1]))
    on = F.lit(True)
    for c, x in zip(by, names):
        on = on & F.col(c).eqNullSafe(F.col(x))
    joined = measured.join(F.broadcast(right) if few else right, on, "left")
    inside = F.lit(True)
    for k, v in _metrics(q).items():
        if k in metrics:
            lo, hi = F.col(names[-1])[k]["lo"], F.col(names[-1])[k]["hi"]
            inside = inside & F.coalesce(v >= lo, F.lit(True)) & F.coalesce(v <= hi, F.lit(True))
    return joined.withColumn(out, ~base_failed(q) & inside).drop(*names)


def _measured(docs: DataFrame, text_col: str, by: tuple[str, str], *more: str) -> DataFrame:
    """Stored metrics (*more, *by, quality) without texts."""
    return checkpoint(with_base_metrics(docs.select(*more, *by, F.col(text_col).alias("_text")), "_text", keep_text=False))


def measure_and_judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(id, *by, quality, base_failed, kept) of every row; texts are measured once.

    Defined cases: a null or empty text has no words and fails the base rule. A
    null language or source is a group of its own. Repeated rows are judged
    each. An empty table gives no rows. Other columns are ignored.
    """
    measured = _measured(docs, text_col, by, id_col)
    return judged(measured, limits_of(measured, by=by), by=by).withColumn("base_failed", base_failed())


def keep_good(docs: DataFrame, text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Rows of `docs` that are kept, with its columns. Texts are measured twice, so that none is shuffled or stored.

    Defined cases: as of `measure_and_judge`; columns of `docs` may have any
    names.
    """
    limits = limits_of(_measured(docs, text_col, by), by=by)
    q, kept = fresh(docs, 2)
    return judged(with_base_metrics(docs, text_col, q), limits, q, by, kept).where(F.col(kept)).select(*(F.col(quoted(c)) for c in docs.columns))
