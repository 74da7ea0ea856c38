"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model is of characters: every code point of the lower-cased text counts as
itself, runs of white space are one blank, and n-grams of 1 to 5 code points
reach from word to word. The tables (n-gram, count, probability, back-off) are
counted from all trusted text, grow with it, and are built by joins sharded by
n-gram. Documents are read once into their distinct n-grams, with the count in
each document; these are joined to the tables, and where an n-gram is unseen to
its context's back-off and the next shorter n-gram. Sums by document give the
perplexity. A trusted document's n-grams count as seen only where they are found
elsewhere too. A document is kept if its perplexity is within the quantile-based
threshold of its language.

The joins are the same at every size. The table's side is broadcast where it is
counted and small (MODEL_ROWS); otherwise both sides are dealt out by n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Code points of the longest n-gram; an n-gram is two longs with BITS for each code point (plus 1; 0 stands before the text).
ORDER, BITS = 5, 21
_IN_LOW = 2
#: Code points whose n-grams are sorted together.
CHARS = 1_000_000
#: N-grams of the model's text that a task holds before it sends them.
HELD = 4_000_000
#: Trusted ids up to which they are broadcast (8 bytes each, some 100 MB in a hash table).
BROADCAST_IDS = 2_000_000
#: Rows of the model up to which it is broadcast (some 64 bytes each in a hash table).
MODEL_ROWS = 4_000_000
#: Steps of log-perplexity in the quantile sketch, in a nat.
STEPS = 64
#: A language's threshold: its trusted texts' quantile, plus a margin in nats.
QUANTILE, MARGIN = 0.95, 0.25
#: A language with fewer trusted texts takes the threshold of all.
MIN_TRUSTED = 50


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hi, lo, n) of the distinct n-grams that end at each code point of each normalised text.

    Rows of one n-gram stand together, its texts in order.
    """
    size = np.array([len(t) for t in texts], np.int64)
    pad = ORDER - 1
    raw = np.frombuffer("".join("\0" * pad + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.repeat(np.cumsum(size + pad) - size - pad, pad) + np.tile(np.arange(pad), len(texts))
    real = np.ones(len(raw), bool)
    real[before] = False
    ends = np.flatnonzero(real)
    chars = np.unique(raw[real])
    code = np.searchsorted(chars, raw).astype(np.uint64) + np.uint64(1)
    code[before] = 0
    bits = np.uint64(len(chars).bit_length())
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), size)
    own_bits = np.uint64(len(texts).bit_length())
    if int(bits) * ORDER + int(own_bits) <= 64:  # all in one number
        key = code[ends - pad]
        for k in range(pad - 1, -1, -1):
            key = (key << bits) | code[ends - k]
        key, n = np.unique((key << own_bits) | text, return_counts=True)
        text = key & ((np.uint64(1) << own_bits) - np.uint64(1))
        key >>= own_bits
        mask = (np.uint64(1) << bits) - np.uint64(1)
        point = np.concatenate([[0], chars.astype(np.int64) + 1])
        at = [point[(key >> (bits * np.uint64(k)) & mask).astype(np.int64)] for k in range(ORDER)]  # the last first
        lo, hi = at[0] | at[1] << BITS, at[2] | at[3] << BITS | at[4] << 2 * BITS
    else:
        point = np.where(real, raw.astype(np.int64) + 1, 0)
        lo = point[ends] | point[ends - 1] << BITS
        hi = point[ends - 2] | point[ends - 3] << BITS | point[ends - 4] << 2 * BITS
        order = np.lexsort((text, lo, hi))
        text, hi, lo = text[order], hi[order], lo[order]
        new = _starts(hi, lo)
        new[1:] |= text[1:] != text[:-1]
        first = np.flatnonzero(new)
        text, hi, lo, n = text[first], hi[first], lo[first], np.diff(np.append(first, len(order)))
    return text.astype(np.int64), hi, lo, n.astype(np.int64)


def _starts(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Where an n-gram is not the one before."""
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return new


def _parts(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of texts of about CHARS code points, of `most` texts at most."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARS or i - start + 1 >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def document_grams(docs: DataFrame) -> DataFrame:
    """(own, hi, lo, most, docs, n) of (doc, own, text): the n-grams of the highest order.

    A row is a distinct n-gram of up to 1,000 documents that a task reads
    together: the documents that have it and how often each, at most `most`.
    Documents of `own` and others don't share a row.
    """
    schema = "own boolean, hi long, lo long, most long, docs array<long>, n array<long>"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, is_own = b.column("doc").to_numpy(), b.column("own").to_numpy(zero_copy_only=False)
            texts = [normalised(t) for t in b.column("text").to_pylist()]
            for start, end in _parts(texts, 1000):
                for own in (False, True):
                    rows = start + np.flatnonzero(is_own[start:end] == own)
                    which, hi, lo, n = grams_of([texts[i] for i in rows])
                    if not len(n):
                        continue
                    first = np.flatnonzero(_starts(hi, lo))
                    ends = pa.array(np.append(first, len(n)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids[rows][which], n)]
                    cols = [pa.array(np.full(len(first), own)), pa.array(hi[first]), pa.array(lo[first]), pa.array(np.maximum.reduceat(n, first)), *lists]
                    yield pa.RecordBatch.from_arrays(cols, names=["own", "hi", "lo", "most", "docs", "n"])

    return docs.select("doc", "own", "text").mapInArrow(counted, schema)


def count_grams(texts: DataFrame) -> DataFrame:
    """(hi, lo, n) of all rows' texts together; a task sends an n-gram once for every HELD that it finds."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            hi, lo, n = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 3
            held.clear()
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            first = np.flatnonzero(_starts(hi, lo))
            sums = np.add.reduceat(n[order], first) if len(first) else n
            return pa.RecordBatch.from_arrays([pa.array(hi[first]), pa.array(lo[first]), pa.array(sums)], names=["hi", "lo", "n"])

        for b in batches:
            rows = [normalised(t) for t in b.column("text").to_pylist()]
            for start, end in _parts(rows, 1000):
                _, hi, lo, n = grams_of(rows[start:end])
                first = np.flatnonzero(_starts(hi, lo))
                held.append((hi[first], lo[first], np.add.reduceat(n, first) if len(first) else n))
                if sum(len(x[0]) for x in held) > HELD:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(counted, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _last(k: int, hi: Column, lo: Column) -> list[Column]:
    """The n-gram of the last k code points."""
    in_high = max(0, k - _IN_LOW)
    return [hi.bitwiseAND((1 << BITS * in_high) - 1) if in_high else F.lit(0).cast("long"), lo.bitwiseAND((1 << BITS * min(k, _IN_LOW)) - 1)]


def _context(hi: Column, lo: Column) -> list[Column]:
    """All code points but the last."""
    return [F.shiftright(hi, BITS), F.shiftright(lo, BITS).bitwiseOR(F.shiftleft(hi.bitwiseAND((1 << BITS) - 1), BITS))]


def _key(k: int, hi: Column, lo: Column) -> Column:
    return F.xxhash64(F.lit(k), hi, lo)


def discounts(level: DataFrame) -> list[float]:
    """Of modified Kneser-Ney for counts 1, 2 and from 3, from the counts of counts."""
    r = {int(k): int(c) for k, c in level.where("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (r.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    return [min(max(x, 0.05), k - 0.05) if ok else 0.5 * k for k, x, ok in ((1, 1 - 2 * y * n2 / max(n1, 1), n1), (2, 2 - 3 * y * n3 / max(n2, 1), n2), (3, 3 - 4 * y * n4 / max(n3, 1), n3))]


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float]:
    """The model of (hi, lo, n), and the log-probability of an unseen code point.

    Rows (order, hi, lo, seen, log_p, log_backoff): an n-gram's count in the
    text, its full interpolated log-probability, and its weight as a context
    (null: none). An n-gram that only stands before others has no log_p.
    """
    hi, lo, zero = F.col("hi"), F.col("lo"), F.lit(0).cast("long")
    levels = [checkpoint(counts.withColumn("seen", F.col("n")))]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: unlike code points before the rest
        h, x = _last(k, hi, lo)
        levels.insert(0, checkpoint(levels[0].groupBy(h.alias("hi"), x.alias("lo")).agg(F.count("*").alias("n"), F.sum("seen").alias("seen"))))
    row = levels[0].agg(F.sum("n"), F.count("*")).first()
    total, alphabet = int(row[0] or 0), int(row[1])
    tables: list[DataFrame] = []
    unseen, lower = 0.0, None
    for k, level in enumerate(levels, 1):
        d = discounts(level)
        own = level.withColumn("_off", F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]))
        if k == 1:
            off = own.agg(F.sum("_off")).first()[0] or 0.0
            base = (off / total if total else 1.0) / (alphabet + 1)
            unseen = float(np.log(base))
            here = own.select("hi", "lo", ((F.col("n") - F.col("_off")) / F.lit(max(total, 1)) + F.lit(base)).alias("p"), "seen")
        else:
            (ch, cl), (sh, sl) = _context(hi, lo), _last(k - 1, hi, lo)
            own = own.withColumns({"_ch": ch, "_cl": cl, "_sh": sh, "_sl": sl})
            ctx = checkpoint(own.groupBy("_ch", "_cl").agg(F.sum("n").alias("_all"), F.sum("_off").alias("_offs")))
            back = ctx.select(F.col("_ch").alias("hi"), F.col("_cl").alias("lo"), F.log(F.col("_offs") / F.col("_all")).alias("log_backoff"))
            tables.append(lower.withColumn("log_p", F.log("p")).drop("p").join(back, ["hi", "lo"], "full").withColumn("order", F.lit(k - 1)))
            tail = lower.select(F.col("hi").alias("_sh"), F.col("lo").alias("_sl"), F.col("p").alias("_p"))
            p = (F.col("n") - F.col("_off") + F.col("_offs") * F.col("_p")) / F.col("_all")
            here = own.join(ctx, ["_ch", "_cl"]).join(tail, ["_sh", "_sl"]).select("hi", "lo", p.alias("p"), "seen")
        lower = checkpoint(here)
    tables.append(lower.withColumn("log_p", F.log("p")).drop("p").withColumns({"log_backoff": F.lit(None).cast("double"), "order": F.lit(ORDER)}))
    names = ["order", "hi", "lo", "seen", "log_p", "log_backoff"]
    out = tables[0].select(names)
    for t in tables[1:]:
        out = out.union(t.select(names))
    return out.withColumn("seen", F.coalesce("seen", zero)), unseen


def scores(grams: DataFrame, model: DataFrame, unseen: float, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(doc, log_perplexity) of the documents of `document_grams`.

    Where `own`, the documents are part of the text of the model: an n-gram is
    seen only if the text has it more often than each of them (a second document
    of the row is enough).
    """
    table = checkpoint(model.select(_key(F.col("order"), F.col("hi"), F.col("lo")).alias("_k"), "seen", "log_p", "log_backoff"))
    small = table.count() <= model_rows

    def looked_up(rows: DataFrame, key: Column, **names: str) -> DataFrame:
        side = table.select(F.col("_k").alias("_mk"), *(F.col(c).alias(x) for c, x in names.items()))
        if small:  # what is found already isn't looked up; where rows are dealt out by key, nulls would meet in one task
            side, key = F.broadcast(side), F.when(F.col("_open"), key)
        return rows.join(side, key == F.col("_mk"), "left").drop("_mk")

    hi, lo = F.col("hi"), F.col("lo")
    rows = grams.withColumns({"_log": F.lit(0.0), "_open": F.lit(True)})  # _open: not found so far
    least = F.when(F.col("own"), F.col("most")).otherwise(0)
    for k in range(ORDER, 0, -1):
        rows = looked_up(rows, _key(k, *_last(k, hi, lo)), seen="_seen", log_p="_p")
        hit = F.coalesce(F.col("_seen") > least, F.lit(False)) & F.col("_p").isNotNull()
        rows = rows.withColumn("_log", F.col("_log") + F.when(F.col("_open") & hit, F.col("_p")).otherwise(0.0)).withColumn("_open", F.col("_open") & ~hit).drop("_seen", "_p")
        if k > 1:
            rows = looked_up(rows, _key(k - 1, *_context(*_last(k, hi, lo))), log_backoff="_b")
            rows = rows.withColumn("_log", F.col("_log") + F.when(F.col("_open"), F.coalesce("_b", F.lit(0.0))).otherwise(0.0)).drop("_b")
    log_p = F.col("_log") + F.when(F.col("_open"), unseen).otherwise(0.0)
    each = rows.select(log_p.alias("_log_p"), "n", F.posexplode("docs").alias("_at", "doc")).select("doc", "_log_p", F.get("n", "_at").alias("n"))
    return each.groupBy("doc").agg((-F.sum(F.col("n") * F.col("_log_p")) / F.sum("n")).alias("log_perplexity"))


def thresholds(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, limit) of trusted rows (lang, log_perplexity), and a row of null language and `every` for all.

    From mergeable sketches: counts by language and step of 1 / STEPS nat.
    """
    steps = scored.where("log_perplexity is not null").groupBy("lang", F.floor(F.col("log_perplexity") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    every = steps.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "step", "n", F.lit(True).alias("every"))
    rows = steps.select(F.col("lang").cast("string"), "step", "n", F.lit(False).alias("every")).unionByName(every)
    w = Window.partitionBy("every", "lang")
    rows = rows.withColumn("_sum", F.sum("n").over(w.orderBy("step"))).withColumn("_all", F.sum("n").over(w))
    limit = F.min(F.when(F.col("_sum") >= F.col("_all") * quantile, (F.col("step") + 1) / STEPS)) + margin
    return rows.groupBy("every", "lang").agg(limit.alias("limit"), F.max("_all").alias("n"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(_good) of the ids with a label of quality 1 and none that is toxic."""
    by_id = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_good")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return by_id.where("q = 1 and t = 0").select("_good")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", broadcast_ids: int = BROADCAST_IDS, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(id, lang, log_perplexity, perplexity, limit, kept) of every row of `docs`.

    Trusted are rows whose id has a label of quality 1 and none that is toxic;
    all of them train the model and their language's threshold. Defined cases: a
    null, empty or blank text has null perplexity and isn't kept; a null
    language, or one of few trusted texts, takes the threshold of all; without
    trusted text all texts are kept; repeated labels count once; null ids are
    never trusted; repeated rows are scored alike and stay; other columns of
    `docs` are ignored, whatever their names; an empty table gives no rows.
    """
    good = checkpoint(trusted_ids(labels))
    side = F.broadcast(good) if good.count() <= broadcast_ids else good
    base = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("doc", F.xxhash64("_id", "text"))
    base = base.join(side.withColumn("own", F.lit(True)), F.col("_id") == F.col("_good"), "left").drop("_good").withColumn("own", F.coalesce("own", F.lit(False)))
    model, unseen = kneser_ney(count_grams(base.where("own")))
    found = scores(document_grams(base), model, unseen, model_rows)
    scored = checkpoint(base.select("_id", "lang", "own", "doc").join(found, "doc", "left"))
    limits = checkpoint(thresholds(scored.where("own")))
    own = limits.where((~F.col("every")) & (F.col("n") >= MIN_TRUSTED) & F.col("lang").isNotNull()).select(F.col("lang").alias("_lang"), F.col("limit").alias("_own"))
    row = limits.where("every").select("limit").first()
    wide = F.lit(row[0] if row else None).cast("double")
    out = scored.join(own, F.col("lang") == F.col("_lang"), "left").withColumn("limit", F.coalesce("_own", wide))
    kept = F.col("log_perplexity").isNotNull() & F.coalesce(F.col("log_perplexity") <= F.col("limit"), F.lit(True))
    return out.select(F.col("_id").alias(id_col), "lang", "log_perplexity", F.exp("log_perplexity").alias("perplexity"), "limit", kept.alias("kept"))
