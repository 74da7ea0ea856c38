"""Periodic runs of words, by partition refinement.

The positions of a text are kept in classes: at level p two positions are in one
class where the p words from there are equal. Level 1 has a class for each word.
From level p to p + 1 a position moves by the class of the next one; it is enough
to look at the smaller parts of the classes that were split before, so a position
moves at most log2(n) times, whatever the number of levels. Members of a class
are linked in text order. Two neighbours whose distance is p at level p begin a
square (the p words twice); its root is primitive, as else a member would lie
between them. A stretch of such positions for one period is a run, and a run with
three periods or more in it is known before level n / 3, where a text is left.

The texts of an Arrow slice are refined together, each with a stop of its own, and
a level's moves are array operations: a level costs some dozen numpy calls, and not
a Python step for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, utf8

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Bytes of texts that are refined together (and at least one text): some 30 bytes of memory for each byte.
SLICE_BYTES = 12_000_000


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ... start[0] + size[0] - 1, start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a value of any of the (not empty) arrays differs from the one before it, and 0."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sizes(heads: np.ndarray, n: int) -> np.ndarray:
    """From each head to the next one, or to n."""
    out = np.empty(len(heads), np.int64)
    out[:-1] = heads[1:] - heads[:-1]
    out[-1:] = n - heads[-1:]
    return out


class Refinement:
    """Classes of the positions of many texts, refined level by level.

    words: a number for each position; a text's last position is a stop that no
    other position equals. limit: for each position, the last level that its text needs.
    """

    def __init__(self, words: np.ndarray, limit: np.ndarray) -> None:
        n = len(words)
        self.limit, self.level = limit, 1
        self.members = np.argsort(words, kind="stable")  # the members of a class stand together here, in any order
        self.place = np.empty(n, np.int64)
        self.place[self.members] = np.arange(n)
        first = _heads(words[self.members])
        self.start, self.size, self.n_classes = np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1, np.int64), len(first)  # a tree with n leaves
        self.start[: len(first)], self.size[: len(first)] = first, _sizes(first, n)
        self.cls = np.empty(n, np.int64)
        self.cls[self.members] = np.repeat(np.arange(len(first)), self.size[: len(first)])
        self.after, self.before, self.born = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
        linked = self.cls[self.members[1:]] == self.cls[self.members[:-1]]
        a, b = self.members[:-1][linked], self.members[1:][linked]
        self.after[a], self.before[b] = b, a
        self.todo = np.arange(len(first))
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _unlink(self, a: np.ndarray, until: np.ndarray | int) -> None:
        """Notes the squares at `a`, whose links held from born[a] to `until`."""
        gap = self.after[a] - a
        found = (self.born[a] <= gap) & (gap <= until)
        if found.any():
            self.squares.append((a[found], gap[found]))

    def step(self) -> None:
        """From this level to the next one, by the classes in `todo`."""
        small = _ranges(self.start[self.todo], self.size[self.todo])
        follower = self.members[small]
        moved = follower - 1
        ok = (moved >= 0) & (self.limit[moved] > self.level)
        ok[ok] = self.size[self.cls[moved[ok]]] > 1
        moved, by = moved[ok], self.cls[follower[ok]]
        self.level += 1
        self.todo = moved[:0]
        if not len(moved):
            return
        order = np.lexsort((moved, by, self.cls[moved]))
        moved, by = moved[order], by[order]
        old = self.cls[moved]
        head = _heads(old, by)  # where a group begins
        group_size, group_old = _sizes(head, len(moved)), old[head]
        splits = group_size < self.size[group_old]  # else it is all of its class, and nothing changes
        moved = moved[np.repeat(splits, group_size)]
        if len(moved):
            self._split(moved, group_size[splits], group_old[splits])

    def _split(self, moved: np.ndarray, group_size: np.ndarray, group_old: np.ndarray) -> None:
        """Makes a class of each group of `moved`, which lie by class, group and position."""
        self._relink(moved, group_size)
        first = _heads(group_old)  # the first group of each class that is split
        groups = _sizes(first, len(group_old))
        parent, total = group_old[first], np.add.reduceat(group_size, first)
        stop = self.start[parent] + self.size[parent]
        tail = _ranges(stop - total, total)  # the moved members go to the end of their class
        shift = (np.cumsum(total) - stop).repeat(total)  # from a place in a class' tail to one in `tail`
        at = self.place[moved]
        is_tail = at + shift >= (np.cumsum(total) - total).repeat(total)
        staying = np.ones(len(tail), bool)
        staying[(at + shift)[is_tail]] = False
        left, free = self.members[tail[staying]], at[~is_tail]
        self.members[free], self.place[left] = left, free
        self.members[tail], self.place[moved] = moved, tail
        new = np.arange(self.n_classes, self.n_classes + len(group_size))
        self.n_classes += len(new)
        offset = np.cumsum(group_size) - group_size
        self.start[new] = np.repeat(stop - total - offset[first], groups) + offset
        self.size[new] = group_size
        self.size[parent] -= total
        self.cls[moved] = np.repeat(new, group_size)
        # Of the parts of a class all but a largest one are looked at in the next step.
        largest = np.lexsort((-group_size, np.repeat(parent, groups)))[first] if len(groups) < len(new) else first
        rest = self.size[parent]
        rest_is_largest = rest >= group_size[largest]
        looked = np.ones(len(new), bool)
        looked[largest[~rest_is_largest]] = False
        self.todo = np.concatenate([new[looked], parent[~rest_is_largest & (rest > 0)]])

    def _relink(self, moved: np.ndarray, group_size: np.ndarray) -> None:
        """Takes `moved` out of the links of their classes and links each group."""
        by_place = np.lexsort((moved, self.cls[moved]))
        m = moved[by_place]
        self._unlink(m, self.level - 1)
        begins = np.ones(len(m), bool)
        begins[1:] = self.after[m[:-1]] != m[1:]
        ends = np.append(begins[1:], True)
        left, right = self.before[m[begins]], self.after[m[ends]]
        has = left >= 0
        self._unlink(left[has], self.level - 1)
        self.after[left[has]], self.born[left[has]] = right[has], self.level
        self.before[right[right >= 0]] = left[right >= 0]
        same = np.ones(len(moved), bool)
        same[np.cumsum(group_size) - 1] = False  # the last of each group has no neighbour after it
        self.after[moved], self.before[moved], self.born[moved] = -1, -1, self.level
        a = np.flatnonzero(same)
        self.after[moved[a]], self.before[moved[a + 1]] = moved[a + 1], moved[a]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first position, length, period) of every run of two periods and more, by period and position."""
        most = int(self.limit.max(initial=0))
        while len(self.todo) and self.level < most:
            self.step()
        self._unlink(np.arange(len(self.limit)), self.limit)
        if not self.squares:
            return (np.empty(0, np.int64),) * 3
        at, period = (np.concatenate(x) for x in zip(*self.squares, strict=True))
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        begins = _heads(period, at - np.arange(len(at)))
        n = _sizes(begins, len(at))
        return at[begins], n - 1 + 2 * period[begins], period[begins]


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs in each array of word numbers, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    most = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    words = np.empty(int((sizes + 1).sum()), np.int64)
    for k, t in enumerate(texts):  # a text's words are its own, and so is its stop
        words[first[k] : first[k] + len(t)] = t + k * (most + 1)
        words[first[k] + len(t)] = k * (most + 1) + most
    start, length, period = Refinement(words, np.repeat(sizes // LEAST_PERIODS, sizes + 1)).runs()
    ok = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, start))
    rows = np.stack([start, length, period], axis=1)[order]
    cuts = np.searchsorted(rows[:, 0], np.append(first, len(words)))
    return [rows[a:b] - [f, 0, 0] for a, b, f in zip(cuts[:-1], cuts[1:], first, strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run, or in the first period of every run that holds them."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def strongest(runs: np.ndarray) -> list[int] | None:
    """The (start, length, period) with the greatest length / period; ties: smallest start, then period."""
    best = None
    for s, n, q in runs.tolist():  # by start and period, so the first of equal ones stays
        if best is None or n * best[2] > best[1] * q:
            best = [s, n, q]
    return best


def periodic_from(text_col: str, seed: Column) -> Column:
    """The text with an end made periodic where 10 divides `seed`: a way to plant runs of any period.

    With n words and g = seed / 10, each word from a = g % n on is word a + (i - a) % p,
    p = 1 + (n - a) / (3 + g % 8); the words are joined by one space. Other texts,
    nulls and texts without a word stay.
    """
    words, g = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), 0), F.floor(seed / 10)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # The array is made once, as the only member of another one.
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w))), 0)
    return F.when(seed % 10 == 0, F.coalesce(made, F.col(text_col))).otherwise(F.col(text_col))


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("strongest", RUNS.elementType),
    T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
]


_ROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_KIND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_ROW)), ("strongest", _ROW), ("runs_sha256", pa.string()), ("collapsed", pa.string()), ("collapsed_sha256", pa.string())])


def _slices(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts as bytes, of some SLICE_BYTES together; a null is empty."""
    part, size = [], 0
    for t in utf8(texts):
        part.append(t or b"")
        size += len(part[-1])
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    yield part


def _rows(texts: list[bytes], with_text: bool) -> Iterator[dict]:
    """What FIELDS say, of each text."""
    words = [t.split() for t in texts]  # bytes.split() parts at the six characters of ASCII white space
    numbers = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    found = find_runs(np.split(numbers, np.cumsum([len(w) for w in words])[:-1]))
    as_row = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
    for w, runs in zip(words, found, strict=True):
        rows, best = runs.tolist(), strongest(runs)
        text = b" ".join(compress(w, kept_words(len(w), runs).tolist()) if rows else w)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
        yield {
            "n_words": len(w), "runs": list(map(as_row, rows)), "strongest": as_row(best) if best else None, "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
            "collapsed": text.decode() if with_text else None, "collapsed_sha256": hashlib.sha256(text).hexdigest(),
        }


def detect(docs: DataFrame, text_col: str = "text", out: str = "periods", with_text: bool = True) -> DataFrame:
    """Adds a struct `out` to every row: n_words, runs, the strongest one, digests, and the text with runs collapsed.

    Words are what lies between ASCII white space. A run is a maximal stretch of
    words with smallest period q, of at least max(24, 3 q) words. `collapsed` has the
    words that no run drops (each run drops what follows its first period), joined by
    one space; without with_text both texts stay behind and only digests travel.
    Defined cases: a null, empty or blank text has no words and no runs; a text of
    one word over and over is a run of period 1; equal exponents go to the smaller
    start, then the smaller period; repeated rows are rows like any other; an empty
    table gives no rows; a column named `out` is replaced, others stay. A text is
    worked on as a whole, in memory proportional to its length (some 200 bytes a word).
    """
    at = docs.columns.index(text_col)

    def make():
        return lambda b: [pa.array([r for part in _slices(b.column(at)) for r in _rows(part, with_text)], _KIND)]

    return add_columns(docs, [T.StructField(out, T.StructType(FIELDS))], make, drop=() if with_text else (text_col,))
