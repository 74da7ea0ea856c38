"""A generation loop whose next topics follow from all results so far, held as streaming state.

Each batch of results is one cycle. Partial sums are made where the rows are, so a
loop's group has a row for each task and topic, whatever the size of the batch. The
state has each topic's results and failures, and the number of cycles; it is in
the query's checkpoint, so a restarted loop goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Results that a topic needs before it can be weak; weakest topics and topics in all that a cycle takes.
LEAST_RESULTS, WEAKEST, CHOSEN = 3, 3, 6

_SUMS = ["correct", "total", "failed"]
_STATE = "cycle long, topic array<string>, correct array<long>, total array<long>, failed array<long>"
PLAN = "loop string, cycle long, place int, topic string, reason string, accuracy double, total long, failed long"


def choose(stats: dict[str, tuple[int, int, int]], topics: list[str], cycle: int, weakest: int = WEAKEST, chosen: int = CHOSEN, most_failures: int | None = None) -> list[tuple[str, str]]:
    """(topic, reason) of the cycle: the weakest ones first, then the others in turn, from one further with every cycle.

    stats: (correct, total, failed) by topic; equal accuracies go by name. Topics with more
    than most_failures failures are left out. A topic is taken once, so there may be fewer than `chosen`.
    """
    failed = lambda t: stats.get(t, (0, 0, 0))[2]
    able = lambda t: most_failures is None or failed(t) <= most_failures
    known = sorted((c / n, t) for t, (c, n, _) in stats.items() if n >= LEAST_RESULTS and able(t))
    out = [(t, "weak") for _, t in known[: min(weakest, chosen)]]
    for k in range(len(topics)):
        t = topics[(cycle - 1 + k) % len(topics)]
        if len(out) >= chosen:
            break
        if able(t) and t not in {x for x, _ in out}:
            out.append((t, "turn"))
    return out


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b.groupby(["loop", "topic"], as_index=False)[_SUMS].sum() for b in batches]
    if parts:
        yield pd.concat(parts).groupby(["loop", "topic"], as_index=False)[_SUMS].sum()


def plans(results: DataFrame, topics: list[str], weakest: int = WEAKEST, chosen: int = CHOSEN, most_failures: int | None = None) -> DataFrame:
    """Rows of PLAN for each batch of a stream of (loop, topic, correct, total, failed), numbers long and not null.

    Results without a loop or a topic are left out; a topic of the results that is
    not in `topics` can be weak, but isn't taken in turn. Written in append mode.
    """
    named = results.where("loop is not null and topic is not null").select("loop", "topic", *_SUMS)
    sums = named.mapInPandas(_partial, "loop string, topic string, correct long, total long, failed long")

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cycle, stats = 0, {}
        if state.exists:
            cycle, names, *held = state.get
            stats = {t: tuple(x) for t, *x in zip(names, *held, strict=True)}
        for b in rows:
            for t, *x in b[["topic", *_SUMS]].itertuples(index=False):
                stats[t] = tuple(int(a + c) for a, c in zip(stats.get(t, (0, 0, 0)), x, strict=True))
        cycle += 1
        names = sorted(stats)
        state.update((cycle, names, *([stats[t][k] for t in names] for k in range(3))))
        out = []
        for place, (t, reason) in enumerate(choose(stats, topics, cycle, weakest, chosen, most_failures)):
            correct, total, failed = stats.get(t, (0, 0, 0))
            out.append((key[0], cycle, place, t, reason, correct / total if total else None, total, failed))
        yield pd.DataFrame(out, columns=["loop", "cycle", "place", "topic", "reason", "accuracy", "total", "failed"])

    return sums.groupBy("loop").applyInPandasWithState(step, PLAN, _STATE, "append", GroupStateTimeout.NoTimeout)
