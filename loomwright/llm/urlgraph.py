"""URL filters: host rules, and trust and distrust over the link graph.

Rules are longest-match on host suffix and path. A url without a rule is judged
by its host: personalised PageRank from trusted seeds along host links, and
distrust from blocked seeds along reversed links, both computed over
aggregated host edges in Spark; each round is checkpointed in the shared folder.
These scores shrink with the number of links that a seed deals to. So each is
divided by the host's plain PageRank in the same direction, which shrinks alike:
that is the threshold of each host, and the share of its rank that comes from
the seeds. All four scores go through one loop of one join and one sum by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, LOWER, checkpoint

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A score's move shrinks by DAMPING with every round, so fewer rounds than this bring all below TOLERANCE of the score.
DAMPING, ROUNDS, TOLERANCE = 0.85, 200, 1e-6
#: A host is blocked if the share of distrust in its reversed rank is above the share of trust in its rank by so much.
MARGIN = 0.75
#: The same where only links count, not pages of its own: most of the rank that links bring is distrust.
LINK_MARGIN = 0.5


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones are asked first, so come last here
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between unlike hosts, from absolute and scheme-relative references."""
    refs = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?(//[^"'\s>]+)"""), 1)
    links = pages.where(F.instr(html_col, "//") > 0).select(host_of(F.col(url_col)).alias("src"), F.explode_outer(F.array_distinct(refs)).alias("_ref"))
    links = links.where(F.col("_ref").isNotNull()).select("src", host_of(F.concat(F.lit(":"), F.col("_ref"))).alias("dst"))
    return links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


SCORES = ("trust", "distrust", "rank", "back_rank")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, rank, back_rank) of all hosts of the edges (src, dst, n) and the seeds (host, trusted, blocked).

    Personalised PageRank: a score is (1 - damping) * seed + damping * what comes in, and
    a host deals its score out by n. trust goes from the trusted along links, distrust
    from the blocked against them; rank and back_rank are the same with every host as
    a seed of 1. A host without links deals nothing out. Runs until no score
    moves by more than `tolerance` of itself; raises if that takes more than `rounds`.
    """
    ends = [F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("along")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(False).alias("along"))]
    both = edges.select(F.explode(F.array(*ends)).alias("_e"), "n").select("_e.*", "n")
    dealt = checkpoint(both.groupBy("a", "along").agg(F.sum("n").alias("_out")))  # stored, so that a host with many links is split
    ways = checkpoint(both.join(dealt, ["a", "along"]).select("a", "b", "along", (F.col("n") / F.col("_out")).alias("share")))
    seeded = seeds.groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("blocked").alias("blocked"))
    hosts = ways.select(F.col("a").alias("host")).union(seeded.select("host")).distinct()
    own = {"trust": F.col("trusted"), "distrust": F.col("blocked"), "rank": F.lit(1.0), "back_rank": F.lit(1.0)}
    start = hosts.join(seeded, "host", "left").na.fill(0.0, ["trusted", "blocked"])
    start = start.select("host", *(((1 - damping) * c).alias(f"own_{k}") for k, c in own.items()))
    score = checkpoint(start.select("*", *(F.col(f"own_{k}").alias(k) for k in SCORES)))
    if not ways.limit(1).count():
        return score.select("host", *SCORES)
    along = {"trust": True, "distrust": False, "rank": True, "back_rank": False}
    for _ in range(rounds):
        sent = score.join(ways, F.col("host") == F.col("a"))
        come = sent.groupBy("b").agg(*(F.sum(F.when(F.col("along") == w, F.col(k) * F.col("share"))).alias(f"come_{k}") for k, w in along.items()))
        new = {k: F.col(f"own_{k}") + damping * F.coalesce(F.col(f"come_{k}"), F.lit(0.0)) for k in SCORES}
        moved = F.greatest(*(F.when(new[k] > 0, F.abs(new[k] - F.col(k)) / new[k]).otherwise(0.0) for k in SCORES))
        joined = score.drop("moved").join(come, F.col("host") == F.col("b"), "left")
        score = checkpoint(joined.select("host", *(f"own_{k}" for k in SCORES), *(new[k].alias(k) for k in SCORES), moved.alias("moved")))
        if score.agg(F.max("moved")).first()[0] <= tolerance:
            return score.select("host", *SCORES)
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, seeds: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row.

    seeds: (host, trusted, blocked), shares from 0 to 1; by default the share of
    a host's pages that a rule allows or blocks. Without a rule, a url is
    blocked if the share of distrust in its host's reversed rank exceeds the share
    of trust in its rank by `margin`; for a host of no seed's share, of the ranks that links
    bring, by LINK_MARGIN. trust and distrust are the PageRank scores. Defined cases: a null url, or one without `://`, has empty
    host and path, fits no rule and is allowed; null html has no links; repeated
    rows count and are judged each; other columns of `pages` are ignored; an
    empty table gives no rows.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("rule", rule).withColumn("_by_rule", verdict)
    if seeds is None:
        share = lambda kind: F.avg(F.coalesce(F.col("_by_rule") == kind, F.lit(False)).cast("double"))
        seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    seeds = checkpoint(seeds)
    edges = checkpoint(host_edges(pages, url_col, html_col))
    scores = propagate(edges, seeds)
    own = seeds.where("trusted > 0 or blocked > 0").select("host", F.lit(True).alias("_own"))
    # Stored, so that the join has plain shuffles on both sides and a host of many pages is split among tasks.
    by_host = checkpoint(scores.join(own, "host", "left"))
    joined = judged.join(by_host, "host", "left").na.fill(0.0, SCORES)
    own_rank = F.when(F.col("_own"), 0.0).otherwise(1 - DAMPING)  # what a host without a seed has of itself is no one's trust
    share = lambda score, rank: F.coalesce(F.col(score) / F.nullif(F.greatest(F.col(rank) - own_rank, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    enough = F.when(F.col("_own"), margin).otherwise(min(margin, LINK_MARGIN))
    by_graph = F.when(share("distrust", "back_rank") - share("trust", "rank") > enough, "block").otherwise("allow")
    return joined.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_by_rule", by_graph).alias("verdict"), "trust", "distrust")
