"""URL filter: host/path rules first, then trust and distrust spread over the link graph of hosts.

Trust is a personalised PageRank from trusted hosts along links; distrust is one from blocked hosts along
reversed links, for who links to a blocked host is suspect. Both run at once on host edges, as joins and
aggregates: links are counted per (host, host) map-side first, so the graph is of hosts, not of pages. Distrust
is divided among all who link to a host, so it fades as that host grows popular; `sent` runs along the same reversed links
but weighs them by their share of the linking host's own links, which does not depend on who else links. A host
of which either is above `least_distrust` of a seed's mean share and above its trust is blocked.

Links are what href, src, action, cite and formaction name: absolute, without a scheme (//host), or relative to the page or its
<base>; slashes and colons may be written as entities.

Defined results: host and path of a null url or one without "://" are empty, such a url meets no rule and is
allowed; null html has no links; repeated pages count again as links, which does not change shares by much and
never the rules; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import materialize

#: (host, path, verdict)
Rule = tuple[str, str, str]
#: Values of attributes that name another place; the second group is one without quotes.
LINK_PATTERN = r"""(?i)[\s"'](?:href|src|action|data-href|cite|formaction)\s*=\s*(?:["']\s*([^"'>]*)|([^"'\s>]+))"""
BASE_PATTERN = r"""(?i)<base\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1), r"(?s)^[^/?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.regexp_extract(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1), r"(?s)^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as its text; null where none does. Of equally long ones a block goes first."""
    found: Column = F.lit(None).cast("string")
    for rule_host, rule_path, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block", r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.lit(rule_host + rule_path)).otherwise(found)
    return found


def link_host(link: Column, base: Column) -> Column:
    """Host of a link as it stands in a page: absolute, without a scheme (//host), or relative to the page's or its base's host."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    for entity, mark in (("&#47;", "/"), ("&#x2f;", "/"), ("&#58;", ":"), ("&#x3a;", ":")):
        link = F.replace(link, F.lit(entity), F.lit(mark))
    absolute = link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    other = link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")  # mailto: and the like
    return F.when(absolute, host_of(link)).when(link.startswith("//"), host_of(F.concat(F.lit("x:"), link))).when(other, F.lit("")).otherwise(base)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, links: links between different hosts, relative ones resolved."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    named = F.regexp_extract(html, BASE_PATTERN, 1)
    p = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), html.alias("html"), named.alias("named"))
    p = p.withColumn("base", F.when(F.col("named") == "", F.col("src")).otherwise(link_host(F.col("named"), F.col("src"))))
    found = F.concat(F.regexp_extract_all("html", F.lit(LINK_PATTERN), F.lit(1)), F.regexp_extract_all("html", F.lit(LINK_PATTERN), F.lit(2)))
    links = p.where("src <> ''").select("src", "base", F.explode(found).alias("link")).where("link <> ''")
    # most links stay on their host
    links = links.select("src", link_host(F.col("link"), F.col("base")).alias("dst")).where("dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 1000) -> DataFrame:
    """edges(src, dst, links), seeds(host, trust, distrust: each summing to 1) -> host, trust, distrust, sent.

    What a round adds is passed on by the next, until no host's score can still grow by more than `tolerance`: trust and distrust are
    shared out, so their sums shrink by the damping in every round, and `sent` is an average, so its maximum does. Mass at a
    host without onward links returns to nobody, as in the usual PageRank that renormalises only at the end.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("n")).withColumnRenamed("src", "of")
    back = edges.groupBy("dst").agg(F.sum("links").alias("n")).withColumnRenamed("dst", "of")
    forward = edges.join(out, F.col("src") == F.col("of")).select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("links") / F.col("n")).alias("ft"), F.lit(0.0).alias("fd"), F.lit(0.0).alias("fs"))
    both = edges.join(back, F.col("dst") == F.col("of")).join(out.toDF("by", "n_by"), F.col("src") == F.col("by"))
    reverse = both.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("ft"), (F.col("links") / F.col("n")).alias("fd"), (F.col("links") / F.col("n_by")).alias("fs"))
    steps = materialize(forward.unionByName(reverse), "url-steps")
    own = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust")).withColumn("sent", F.col("distrust"))
    if steps.isEmpty():
        return own
    scores = ("trust", "distrust", "sent")
    total = added = materialize(own, "url-added")
    for _ in range(most_rounds):
        moved = steps.join(added, F.col("at") == F.col("host")).select(F.col("to").alias("host"), *[(F.col(f) * F.col(c) * damping).alias(c) for f, c in zip(("ft", "fd", "fs"), scores)])
        added = materialize(moved.groupBy("host").agg(*[F.sum(c).alias(c) for c in scores]), "url-added", F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"), F.max("sent").alias("sent"))
        left = max(added.figures[c] or 0.0 for c in scores)
        # written each round, so that lineage and the union stay short
        total = materialize(total.unionByName(added).groupBy("host").agg(*[F.sum(c).alias(c) for c in scores]), "url-total")
        if left * damping / (1 - damping) <= tolerance:
            return total
    raise RuntimeError(f"scores are not found after {most_rounds} rounds")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", majority: float = 0.5, least_distrust: float = 0.1, damping: float = 0.85, precision: float = 0.01) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    Seeds: hosts of whose pages at least `majority` fall under allow rules are trusted, under block rules blocked.
    Scores are found to `precision` of the least one that blocks. A host whose distrust equals its trust is allowed.
    """
    url = F.col(f"`{url_col}`")
    verdict_of = F.create_map(*[x for h, p, v in rules for x in (F.lit(h + p), F.lit(v))])
    judged = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules)).withColumn("by_rule", F.when(F.col("rule").isNotNull(), F.element_at(verdict_of, F.col("rule"))))
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("b"))
    hosts = materialize(hosts.select("host", (F.col("a") >= majority * F.col("n")).cast("double").alias("t"), (F.col("b") >= majority * F.col("n")).cast("double").alias("d")), "url-hosts")
    n = hosts.agg(F.sum("t").alias("t"), F.sum("d").alias("d")).first()
    n_trust, n_block = n["t"] or 1.0, n["d"] or 1.0
    seeds = hosts.where("t > 0 or d > 0").select("host", (F.col("t") / n_trust).alias("trust"), (F.col("d") / n_block).alias("distrust"))
    least = least_distrust * (1 - damping) / n_block
    scores = propagate(host_edges(pages, url_col, html_col), seeds, damping, precision * least).withColumnRenamed("host", "h")
    # one row a host against very many pages of a hot host: the join is of host with host, then pages find their host
    worst = F.greatest("distrust", "sent")
    blocked = (worst > least) & (worst > F.col("trust"))
    rows = judged.join(scores, F.col("host") == F.col("h"), "left")
    by_method = F.when(F.coalesce(blocked, F.lit(False)), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
