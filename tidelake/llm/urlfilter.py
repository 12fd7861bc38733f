"""URL verdicts: longest matching rule, else trust and distrust spread over host edges.

Hosts that a block rule covers whole are distrusted, hosts with pages that an
allow rule names are trusted. Edges are the pages' links between hosts (relative
ones resolved by the page's ``<base>``), which carry trust along and distrust
against them, and the domain hierarchy: a host and the domain above it, down to
two labels, share trust, and the upper one hands distrust down. Personalised
PageRank spreads both until it converges; neither passes through a seed of the
other kind. A page that no rule fits is blocked if
its host has more distrust than trust and at least ``least_mass`` times an even share.

Mass that reaches a host without an edge onwards returns to the seeds. As the
teleport goes there too, that is the same as letting it go and scaling the ranks
of a kind to a sum of 1 at the end.

Defined results: a null url, or one without ``://``, has empty host and path
and takes part in no rule; hosts that no mass reaches are allowed. Null or
empty html has no links. Repeated rows are judged one by one; repeated links
add weight. An empty table gives an empty result. Only the named columns are
read, so others may have any name. Rules are policy text: a handful of rows that
become expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import as_table, skew_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""
BASE = r"""(?i)<base\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
#: What names a host of its own, and what names none (``mailto:``, ``#top``).
ABSOLUTE, PLACELESS = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//", r"(?i)^(?:[a-z][a-z0-9+.-]*:|#)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlFilterConfig:
    rules: tuple[Rule, ...] = ()
    damping: float = 0.85
    #: Change of all ranks together, between two stored tables, below which they have converged.
    tolerance: float = 1e-3
    #: Iterations between two stored rank tables.
    store_every: int = 5
    #: Weight of an edge of the domain hierarchy; a link weighs 1.
    hierarchy_weight: float = 1.0
    #: Least distrust of a blocked host, as a share of a host's mean mass or of one seed's own mass, whichever is less.
    least_mass: float = 0.5


def host_of(url: Column) -> Column:
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    found = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, found).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    found = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, found).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Position of the longest rule that fits, else null."""
    found = F.lit(None).cast("int")
    order = sorted(range(len(rules)), key=lambda k: (len(rules[k].text), -k))
    for k in order:
        rule = rules[k]
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(k)).otherwise(found)
    return found


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, counted; relative ones go to the host of ``<base>``."""
    text = F.coalesce(F.col(html), F.lit(""))
    own = host_of(F.col(url))

    def full(link: Column) -> Column:
        return F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link)).otherwise(link)

    base = F.regexp_extract(text, BASE, 1)
    found = pages.select(own.alias("src"), F.when(base == "", own).otherwise(host_of(full(base))).alias("base"), F.explode(F.regexp_extract_all(text, F.lit(LINK), F.lit(1))).alias("to"))
    target = F.when(F.rlike("to", F.lit(ABSOLUTE)), host_of(full(F.col("to")))).when(~F.rlike("to", F.lit(PLACELESS)), F.col("base")).otherwise(F.lit(""))
    ends = found.select("src", target.alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return ends.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def domain_edges(hosts: DataFrame, weight: float) -> DataFrame:
    """(lower, upper, weight): every host with the domain above it, and so on down to two labels."""
    labels = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    names = F.transform(F.sequence(F.lit(1), F.greatest(F.size("l") - 1, F.lit(1))), lambda k: F.array_join(F.slice("l", k, F.size("l")), "."))
    chain = hosts.select("host", labels.alias("l")).where("size(l) > 2").select(F.concat(F.array("host"), F.slice(names, F.lit(2), F.size("l"))).alias("n"))
    steps = chain.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda k: F.struct(F.get("n", k - 1).alias("lower"), F.get("n", k).alias("upper")))).alias("e"))
    return steps.select("e.lower", "e.upper").where("lower <> upper").distinct().withColumn("weight", F.lit(weight))


def graph(links: DataFrame, domains: DataFrame) -> DataFrame:
    """(kind, src, dst, weight): the ways that trust and distrust take."""

    def way(edges: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
        return edges.select(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"), "weight")

    ways = [way(links, "trust", "src", "dst"), way(links, "distrust", "dst", "src"), way(domains, "trust", "lower", "upper"), way(domains, "trust", "upper", "lower"), way(domains, "distrust", "upper", "lower")]
    out = ways[0]
    for w in ways[1:]:
        out = out.unionByName(w)
    return out.groupBy("kind", "src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(ways: DataFrame, seeds: DataFrame, config: UrlFilterConfig) -> DataFrame:
    """(kind, host, value): personalised PageRank from ``seeds`` (kind, host, seed) along ``ways``; a kind sums to 1."""
    ways = as_table(ways, "url-ways")
    out = ways.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    edges = as_table(skew_join(ways, out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("all")).alias("share")), "url-edges")
    start = seeds.select("kind", "host", (F.col("seed") * (1 - config.damping)).alias("value"))
    ranks = stored = as_table(start, "url-ranks")
    while True:
        # Each turn leaves at most ``damping`` of what was still to come, so this ends.
        for _ in range(config.store_every):
            moved = skew_join(edges, ranks, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("value") * config.damping).alias("value"))
            ranks = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("value").alias("value"))
        ranks = as_table(ranks, "url-ranks")
        before = stored.select("kind", "host", (-F.col("value")).alias("value"))
        change = ranks.unionByName(before).groupBy("kind", "host").agg(F.abs(F.sum("value")).alias("c")).agg(F.sum("c")).first()[0]
        stored = ranks
        if not change or change <= config.tolerance:
            break
    sums = ranks.groupBy("kind").agg(F.sum("value").alias("all"))  # two rows
    return ranks.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("value") / F.col("all")).alias("value"))


def judge_urls(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", config: UrlFilterConfig = UrlFilterConfig()) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (null where the rule decided)."""
    rules = config.rules
    named = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    named = as_table(named.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules)), "url-pages")
    whole = [k for k, r in enumerate(rules) if r.verdict == "block" and r.path in ("", "/")]
    allowed = [k for k, r in enumerate(rules) if r.verdict == "allow"]
    hosts = named.where("host <> ''").groupBy("host").agg(F.max(F.col("_rule").isin(whole).cast("int")).alias("bad"), F.max(F.col("_rule").isin(allowed).cast("int")).alias("good"))
    hosts = as_table(hosts, "url-hosts")
    sums = hosts.agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    good = hosts.where("good = 1").select(F.lit("trust").alias("kind"), "host", F.lit(1.0 / max(sums["good"] or 0, 1)).alias("seed"))
    bad = hosts.where("bad = 1").select(F.lit("distrust").alias("kind"), "host", F.lit(1.0 / max(sums["bad"] or 0, 1)).alias("seed"))
    seeds = good.unionByName(bad)
    ways = graph(host_links(pages, url, html), domain_edges(hosts, config.hierarchy_weight))
    opposite = seeds.select(F.when(F.col("kind") == "trust", F.lit("distrust")).otherwise(F.lit("trust")).alias("kind"), F.col("host").alias("src"))
    ranks = propagate(ways.join(opposite, ["kind", "src"], "left_anti"), seeds, config)
    scores = ranks.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    ruled = named.where("_rule is not null").withColumns({"trust": F.lit(None).cast("double"), "distrust": F.lit(None).cast("double")})
    free = skew_join(named.where("_rule is null"), scores, ["host"], "left").select(ruled.columns)
    text = F.element_at(F.lit([r.text for r in rules] or [""]), F.col("_rule") + 1)
    said = F.element_at(F.lit([r.verdict for r in rules] or [""]), F.col("_rule") + 1)
    # With many seeds each is worth less than the mean host, and so is all that one of them can pass on.
    unit = min(1.0 / max(sums["n"], 1), (1 - config.damping) / max(sums["bad"] or 0, 1))
    suspect = (F.col("distrust") > F.coalesce(F.col("trust"), F.lit(0.0))) & (F.col("distrust") >= F.lit(config.least_mass * unit))
    verdict = F.when(F.col("_rule").isNotNull(), said).when(suspect, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.unionByName(free).select("page_id", "host", "path", F.when(F.col("_rule").isNotNull(), text).alias("rule"), verdict.alias("verdict"), "trust", "distrust")
