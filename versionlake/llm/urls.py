"""URL filters: rules first, then trust and distrust spread over links between hosts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import query, table, written

# Rules (host/path, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: Damping, change at which rounds end, bar of distrust, weight of a page without a rule against one that a rule judges.
DAMPING = 0.85
CHANGE = 1e-6
BAR = 0.5
NEUTRAL = 0.1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: the target of a link in HTML.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule whose host is the page's or a parent of it and whose path begins the page's; else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def spread(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None,
           change: float = CHANGE) -> DataFrame:
    """Personalised PageRank of trust along links and of distrust against them: host, trust, distrust.

    `nodes`: host, trust_seed, distrust_seed (each column sums to 1 or 0); `edges`: distinct src, dst. Mass of hosts
    without a link on goes back to the seeds. Values are cut off from their history by a written table each round; the
    driver sees two sums and a change. Rounds end when the values move by less than `change` in sum, or after `rounds` if
    given. The change falls at least by `damping` a round and is at most 4 in the first, so the number of rounds is
    known; twice as many without an end are an error.
    """
    edges = written(edges)
    degrees = (edges.groupBy("src").agg(F.count("*").alias("n_out")).withColumnRenamed("src", "host")
               .join(edges.groupBy("dst").agg(F.count("*").alias("n_in")).withColumnRenamed("dst", "host"), "host", "full"))
    now = written(nodes.join(degrees, "host", "left").select(
        "host", "trust_seed", "distrust_seed", "n_out", "n_in", F.col("trust_seed").alias("trust"),
        F.col("distrust_seed").alias("distrust")))
    if edges.isEmpty():
        return now.select("host", "trust", "distrust")
    most = rounds if rounds is not None else 2 * math.ceil(math.log(min(1.0, change / 4)) / math.log(damping)) + 2
    for _ in range(most):
        loose = now.agg(F.sum(F.when(F.col("n_out").isNull(), F.col("trust"))).alias("t"),
                        F.sum(F.when(F.col("n_in").isNull(), F.col("distrust"))).alias("d")).first()
        ahead = now.join(edges, now.host == edges.src).select(
            F.col("dst").alias("host"), (F.col("trust") / F.col("n_out")).alias("t"), F.lit(0.0).alias("d"))
        back = now.join(edges, now.host == edges.dst).select(
            F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") / F.col("n_in")).alias("d"))
        moved = ahead.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))

        def value(seed: str, gain: str, back_to_seed: float | None) -> Column:
            return ((1 - damping) * F.col(seed)
                    + damping * (F.coalesce(F.col(gain), F.lit(0.0)) + (back_to_seed or 0.0) * F.col(seed)))

        new = written(now.join(moved, "host", "left").select(
            "host", "trust_seed", "distrust_seed", "n_out", "n_in", value("trust_seed", "t", loose["t"]).alias("trust"),
            value("distrust_seed", "d", loose["d"]).alias("distrust"),
            (F.abs(value("trust_seed", "t", loose["t"]) - F.col("trust"))
             + F.abs(value("distrust_seed", "d", loose["d"]) - F.col("distrust"))).alias("moved")))
        delta = new.agg(F.sum("moved")).first()[0] or 0.0
        now = new.drop("moved")
        if delta < change:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"trust still moves by {delta} after {most} rounds")
    return now.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", bar: float = BAR, neutral: float = NEUTRAL, change: float = CHANGE) -> DataFrame:
    """id, host, path, rule, verdict (allow or block), trust, distrust of every page.

    A page that a rule fits gets the rule's verdict; the longest fitting rule counts. Every host with
    pages that rules allow (block) is a seed of trust (distrust), weighted by the number of those pages. Trust spreads
    along links between hosts, distrust against them. Trust and distrust are shares of all allowed and blocked pages, so each
    times their number counts in pages; every page without a rule adds `neutral` pages. A page without a rule is blocked if
    distrust makes up more than `bar` of that sum of its host, and allowed otherwise, so few blocked pages of a large
    host don't block the rest. Rounds of spreading end below `change`. Null URLs and URLs without :// have
    empty host and path, fit no rule, link to nothing and are allowed. Null pages hold no links. Rows are independent
    but for the links; repeated rows count in seeds as often as they occur. An empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    verdicts = dict(rules)
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rule_verdict = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        rule_verdict = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(rule_verdict)
    rows = rows.withColumn("by_rule", rule_verdict)
    known = rows.where("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("by_rule") == "allow", 1)).alias("good"),
        F.count(F.when(F.col("by_rule") == "block", 1)).alias("bad"),
        F.count(F.when(F.col("by_rule").isNull(), 1)).alias("open"))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    links = pages.select(host_of(url).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("to"))
    target = F.when(F.startswith(F.col("to"), F.lit("//")), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    # links within a site and those that name no host move nothing between hosts
    edges = (links.where("to LIKE '%://%' OR to LIKE '//%'").select("src", host_of(target).alias("dst"))
             .where("src <> '' AND dst <> '' AND src <> dst").distinct())
    edges = written(edges)
    hosts = known.join(edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct(), "host", "full").select(
        "host", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"),
        F.coalesce("open", F.lit(0)).alias("open"))
    hosts = written(hosts)
    sums = hosts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seeds = hosts.select("host", (F.col("good") / F.lit(float(sums["good"] or 1))).alias("trust_seed"),
                         (F.col("bad") / F.lit(float(sums["bad"] or 1))).alias("distrust_seed"))
    scores = spread(seeds, edges, change=change).join(hosts.select("host", "open"), "host")
    # salted, because one host may hold a third of the pages
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    spread_scores = scores.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
    judged = salted.join(spread_scores, ["host", "salt"], "left")
    against = F.col("distrust") * F.lit(float(sums["bad"] or 0))
    share = against / (against + F.col("trust") * F.lit(float(sums["good"] or 0)) + F.col("open") * F.lit(neutral))
    method = F.when((F.col("distrust") > 0) & (share > bar), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule",
                         F.coalesce("by_rule", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"),
                         F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


@query("op5_url_filter")
def op5_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))
