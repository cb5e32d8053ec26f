"""URL filter with redirect equivalence, in DataFrame operations only.

Rules (allow or block, host, path) fit their host, its subdomains and all
paths that start with theirs; the longest rule wins, allow before block among
equals.  Pages that no rule fits are judged through their aliases: redirects
(``meta refresh`` and an optional table of edges) and canonical links join urls
to components, and a block of any member is a block of all, unless a member
is explicitly allowed.  A page's own rule always precedes.  What neither rule
nor alias judges is allowed.

Urls are nodes by host, path and query (scheme and fragment dropped).  Hosts
are matched once each, by joining their suffixes to the rules.

A null url, or one without ``://``, has an empty host and path, fits no rule and
is in no component.  Null or empty html has no links; null rules or edges are
ignored; repeated pages give one result each; no rules or no edges are fine;
empty pages give an empty result.  Extra columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOW, UPPER, keep
from .components import components

#: fixed by the query's contract
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query; null where the host is empty."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge(df: DataFrame, rules: DataFrame) -> DataFrame:
    """df (with host and path) and the columns ``rule`` and ``by_rule`` (null: none)."""
    rules = rules.dropna().select(
        F.col("host").alias("_suffix"),
        F.struct((-F.length(F.concat("host", "path"))).alias("n"), F.col("verdict"), F.col("path").alias("p"),
                 F.concat("host", "path").alias("rule")).alias("r"))
    parts = F.split("host", r"\.")
    hosts = df.select("host").filter("host != ''").distinct().withColumn("_suffix", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    # longest first; "allow" sorts before "block"
    # kept, so that the join below reads it through an exchange of its own and a hot host can be split
    fits = keep(hosts.join(rules, "_suffix").groupBy("host").agg(F.sort_array(F.collect_list("r")).alias("_rules")))
    best = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["p"])), F.lit(0))
    return (df.join(fits, "host", "left").withColumn("_best", best)
            .withColumn("rule", F.col("_best.rule")).withColumn("by_rule", F.col("_best.verdict")).drop("_rules", "_best"))


def _absolute(link: Column, url: Column) -> Column:
    """A link of a page as an absolute url."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    root = F.concat(F.lit("http://"), host_of(url))
    return (F.when(link == "", None).when(link.contains("://"), link)
            .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(root, link))
            .otherwise(F.concat(root, F.regexp_extract(F.concat(F.lit("/"), F.ltrim(path_of(url), F.lit("/"))), r"^(.*/)", 1), link)))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) urls of the canonical links and refresh redirects in the html."""
    def link(word: str, tag: str, target: str) -> Column:
        found = F.regexp_extract(F.regexp_extract("html", tag, 0), target, 1)
        return F.when(F.lower("html").contains(word), found).otherwise("")
    canonical = link("canonical", r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>",
                     r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = link("refresh", r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>",
                   r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    both = pages.select("url", F.explode(F.array(canonical, refresh)).alias("_l")).filter("_l != ''")
    return both.select(F.col("url").alias("src"), _absolute(F.col("_l"), F.col("url")).alias("dst"))


def filter_pages(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and ``via`` (rule, alias or default) of
    every page; ``redirects`` (src, dst) adds edges that are not in the html."""
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("src", "dst"))
    roots = components(links.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")))
    url = F.concat(F.lit("x://"), F.col("node"))
    members = judge(roots.withColumn("host", host_of(url)).withColumn("path", path_of(url)), rules)
    verdicts = members.groupBy("root").agg(F.max(F.col("by_rule") == "allow").alias("a"),
                                           F.max(F.col("by_rule") == "block").alias("b"))
    alias = members.select("node", "root").join(verdicts, "root").select(
        F.col("node").alias("_node"), F.when(F.col("a"), "allow").when(F.col("b"), "block").alias("by_alias"))
    own = judge(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")),
                rules)
    return own.join(alias, node_of(F.col("url")) == F.col("_node"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("by_rule").isNotNull(), "rule").when(F.col("by_alias").isNotNull(), "alias").otherwise("default").alias("via"))


def op1(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return filter_pages(pages, rule_table(spark, RULES))
