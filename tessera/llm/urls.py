"""URL filters: explicit rules, and decisions that spread over redirects and canonical links. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import connected_components

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rules up to this many become one expression; more are joined by host.
INLINE_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z as a-z; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_name(host: str, path: str) -> str:
    return host + path


def matched(urls: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """urls (with host and path) and the longest rule that fits, as (rule, ruled); null if none does.

    A rule fits its host and all hosts below it, where the path starts with its path. Of rules equally long the allowing one counts, and of several of these
    the one of the greatest host, then path.
    """
    if len(rules) <= INLINE_RULES:
        rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
        for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1], r[2])):
            fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
            rule, ruled = F.when(fits, _rule_name(host, path)).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
        return urls.withColumn("rule", rule).withColumn("ruled", ruled)
    table = urls.sparkSession.createDataFrame(rules, "ruled string, rule_host string, rule_path string")
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    pairs = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(above)).join(table, "rule_host").where(F.startswith("path", "rule_path"))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), (F.col("ruled") == "allow").alias("allow"), "rule_host", "rule_path", "ruled")
    best = pairs.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), "best.ruled")
    return urls.join(best, ["host", "path"], "left")


def _node(host: Column, url: Column) -> Column:
    """128 bits for a URL: its host, path and query, whatever its scheme and fragment."""
    return F.md5(F.concat(host, F.lit(" "), F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)))


def _absolute(link: Column, url: Column, host: Column) -> Column:
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("http://"), host)
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (
        F.when(link.contains("://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(base, link))
        .when(link != "", F.concat(base, F.when(F.startswith(folder, F.lit("/")), folder).otherwise("/"), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with the URLs that its canonical link and its refresh name, in `to`."""
    url, host = F.col("url"), host_of(F.col("url"))
    to = F.array(*(_absolute(F.regexp_extract(F.coalesce("html", F.lit("")), p, 1), url, host) for p in (_CANONICAL, _REFRESH)))
    return pages.select("page_id", "url", F.filter(to, lambda x: x.isNotNull()).alias("to"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url, html; others are ignored).

    The longest rule that fits decides. A URL that no rule fits shares the fate of its aliases, the component of
    canonical links, refreshes and `redirects` (src, dst: URLs): allow if a rule allows one of them, else block if a rule
    blocks one, else allow. Nothing is gathered on the driver. Null URLs have empty host and path, no rule
    and no aliases; repeated rows are judged each; null html has no links. URLs of any length are told apart by 128 bits of their host, path and query.
    """
    ws = Workspace(pages.sparkSession, "urls")
    own = page_links(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    own = matched(own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), rules)
    own = ws.put(own.withColumn("node", F.when(F.col("host") != "", _node(F.col("host"), F.col("url")))), "own")
    links = own.select("node", F.explode("to").alias("url"))
    if redirects is not None:
        src = F.col("src").cast("string")
        extra = redirects.select(src.alias("src"), F.col("dst").cast("string").alias("url")).where(host_of(F.col("src")) != "")
        ends = extra.select(F.col("src").alias("url"))
        links = links.unionByName(extra.select(_node(host_of(F.col("src")), F.col("src")).alias("node"), "url")).unionByName(ends.select(_node(host_of(F.col("url")), F.col("url")).alias("node"), "url"))
    links = links.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).where("host <> '' and node is not null")
    links = ws.put(matched(links, rules).withColumn("target", _node(F.col("host"), F.col("url"))), "links")
    components = ws.put(connected_components(links, ws, "node", "target", kind="string"), "components")
    said = links.select(F.col("target").alias("node"), "ruled").unionByName(own.select("node", "ruled")).where("ruled is not null")
    fate = said.join(components, "node").groupBy("component").agg(F.min("ruled").alias("fate"))  # allow comes before block
    fate = components.join(fate, "component").select("node", "fate")
    return ws.finish(own.join(fate, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "fate", F.lit("allow")).alias("verdict")), own.count())


def allowed(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """The rows of pages whose page_id is allowed by every row of that page_id; same columns. Rows without page_id go by null's verdict."""
    bad = judge(pages, rules, redirects).where("verdict = 'block'").select(F.col("page_id").alias("__bad")).distinct()
    return pages.join(bad, pages["page_id"].cast("long").eqNullSafe(F.col("__bad")), "left_anti")
