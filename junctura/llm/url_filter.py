"""Block and allow rules over urls, carried to aliases along redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from junctura.llm.common import ascii_lower, staged, text_of
from junctura.llm.components import components

# The rules of the query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
TRACKING = r"(?i)(?<=[?&])(utm_[a-z]+|gclid|fbclid)=[^&]*&?"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def page_key(url: Column) -> Column:
    """Name of a page in the alias graph: host, path without a closing slash and query
    without tracking parameters. Scheme and fragment say nothing about the page."""
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 0), TRACKING, ""), r"(?s)^[^?]*\??|&$", "")
    query = F.regexp_replace(query, r"(?s)#.*$", "")
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def absolute(base: Column, link: Column) -> Column:
    """A link seen on ``base`` as a full url."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host_of(base), link))
            .otherwise(F.concat(scheme, F.lit("://"), host_of(base), F.regexp_replace(path_of(base), r"[^/]*$", ""), link)))


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of canonical links and refresh redirects in ``html``."""
    tags = F.regexp_extract_all(text_of("html"), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    t = F.col("tag")
    canonical = F.when(t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = pages.where(text_of("html").rlike(r"(?i)\b(canonical|refresh)\b")).select("url", F.explode(tags).alias("tag")).select("url", F.coalesce(canonical, refresh).alias("link"))
    return found.where("link <> ''").select(F.col("url").alias("from_url"), absolute(F.col("url"), F.col("link")).alias("to_url"))


def rule_hits(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the distinct ``keys`` (host, path) that a rule
    fits. A rule fits its host and all subdomains if the path starts with its own; the
    longest wins, then allow, then the later name.

    Every host suffix and every folder of the path is an equality key, so a list of
    millions of rules is joined, not scanned; how many are tried is bounded by the
    deepest rule."""
    rules = rules.select(F.col("host").alias("r_host"), F.regexp_extract("path", r"(?s)^(.*/)?", 0).alias("r_dir"), F.col("path").alias("r_path"),
                         F.col("verdict").alias("r_verdict"))
    deep = rules.agg(F.max(F.size(F.split("r_host", r"\."))).alias("h"), F.max(F.size(F.split("r_dir", "/"))).alias("p")).first()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deep["h"] or 1))),
                           lambda n: F.array_join(F.slice(labels, -n, n), "."))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(deep["p"] or 1)) - 1),
                          lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    tried = keys.select("host", "path", F.explode(suffixes).alias("r_host"), folders.alias("folders")).select(
        "host", "path", "r_host", F.explode("folders").alias("r_dir"))
    hit = tried.join(rules, ["r_host", "r_dir"]).where(F.col("path").startswith(F.col("r_path")))
    name = F.concat("r_host", "r_path")
    best = F.max(F.struct(F.length(name).alias("n"), (F.col("r_verdict") == "allow").alias("a"), name.alias("rule"), F.col("r_verdict").alias("v")))
    return hit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.col("b.rule").alias("rule"), F.col("b.v").alias("rule_verdict"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url,
    html). ``redirects`` (from_url, to_url) adds known redirects to those in the pages.

    A rule that fits decides. Of the other pages those whose redirect component holds
    a page that a rule blocks are blocked, unless the component also holds one that a
    rule allows: an explicit allow goes before a block that was carried over. All the
    rest are allowed. A null url has an empty host and path and no aliases; rows that
    repeat are judged alike."""
    url = text_of("url")
    seen = staged(pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"),
                               F.when(host_of(url) != "", page_key(url)).alias("node")), "pages")
    hits = staged(rule_hits(seen.select("host", "path").distinct(), rules), "hits")
    judged = seen.join(hits, ["host", "path"], "left")
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url"))
    links = staged(links.where("from_url is not null and to_url is not null"), "links")
    keyed = staged(links.select(page_key(F.col("from_url")).alias("a"), page_key(F.col("to_url")).alias("b")), "link_keys")
    comp = staged(components(keyed, "a", "b"), "alias")
    # the ends of links that are no page of the table are judged by the rules too
    known = staged(links.select(F.explode(F.array("from_url", "to_url")).alias("url")).distinct().select(
        page_key(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "ends")
    ends = known.join(rule_hits(known.select("host", "path").distinct(), rules), ["host", "path"]).select("node", "rule_verdict")
    spread = comp.join(ends.distinct(), "node").groupBy("component").agg(
        F.max(F.col("rule_verdict") == "block").alias("blocked"), F.max(F.col("rule_verdict") == "allow").alias("allowed"))
    carried = comp.join(spread.where("blocked and not allowed"), "component").select("node", F.lit("block").alias("carried")).distinct()
    return judged.join(carried, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "carried", F.lit("allow")).alias("verdict"))
