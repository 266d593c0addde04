"""URL filters with redirect equivalence, in DataFrame operations only.

A rule allows or blocks a host, its subdomains, and the paths that start with the rule's path; the
longest rule that fits decides. Redirects (refresh tags, or a column that names the target) and
canonical links join pages that are aliases: distributed connected components over these edges find
each alias group, and a block decision reaches every member without a rule of its own. Explicit
permission has precedence: a page that a rule allows stays allowed in a blocked group; it shields itself
and no other member.

A node is a URL with its host in lower case, without dot segments and without fragment, whether or not a
page has it. All canonical and refresh tags of a page count; their targets are freed of character
references and resolved against the page's base (its base tag, or its URL), as a browser does; a target
with another scheme than ``x://`` (mail addresses, scripts, data) is no edge. Rules are a short list that
becomes one expression; ``MAX_RULES`` bounds it.

Defined results: a URL that is null or has no ``://`` has an empty host and path, fits no rule, and is
allowed; null html has no links; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; one that ends in such a segment ends in a slash."""

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(part == ".", acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, 1 << 30), F.slice(parts, 1, 1), step)
    folded = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"(?:^|/)\.\.?\z"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"/\.\.?(?:/|\z)"), folded).otherwise(path)


def node_of(url: Column) -> Column:
    bare = F.regexp_extract(url, r"(?s)^[^#]*", 0)
    scheme = F.regexp_extract(bare, r"(?s)^(.*?)://", 1)
    path, query = F.regexp_extract(bare, r"(?s)://[^/?#]*([^?]*)", 1), F.regexp_extract(bare, r"(?s)://[^?]*(\?.*)$", 1)
    return F.when(bare.contains("://"), F.concat(F.translate(scheme, UPPER, LOWER), F.lit("://"), host_of(bare), without_dots(path), query))


def _attribute(tag: Column, name: str) -> Column:
    value = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, value, i) for i in (1, 2, 3)])


def _tags(html: Column, tag: str, attribute: str, word: str) -> Column:
    """The tags of a kind that have ``word`` among an attribute's words."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))
    return F.filter(found, lambda t: _attribute(t, attribute).rlike(rf"(?i)(?:^|\s){word}(?:\s|\z)"))


def plain(value: Column) -> Column:
    """An attribute's value without the character references that URLs have, and without space around it."""
    for reference, char in (("&#0*38;", "&"), ("(?i)&#x0*26;", "&"), ("&#0*39;|&apos;", "'"), ("&quot;|&#0*34;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.regexp_replace(value, reference, char)
    return F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def link_targets(url: Column, html: Column) -> Column:
    """Array of a page's canonical and redirect targets as absolute URLs; null for those that are none."""
    canonical = F.transform(_tags(html, "link", "rel", "canonical"), lambda t: plain(_attribute(t, "href")))
    content = F.transform(_tags(html, "meta", "http-equiv", "refresh"), lambda t: plain(_attribute(t, "content")))
    refresh = F.transform(content, lambda c: F.regexp_extract(c, r"(?is)^[^;,]*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1))
    base_tag = F.regexp_extract(html, r"(?is)<base\b[^>]*>", 0)
    base = F.coalesce(absolute(F.nullif(plain(_attribute(base_tag, "href")), F.lit("")), url), url)
    targets = F.filter(F.concat(canonical, refresh), lambda t: t != "")
    return F.when(F.size(targets) > 0, F.transform(targets, lambda t: absolute(t, base)))


def absolute(target: Column, base: Column) -> Column:
    """A reference resolved against a base URL; dot segments stay, as nodes have none."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    path = F.regexp_extract(base, r"(?s)://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target))
        .when(~base.contains("://"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path, target))
        .when((target == "") | target.startswith("#"), base)
        .otherwise(F.concat(site, folder, target))
    )


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    redirect_col: str | None = None,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the number of URLs in its alias group (1 at least)."""
    url = pages[url_col]
    targets = link_targets(url, pages[html_col])
    if redirect_col:
        targets = F.concat(F.coalesce(targets, F.array()), F.array(pages[redirect_col]))
    links = pages.select(node_of(url).alias("a"), F.explode(targets).alias("t")).select("a", node_of(F.col("t")).alias("b"))
    groups = connected_components(links)
    own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    sums = groups.withColumn("_own", own).groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("_own") == "block"), F.lit(False)).alias("_passed"), F.count("*").alias("_size"),
    )
    decided = groups.join(sums, "component").select("node", "_passed", "_size")
    x = pages.select(pages[id_col], host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("_node"))
    x = x.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    x = x.join(decided, x["_node"] == decided["node"], "left")
    passed = F.when(F.col("_passed"), F.lit("block")).otherwise(F.lit("allow"))
    return x.select(
        id_col, "host", "path", F.col("_rule")["rule"].alias("rule"), F.coalesce(F.col("_rule")["verdict"], passed).alias("verdict"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("alias_urls"),
    )


#: The rules of the catalogue's query.
RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)
