"""URL filter: host and path rules, carried over redirect equivalence.

A rule fits its host and all subdomains if the URL's path starts with the
rule's path; the longest fitting rule decides. A URL that no rule fits shares
the fate of its aliases: canonical links and meta-refresh redirects found in the
pages, resolved by RFC 3986 against the page's base, are edges between URLs (a URL without its fragment and with its host
lower-cased is a node; nothing else makes two URLs one), and within a connected component an explicit allow beats any block; a block
beats the default, which is to allow. Link targets that are no pages take part
with the rules that fit them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import durable, unpartitioned
from quirelake.llm.components import connected_components
from quirelake.session import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)://([^/?#]*)([^?#]*)"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^#]*)"


class Rule(NamedTuple):
    text: str  # host and path, like example.net/en/
    verdict: str  # allow or block


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null URL or one without ``://``."""
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, _SPLIT, 1), _UPPER, _LOWER), F.regexp_extract(known, _SPLIT, 2)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as a struct (text, verdict), or null; equally long ones: the first of the list."""
    chosen = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):  # later ones override
        name, slash, rest = rule.text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def node(url: Column) -> Column:
    """The number of a URL's node; null for what is no URL."""
    host, _ = host_and_path(url)
    scheme, rest = F.regexp_extract(url, _PARTS, 1), F.regexp_extract(url, _PARTS, 3)
    return F.when(host != "", F.xxhash64(F.concat(F.translate(scheme, _UPPER, _LOWER), F.lit("://"), host, rest)))


#: fixed values: the parts of a reference, as in RFC 3986: scheme, authority, path, query (each with its marks but the scheme)
_REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out."""
    segments = F.split(path, "/", -1)
    start = F.array().cast("array<string>")

    def step(held: Column, segment: Column) -> Column:
        # the first segment of an absolute path is the empty one before its slash, which stays
        up = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))
        return F.when(segment == ".", held).when(segment == "..", up).otherwise(F.concat(held, F.array(segment)))

    kept = F.array_join(F.aggregate(segments, start, step), "/")
    open_end = F.element_at(segments, -1).isin(".", "..")
    return F.when(open_end & ~F.endswith(kept, F.lit("/")), F.concat(kept, F.lit("/"))).otherwise(kept)


def resolved(base: Column, reference: Column) -> Column:
    """``reference`` as found on a page at ``base``, absolute and without fragment (RFC 3986, section 5.2); null without a base of scheme and authority."""

    def part(url: Column, k: int) -> Column:
        return F.regexp_extract(url, _REFERENCE, k)

    scheme, authority, path, query = (part(reference, k) for k in range(1, 5))
    own_scheme, own_authority, own_path, own_query = (part(base, k) for k in range(1, 5))
    folder = F.when(own_path == "", "/").otherwise(F.regexp_extract(own_path, r"(?s)^(.*/)?", 1))
    whole = F.concat(scheme, F.lit(":"), authority, without_dots(path), query)
    same_scheme = F.concat(own_scheme, F.lit(":"), authority, without_dots(path), query)
    site = F.concat(own_scheme, F.lit(":"), own_authority)
    rooted = F.concat(site, without_dots(path), query)
    beside = F.concat(site, without_dots(F.concat(folder, path)), query)
    same_path = F.concat(site, own_path, F.when(query != "", query).otherwise(own_query))
    relative = F.when(authority != "", same_scheme).when(F.startswith(path, F.lit("/")), rooted).when(path != "", beside).otherwise(same_path)
    known = (own_scheme != "") & (own_authority != "")
    return F.when(scheme != "", whole).when(known, relative)


def base_of(url: Column, html: Column) -> Column:
    """What relative references of a page are resolved against: its first ``<base href>``, else its own URL."""
    tag = F.when(F.contains(F.lower(html), F.lit("<base")), F.regexp_extract(html, r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.when(tag != "", resolved(url, F.replace(tag, F.lit("&amp;"), F.lit("&")))).otherwise(url)


def links(html: Column) -> Column:
    """The references of a page's canonical links and meta refreshes, as they stand there."""
    tags = F.when(F.contains(F.lower(html), F.lit("canonical")), F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0)))
    canonical = F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    tags = F.when(F.contains(F.lower(html), F.lit("refresh")), F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0)))
    refresh = F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    none = F.array().cast("array<string>")
    raw = F.transform(F.concat(F.coalesce(canonical, none), F.coalesce(refresh, none)), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))
    return F.filter(raw, lambda t: t != "")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html", key: str = "page_id", redirects: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``.

    ``redirects`` (from_url, to_url) adds known redirects. Null URLs and ones
    without ``://`` have an empty host and path, fit no rule, have no aliases
    and are allowed. Null or empty html holds no links. Rows are judged by
    their URL, so repeated ones agree; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    found = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), base_of(F.col(url), F.col(html)).alias("base"), links(F.col(html)).alias("links"))
    read = found.select("id", "url", F.filter(F.transform("links", lambda t: resolved(F.col("base"), t)), lambda t: t.isNotNull()).alias("targets"))
    judged = durable(read.withColumns({"host": host, "path": path, "node": node(F.col("url"))}).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)))
    edges = judged.select("url", F.explode("targets").alias("target"))
    if redirects is not None:
        edges = edges.union(redirects.select("from_url", "to_url"))
    ends = edges.select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b"), "url", "target")
    linked = durable(ends.filter("a <> b"))
    components = connected_components(linked.select("a", "b"))
    outside = []
    for end, name in (("a", "url"), ("b", "target")):
        host, path = host_and_path(F.col(name))
        outside.append(linked.select(F.col(end).alias("node"), fitting_rule(host, path, rules)["verdict"].alias("verdict")))
    explicit = judged.select("node", F.col("rule.verdict").alias("verdict")).union(outside[0]).union(outside[1]).filter("verdict is not null and node is not null")
    said = explicit.groupBy("node").agg(F.bool_or(F.col("verdict") == "allow").alias("allow"))
    placed = said.join(components, "node", "left").select(F.coalesce("component", "node").alias("group"), "allow")
    groups = placed.groupBy("group").agg(F.bool_or("allow").alias("allow"))
    open_ = judged.filter("rule is null").select("node").filter("node is not null").distinct()
    fate = open_.join(components, "node", "left").select("node", F.coalesce("component", "node").alias("group")).join(groups, "group").select(unpartitioned("node").alias("n"), F.when(F.col("allow"), "allow").otherwise("block").alias("fate"))
    out = judged.join(fate, F.col("rule").isNull() & (F.col("node") == F.col("n")), "left")
    return out.select(F.col("id").alias(key), "host", "path", F.col("rule.text").alias("rule"), F.coalesce("rule.verdict", "fate", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql_node(url: str) -> str:
    """The node of a URL as its text; null for what is no URL."""
    host = f"translate(regexp_extract({url}, '{_SPLIT}', 1), '{_UPPER}', '{_LOWER}')"
    return f"CASE WHEN {host} <> '' THEN translate(regexp_extract({url}, '{_PARTS}', 1), '{_UPPER}', '{_LOWER}') || '://' || {host} || regexp_extract({url}, '{_PARTS}', 3) END"


def _sql_rule(url: str, rules: tuple[Rule, ...] = RULES) -> str:
    host = f"translate(regexp_extract(coalesce({url}, ''), '(?s)://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    path = f"regexp_extract(coalesce({url}, ''), '(?s)://([^/?#]*)([^?#]*)', 2)"
    cases = []
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        name, slash, rest = rule.text.partition("/")
        cases.append(f"WHEN ({host} = '{name}' OR ends_with({host}, '.{name}')) AND starts_with({path}, '{slash + rest}') THEN '{rule.text}'")
    return "CASE " + " ".join(cases) + " END"


_VERDICT = "CASE {} " + " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in RULES) + " END"

def _sql_without_dots(path: str) -> str:
    kept = f"array_to_string(list_reduce(list_transform(string_split({path}, '/'), lambda s: [s]), lambda held, s: CASE s[1] WHEN '.' THEN held WHEN '..' THEN held[1:greatest(len(held) - 1, 1)] ELSE list_concat(held, s) END, CAST([] AS VARCHAR[])), '/')"
    last = f"string_split({path}, '/')[-1]"
    return f"CASE WHEN {last} IN ('.', '..') AND NOT ends_with({kept}, '/') THEN {kept} || '/' ELSE {kept} END"


def _sql_resolved(rows: str) -> str:
    """The rows of ``rows`` (base, r and others) with ``target``: the reference r as found at base."""
    parts = ", ".join(f"regexp_extract({c}, '{_REFERENCE}', {k}) AS {c[0]}{k}" for c in ("base", "r") for k in range(1, 5))
    folder = "CASE WHEN b3 = '' THEN '/' ELSE regexp_extract(b3, '(?s)^(.*/)?', 1) END"
    return f"""SELECT * EXCLUDE (b1, b2, b3, b4, r1, r2, r3, r4, own, beside), CASE WHEN r1 <> '' THEN r1 || ':' || r2 || own || r4 WHEN coalesce(b1, '') = '' OR b2 = '' THEN NULL WHEN r2 <> '' THEN b1 || ':' || r2 || own || r4
    WHEN starts_with(r3, '/') THEN b1 || ':' || b2 || own || r4 WHEN r3 <> '' THEN b1 || ':' || b2 || beside || r4 ELSE b1 || ':' || b2 || b3 || CASE WHEN r4 <> '' THEN r4 ELSE b4 END END AS target
    FROM (SELECT *, {_sql_without_dots("r3")} AS own, {_sql_without_dots("(" + folder + ") || r3")} AS beside FROM (SELECT *, {parts} FROM {rows}))"""


#: the same by plain SQL, components by a recursive closure
OP4_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path,
    {_sql_rule("url")} AS rule, {_sql_node("url")} AS node, replace(regexp_extract(coalesce(html, ''), '(?is)<base\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&') AS based,
    list_concat(list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1))) AS raw FROM pages),
h AS (SELECT url, node, raw, CASE WHEN r <> '' THEN target ELSE url END AS base FROM ({_sql_resolved("(SELECT url, node, raw, url AS base, based AS r FROM p)")})),
t AS (SELECT url, node, target FROM ({_sql_resolved("(SELECT * FROM (SELECT url, node, base, replace(unnest(raw), '&amp;', '&') AS r FROM h) WHERE r <> '')")}) WHERE target IS NOT NULL),
ends AS (SELECT node AS a, {_sql_node("target")} AS b, url, target FROM t),
linked AS (SELECT * FROM ends WHERE a <> b),
edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
nodes AS (SELECT node FROM p WHERE node IS NOT NULL UNION SELECT b FROM linked),
reach AS (SELECT node, node AS r FROM nodes UNION SELECT reach.node, e.b FROM reach JOIN edges e ON e.a = reach.r),
said AS (SELECT node, {_VERDICT.format("rule")} AS verdict FROM p UNION SELECT b, {_VERDICT.format(_sql_rule("target"))} FROM linked),
fate AS (SELECT reach.node, bool_or(verdict = 'allow') AS allow FROM reach JOIN said ON said.node = reach.r WHERE verdict IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce({_VERDICT.format("rule")}, CASE WHEN allow THEN 'allow' WHEN NOT allow THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN fate ON fate.node = p.node
"""
