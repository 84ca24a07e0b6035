"""URL filters: rules on hosts and paths, and their block decisions carried to redirect and canonical-link aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components

#: Verdict and rule (host, then path from its first slash on).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, null if none does; of equal rules the first."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda x: len(x[1])):
        domain, start = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def alias_key(url: Column) -> Column:
    """A URL as a node: scheme and host lower-cased, without its fragment."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host(url), rest))


#: What a browser does not read as tags, tags whose values may hold >, and an attribute with its value. Possessive, so
#: that long tags take no stack.
_UNREAD = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script|$)|<style\b.*?(?:</style|$)|<noscript\b.*?(?:</noscript|$)|<textarea\b.*?(?:</textarea|$)|<template\b.*?(?:</template|$)"
_TAG = r"""(?is)(<(?:link|meta|base)[\s/](?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""
_ATTRIBUTE = r"""([^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))"""


def _attribute(attributes: Column, name: str) -> Column:
    """The value of the first attribute of a name, without its quotes and spaces at the ends; null without one."""
    mine = F.filter(attributes, lambda x: F.translate(F.rtrim(F.substring_index(x, "=", 1)), UPPER, LOWER) == name)
    value = F.btrim(F.regexp_replace(F.try_element_at(mine, F.lit(1)), "(?s)^[^=]*=", ""))
    return F.replace(F.btrim(F.regexp_replace(value, """(?s)^["'](.*)["']$""", "$1")), F.lit("&amp;"), F.lit("&"))


def _without_dots(path: Column) -> Column:
    """A path with its segments . and .. resolved."""
    parts = F.split(F.regexp_replace(path, "(/[.]{1,2})$", "$1/"), "/")
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), lambda done, x: F.when(x == ".", done).when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x)))


def resolve(to: Column, base: Column) -> Column:
    """A link's URL as seen from the URL `base`; null for links within the page and for other schemes than base's kind."""
    site = F.concat(F.substring_index(base, "://", 1), F.lit("://"), host(base))
    folder = F.regexp_extract(path(base), "^(.*/)", 1)
    rest = F.regexp_extract(to, "(?s)([?#].*)$", 1)
    bare = F.regexp_extract(to, "(?s)^([^?#]*)", 1)
    joined = F.when(bare.startswith("/"), bare).when(bare == "", path(base)).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), bare))
    return (
        F.when((to == "") | to.startswith("#"), None).when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(to.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), to)).otherwise(F.concat(site, _without_dots(joined), rest))
    )


def html_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src and dst (URLs) of the canonical links and meta refreshes in the pages' HTML.

    Comments, scripts, styles and other text that is no markup are left out first. A link is canonical if `canonical` is
    among the words of its rel. Relative links are resolved against the page's first base, or its URL. Null HTML and URLs
    that are null or without :// have no links; repeated rows give repeated links.
    """
    h, u = F.col(f"`{html}`"), F.col(f"`{url}`")
    tags = F.transform(F.regexp_extract_all(F.regexp_replace(h, _UNREAD, " "), F.lit(_TAG), F.lit(1)), lambda t: F.struct(
        F.translate(F.regexp_extract(t, r"^<(\w+)", 1), UPPER, LOWER).alias("name"), F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(1)).alias("attributes"),
    ))
    hinting = pages.filter(h.rlike("(?i)canonical|http-equiv") & u.contains("://")).select(u.alias("src"), tags.alias("tags"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t["name"] == "base"), lambda t: resolve(_attribute(t["attributes"], "href"), F.col("src"))), lambda x: x.isNotNull())
    each = hinting.select("src", F.coalesce(F.try_element_at(bases, F.lit(1)), F.col("src")).alias("base"), F.explode("tags").alias("tag"))
    of = F.col("tag.attributes")
    canonical = (F.col("tag.name") == "link") & F.array_contains(F.split(F.translate(F.coalesce(_attribute(of, "rel"), F.lit("")), UPPER, LOWER), r"\s+"), "canonical")
    refresh = (F.col("tag.name") == "meta") & (F.translate(F.coalesce(_attribute(of, "http-equiv"), F.lit("")), UPPER, LOWER) == "refresh")
    goes = F.regexp_extract(_attribute(of, "content"), r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['"]?([^"'\s>]+)""", 1)
    linked = each.select("src", "base", F.when(canonical, _attribute(of, "href")).when(refresh, goes).alias("to"))
    return linked.select("src", resolve(F.col("to"), F.col("base")).alias("dst")).filter("dst IS NOT NULL")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, host, path, rule, verdict and via (rule, alias or none) of every row of pages.

    A page's own rule decides. Without one, the page takes the decision of its aliases, the URLs that it reaches over
    redirects (rows of src and dst) and canonical links in either direction: allow if a rule allows one of them, else
    block if a rule blocks one, else allow. Null or malformed URLs have no aliases and are allowed; null HTML has no links;
    repeated rows stay rows, other columns are not looked at, and an empty table gives an empty result.
    """
    edges = html_links(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    edges = edges.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")
    nodes = connected_components(edges)
    ruled = nodes.withColumn("r", rule_of(host(F.col("node")), path(F.col("node")), rules)["verdict"])
    decisions = ruled.groupBy("component").agg(F.max(F.coalesce(F.col("r") == "allow", F.lit(False))).alias("allowed"), F.max(F.coalesce(F.col("r") == "block", F.lit(False))).alias("blocked"))
    blocked = nodes.join(decisions.filter("blocked AND NOT allowed"), "component").select(F.col("node").alias("key"), F.lit(True).alias("by_alias"))
    u = F.col(f"`{url}`")
    keyed = pages.select(F.col(f"`{id_column}`"), host(u).alias("host"), path(u).alias("path"), alias_key(u).alias("key"))
    own = keyed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).join(blocked, "key", "left")
    by_alias = F.coalesce("by_alias", F.lit(False))
    return own.select(
        F.col(f"`{id_column}`"), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(by_alias, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("r").isNotNull(), "rule").when(by_alias, "alias").otherwise("none").alias("via"),
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and via of all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


#: The same over pages, without redirects, which have no table. Components by reachability, as SQL has it.
OP2_SQL = r"""
WITH RECURSIVE page AS (
  SELECT page_id, url, coalesce(html, '') AS html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, split_part(url, '://', 1) AS scheme FROM pages),
tags AS (
  SELECT page_id, url, scheme, host, path, list_transform(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script|$)|<style\b.*?(?:</style|$)|<noscript\b.*?(?:</noscript|$)|<textarea\b.*?(?:</textarea|$)|<template\b.*?(?:</template|$)', ' ', 'g'),
         '(?is)<(?:link|meta|base)[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>'),
         lambda t: {'name': lower(regexp_extract(t, '^<(\w+)', 1)), 'of': list_transform(regexp_extract_all(t, '[^\s"''>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'),
           lambda x: {'k': lower(rtrim(split_part(x, '=', 1))), 'v': replace(trim(regexp_replace(trim(regexp_replace(x, '(?s)^[^=]*=', '')), '(?s)^["''](.*)["'']$', '\1')), '&amp;', '&')})}) AS tags
  FROM page WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|http-equiv')),
based AS (SELECT *, list_filter(list_transform(list_filter(tags, lambda t: t.name = 'base'), lambda t: list_filter(t.of, lambda x: x.k = 'href')[1].v), lambda x: x <> '' AND NOT starts_with(x, '#'))[1] AS base_to FROM tags),
hint AS (
  SELECT url, scheme, host, path, base_to, CASE WHEN t.name = 'link' AND list_contains(regexp_split_to_array(lower(coalesce(list_filter(t.of, lambda x: x.k = 'rel')[1].v, '')), '\s+'), 'canonical') THEN list_filter(t.of, lambda x: x.k = 'href')[1].v
         WHEN t.name = 'meta' AND lower(coalesce(list_filter(t.of, lambda x: x.k = 'http-equiv')[1].v, '')) = 'refresh'
         THEN regexp_extract(list_filter(t.of, lambda x: x.k = 'content')[1].v, '(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*[''"]?([^"''\s>]+)', 1) END AS goes FROM (SELECT *, unnest(tags) AS t FROM based)),
-- The first step resolves bases against the page, the second one links against bases.
wanted AS (SELECT DISTINCT url, scheme, host, path, base_to AS goes, 0 AS step FROM hint WHERE base_to IS NOT NULL),
base AS (SELECT url, CASE WHEN regexp_matches(goes, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN goes WHEN regexp_matches(goes, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(goes, '//') THEN scheme || ':' || goes
         ELSE scheme || '://' || host || list_reduce(list_prepend('', string_split(regexp_replace(CASE WHEN starts_with(goes, '/') THEN regexp_extract(goes, '(?s)^([^?#]*)', 1) WHEN regexp_extract(goes, '(?s)^([^?#]*)', 1) = '' THEN path
                ELSE CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || regexp_extract(goes, '(?s)^([^?#]*)', 1) END, '(/[.]{1,2})$', '\1/'), '/')[2:]),
              lambda done, x: CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END) || regexp_extract(goes, '(?s)([?#].*)$', 1) END AS base FROM wanted),
seen AS (
  SELECT hint.url AS src, goes, coalesce(base, hint.url) AS b, split_part(coalesce(base, hint.url), '://', 1) AS scheme, translate(regexp_extract(coalesce(base, hint.url), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(base, hint.url), '://[^/?#]*([^?#]*)', 1) AS path FROM hint LEFT JOIN base ON base.url = hint.url WHERE goes <> '' AND NOT starts_with(goes, '#')),
link AS (SELECT src, dst FROM (SELECT src, CASE WHEN regexp_matches(goes, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN goes WHEN regexp_matches(goes, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(goes, '//') THEN scheme || ':' || goes
         ELSE scheme || '://' || host || list_reduce(list_prepend('', string_split(regexp_replace(CASE WHEN starts_with(goes, '/') THEN regexp_extract(goes, '(?s)^([^?#]*)', 1) WHEN regexp_extract(goes, '(?s)^([^?#]*)', 1) = '' THEN path
                ELSE CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || regexp_extract(goes, '(?s)^([^?#]*)', 1) END, '(/[.]{1,2})$', '\1/'), '/')[2:]),
              lambda done, x: CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END) || regexp_extract(goes, '(?s)([?#].*)$', 1) END AS dst FROM seen) WHERE dst IS NOT NULL),
named AS (
  SELECT url, translate(split_part(url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
              || regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS node FROM (SELECT url FROM pages UNION SELECT src FROM link UNION SELECT dst FROM link) WHERE contains(url, '://')),
edge AS (SELECT a.node AS u, b.node AS v FROM link JOIN named a ON a.url = src JOIN named b ON b.url = dst),
reach AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge UNION SELECT reach.u, e.v FROM reach JOIN (SELECT u, v FROM edge UNION SELECT v, u FROM edge) e ON e.u = reach.v),
rule AS (SELECT * FROM (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
                               ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')) t(verdict, rule, domain, start)),
place AS (SELECT DISTINCT node, regexp_extract(node, '://([^/?#]*)', 1) AS host, regexp_extract(node, '://[^/?#]*([^?#]*)', 1) AS path FROM named),
judged AS (
  SELECT node, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM place JOIN rule ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY 1),
alias AS (SELECT u AS node, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM reach JOIN judged ON node = v GROUP BY 1)
SELECT page_id, host, path, judged.rule AS rule, coalesce(judged.verdict, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN judged.rule IS NOT NULL THEN 'rule' WHEN blocked AND NOT allowed THEN 'alias' ELSE 'none' END AS via
FROM page LEFT JOIN (SELECT DISTINCT url, node FROM named) n ON n.url = page.url LEFT JOIN judged ON judged.node = n.node LEFT JOIN alias ON alias.node = n.node
"""
