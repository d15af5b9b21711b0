"""URL filters with redirect equivalence, in native expressions.

A url's host and path are matched by rules; the longest fitting rule decides. Urls that no rule fits take the decision of
their aliases: pages are linked by canonical links and redirects (meta refresh, and a table of redirects where
there is one), connected components over these links are found by distributed rounds, and a component with a blocked member
blocks all members without a rule of their own. An explicit allow always wins over what aliases say.

Link targets are references: character references in them are decoded, and they are resolved against the page's url (targets
of the redirects against their source), with dot segments removed; a url without a path names the root. A base element is not read. ORACLE resolves only targets
with ://, // or a leading /, and decodes none.

Defined results: a null url, or one without ://, has empty host and path, fits no rule and has no alias; a null html has no links;
repeated pages are judged alike; an empty table gives an empty table; extra columns pass through, those named as
a result are replaced, and names that start with _url_ are reserved.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, let

#: action, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?"
#: path and query of a reference; one that starts with a scheme
RELATIVE, SCHEME = "(?s)^([^?#]*)(\\?[^#]*)?", "^[A-Za-z][A-Za-z0-9+.-]*:"
#: a character reference, as attributes hold them, or what lies between two
REFERENCE = "&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;|&[A-Za-z][A-Za-z0-9]*(?![=A-Za-z0-9;])|[^&]+|&"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def node_of(url: Column) -> Column:
    """What a url names, whatever its scheme and fragment; null where it names nothing."""
    u = F.coalesce(url, F.lit(""))
    path = let(path_of(u), lambda p: F.when(p == "", F.lit("/")).otherwise(without_dots(p)))  # no path names the root
    return F.when(F.instr(u, "://") > 0, F.concat(host_of(u), path, F.regexp_extract(u, PARTS, 3)))


def without_dots(path: Column) -> Column:
    """An absolute path without the segments . and .., which go up at most to the root."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    add = lambda done, x: (
        F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    )
    left = F.aggregate(parts, F.array().cast("array<string>"), add)
    tail = F.when(path.rlike("/\\.\\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike("/\\.\\.?(/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(left, tail), "/"))).otherwise(path)


def decoded(value: Column) -> Column:
    """An attribute's value with its character references replaced; unknown ones stay as they are."""
    known = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")
    western = F.lit("".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)))  # what 128 to 159 stand for

    def numbered(x: Column) -> Column:
        digits = F.regexp_extract(x, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
        base16 = F.conv(digits, 16, 10).cast("long")
        code = F.when(F.length(digits).between(1, 7), F.when(x.rlike("^&#[xX]"), base16).otherwise(digits.try_cast("long")))
        return let(
            F.coalesce(code, F.lit(0)),
            lambda n: F.when(n.between(128, 159), F.substr(western, (n - 127).cast("int"), F.lit(1))).otherwise(
                F.decode(F.unhex(F.lpad(F.hex(F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), n).otherwise(0xFFFD)), 8, "0")), "UTF-32"),
            ),
        )

    one = lambda x: (
        F.when(x.startswith("&#") & (F.length(x) > 2), numbered(x))
        .when(x.startswith("&"), F.coalesce(F.try_element_at(known, F.substr(x, F.lit(2))), x)).otherwise(x)
    )
    tokens = F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(0))
    return F.when(value.contains("&"), F.array_join(F.transform(tokens, one), "")).otherwise(value)


def resolved(to: Column, url: Column) -> Column:
    """The url that a reference names on the page of this url."""
    path, query = F.regexp_extract(to, RELATIVE, 1), F.regexp_extract(to, RELATIVE, 2)
    here = path_of(url)
    folder = F.when(here == "", F.lit("/")).otherwise(F.regexp_replace(here, "[^/]*$", ""))
    same = F.concat(here, F.when(query == "", F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 3)).otherwise(query))
    local = F.when(path == "", same).when(path.startswith("/"), F.concat(path, query)).otherwise(F.concat(folder, path, query))
    return (
        F.when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.rlike(SCHEME), to)
        .otherwise(F.concat(F.lit("http://"), host_of(url), local))
    )


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(len, rule, action) of the longest rule that fits, or null. Of equal lengths an allow wins."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("len"), F.lit(int(action == "allow")).alias("allow"), F.lit(h + p).alias("rule"), F.lit(action).alias("action")),
        )
        for action, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def node_at(to: Column, url: Column) -> Column:
    """What a reference names on the page of this url."""
    return let(resolved(to, url), node_of)  # each step once: its value is named many times in the next


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): node of the page and of the target of its canonical links and meta refreshes."""
    text = F.coalesce(F.col(html), F.lit(""))
    tag = lambda name, attr, value: F.regexp_extract_all(text, F.lit(f"(?is)<{name}\\b[^>]*\\b{attr}\\s*=\\s*[\"']?{value}[\"'\\s>/][^>]*>?"), F.lit(0))
    hrefs = F.transform(tag("link", "rel", "canonical"), lambda x: F.regexp_extract(x, "(?is)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)", 1))
    moves = F.transform(tag("meta", "http-equiv", "refresh"), lambda x: F.regexp_extract(x, "(?is)\\burl\\s*=\\s*[\"']?((?:&#?\\w+;|[^\"'\\s>;])+)", 1))
    found = (
        pages.where(F.lower(text).rlike("canonical|refresh"))
        .select(F.col(url), F.explode(F.concat(hrefs, moves)).alias("to")).where("to <> ''")
    )
    b = let(decoded(F.col("to")), lambda to: node_at(to, F.col(url)))
    return found.select(node_of(F.col(url)).alias("a"), b.alias("b"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict. redirects: (source_url, target_url)."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("source_url")), node_at(F.col("target_url"), F.col("source_url"))))
    members = scratch.save(connected_components(scratch, edges))
    parts = F.split("node", "[?]", 2)[0]
    slash = F.instr(parts, "/")
    host = F.when(slash > 0, F.substring(parts, F.lit(1), slash - 1)).otherwise(parts)
    path = F.when(slash > 0, F.substring(parts, slash, F.length(parts))).otherwise(F.lit(""))
    bad = (
        members.withColumn("_url_r", longest_rule(host, path, rules)).where("_url_r.action = 'block'")
        .select("component").distinct()
    )
    aliases = members.join(bad, "component", "left_semi").select(F.col("node").alias("_url_node")).distinct()
    own = (
        pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
        .withColumn("_url_r", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("_url_n", node_of(F.col(url)))
    )
    if aliases.isEmpty():  # no component is blocked: the rules alone decide
        out = own.withColumn("_url_node", F.lit(None).cast("string"))
    else:
        out = own.join(aliases, own["_url_n"] == aliases["_url_node"], "left")
    by_method = F.when(F.col("_url_node").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return (
        out.withColumn("rule", F.col("_url_r.rule")).withColumn("verdict", F.coalesce(F.col("_url_r.action"), by_method))
        .drop("_url_r", "_url_n", "_url_node")
    )


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH RECURSIVE u AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
p AS (SELECT page_id, url, html,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) AS path,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS qs FROM u),
rules(action, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
t AS (
  SELECT page_id, host, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical["''\s>/][^>]*>?'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh["''\s>/][^>]*>?'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)))) AS x,
    host || CASE WHEN path = '' THEN '/' ELSE path END || qs AS node, contains(url, '://') AS named FROM p),
e0 AS (SELECT node AS a, CASE WHEN starts_with(x, '//') THEN 'http:' || x WHEN starts_with(x, '/') THEN 'http://' || host || x ELSE x END AS b FROM t WHERE named AND x <> ''),
e1 AS (SELECT a, translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || coalesce(nullif(regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2), ''), '/') || regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS b FROM e0 WHERE contains(b, '://')),
e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
reach(n, m) AS (SELECT a, b FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.m = e.a),
nodes AS (SELECT DISTINCT m, regexp_extract(m, '^([^/?]*)([^?]*)', 1) AS host, regexp_extract(m, '^([^/?]*)([^?]*)', 2) AS path FROM reach),
bad AS (SELECT m FROM (SELECT m, first(action ORDER BY length(h || pre) DESC, action) AS action FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY m) WHERE action = 'block'),
best AS (
  SELECT page_id, first(h || pre ORDER BY length(h || pre) DESC, action) AS rule, first(action ORDER BY length(h || pre) DESC, action) AS action
  FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, best.rule,
  coalesce(best.action, CASE WHEN contains(p.url, '://') AND EXISTS (SELECT 1 FROM reach JOIN bad ON reach.m = bad.m WHERE reach.n = p.host || CASE WHEN p.path = '' THEN '/' ELSE p.path END || p.qs) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)
"""
