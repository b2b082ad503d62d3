"""URL filters with redirect equivalence. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import ascii_lower, checkpoint, connected_components, table

# (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """Identity of a resource: host, path and query; null for a url without '://'."""
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(url_host(url), url_path(url), query))


def best_rule(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent domain, else null.

    Equally long rules: allow goes first.
    """
    fits = []
    for verdict, rule_host, rule_path in rules:
        fit = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = rule_host + rule_path
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("n"), F.lit(verdict == "allow").alias("a"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    best = F.array_max(F.array(*fits))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) urls from rel=canonical links and meta refresh redirects; root-relative targets take the page's host."""
    html = F.col(html_col)
    canonical = F.coalesce(
        F.nullif(F.regexp_extract(html, r"""(?i)<link\b[^>]*\brel=["']?canonical\b[^>]*\bhref=["']?([^"'\s>]+)""", 1), F.lit("")),
        F.nullif(F.regexp_extract(html, r"""(?i)<link\b[^>]*\bhref=["']?([^"'\s>]+)[^>]*\brel=["']?canonical\b""", 1), F.lit("")),
    )
    refresh = F.nullif(F.regexp_extract(html, r"""(?i)<meta\b[^>]*\bhttp-equiv=["']?refresh\b[^>]*\burl=["']?([^"'\s>]+)""", 1), F.lit(""))
    found = pages.select(F.col(url_col).alias("src"), F.explode(F.array_compact(F.array(canonical, refresh))).alias("to"))
    origin = F.regexp_extract("src", r"^(.*?://[^/?#]*)", 1)
    to = F.when(F.startswith("to", F.lit("/")) & ~F.startswith("to", F.lit("//")), F.concat(origin, "to")).otherwise(F.col("to"))
    return found.select("src", F.replace(to, F.lit("&amp;"), F.lit("&")).alias("dst"))


def url_verdicts(pages: DataFrame, edges: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to pages (columns of these names are replaced).

    edges: (src, dst) urls of redirects and canonical links. A page's own rule always holds.
    Without one, its component of the link graph decides: an explicit allow on any member wins
    over blocks, a block on any member blocks, and with neither the page is allowed. Null urls,
    and urls without '://', have empty host and path and no links. Ties and repeated pages get
    the same verdict, each in its own row.
    """
    ends = edges.select(url_node(F.col("src")).alias("a"), url_node(F.col("dst")).alias("b")).where("a is not null and b is not null and a <> b")
    ends = checkpoint(ends.distinct())
    own = best_rule(F.col("host"), F.col("path"), rules)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # the caller's columns travel as one, so that none of them meets a name used here
    out = pages.select(F.struct(*keep).alias("row"), url_node(F.col(url_col)).alias("node"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    out = out.withColumn("own", own)
    linked = F.lit(None).cast("string")
    if not ends.isEmpty():
        member = connected_components(ends)
        host, path = F.substring_index("node", "/", 1), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)
        ruled = member.withColumn("v", best_rule(F.regexp_extract("node", r"^([^/?]*)", 1), path, rules)["verdict"])
        said = ruled.where("v is not null").groupBy("component").agg(F.min("v").alias("said"))  # 'allow' sorts first
        out = out.join(member.join(said, "component").select("node", "said"), "node", "left")
        linked = F.col("said")
    return out.select(
        "row.*", "host", "path", F.col("own")["rule"].alias("rule"),
        F.coalesce(F.col("own")["verdict"], linked, F.lit("allow")).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = url_verdicts(pages.select("page_id", "url"), link_edges(pages))
    return out.select("page_id", "host", "path", "rule", "verdict")


_HOST = "coalesce(translate(regexp_extract({u}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"
_NODE = "case when contains({u}, '://') then " + _HOST + " || " + _PATH + " || regexp_extract({u}, '://[^?#]*(\\?[^#]*)', 1) end"

ORACLE = rf"""
with recursive rules(verdict, h, p) as (values {", ".join(str(r) for r in RULES)}),
found as (
  select url as src, unnest([
    coalesce(nullif(regexp_extract(html, '(?i)<link\b[^>]*\brel=["'']?canonical\b[^>]*\bhref=["'']?([^"''\s>]+)', 1), ''),
             nullif(regexp_extract(html, '(?i)<link\b[^>]*\bhref=["'']?([^"''\s>]+)[^>]*\brel=["'']?canonical\b', 1), '')),
    nullif(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv=["'']?refresh\b[^>]*\burl=["'']?([^"''\s>]+)', 1), '')]) as t
  from pages),
e as (
  select src, replace(case when t like '/%' and t not like '//%' then regexp_extract(src, '^(.*?://[^/?#]*)', 1) || t else t end, '&amp;', '&') as dst
  from found where t is not null),
n as (select {_NODE.format(u="src")} as a, {_NODE.format(u="dst")} as b from e),
both_ways as (select a, b from n where a <> b union select b, a from n where a <> b),
reach(a, b) as (select a, a from both_ways union select r.a, w.b from reach r join both_ways w on w.a = r.b),
said as (
  select r.a as node, min(x.verdict) as said from reach r
  join lateral (
    select verdict from rules
    where (regexp_extract(r.b, '^([^/?]*)', 1) = h or suffix(regexp_extract(r.b, '^([^/?]*)', 1), '.' || h))
      and starts_with(regexp_extract(r.b, '^[^/?]*([^?]*)', 1), p)
    order by length(h || p) desc, verdict limit 1) x on true
  group by r.a),
u as (
  select page_id, {_HOST.format(u="url")} as host, {_PATH.format(u="url")} as path, {_NODE.format(u="url")} as node from pages),
fit as (
  select u.page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from u join rules on (host = h or suffix(host, '.' || h)) and starts_with(path, p) group by u.page_id)
select u.page_id, host, path, fit.rule, coalesce(fit.verdict, said.said, 'allow') as verdict
from u left join fit using (page_id) left join said on said.node = u.node
"""
