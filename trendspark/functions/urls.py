"""URL expressions: parts, repair, identities, source labels. Lenient, as stored links are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_LINK = "링크 없음"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def is_absolute(u: Column) -> Column:
    return F.rlike(u, F.lit(r"^(?i:https?)://[^/?#]+"))


def parameter(u: Column, key: str) -> Column:
    """Value of the first such parameter as written; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(query(u), rf"(?:^|&){key}=([^&]*)", 1), F.lit(""))


def repair_url(raw: Column, keys: tuple[str, ...] = ("url", "q", "u")) -> Column:
    """Absolute links stay; else the target that a redirect link carries, decoded twice; else NO_LINK."""
    u = F.trim(raw)
    plus = F.lit("%2B")
    targets = []
    for k in keys:
        once = F.try_url_decode(parameter(u, k))
        target = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), plus)), once)
        targets.append(F.when(is_absolute(target), target))
    return F.when(is_absolute(u), u).otherwise(F.coalesce(*targets, F.lit(NO_LINK)))


def is_content(raw: Column) -> Column:
    """Profiles of the photo site are no content; posts, reels and videos with an id are."""
    u = repair_url(F.coalesce(raw, F.lit("")))
    social = F.rlike(host(u), F.lit(r"(^|\.)instagram\.com$"))
    return ~social | F.rlike(path(u), F.lit(r"^/*(p|reel|reels|tv)/+[^/]+"))


def source_identity(u: Column) -> Column:
    """Struct (host, path, query) that mobile and encoded forms of a post share."""
    h = F.when(host(u) == "m.blog.naver.com", "blog.naver.com").otherwise(host(u))
    p = F.coalesce(F.try_url_decode(F.replace(path(u), F.lit("+"), F.lit("%2B"))), path(u))
    p = F.when(F.endswith(h, F.lit(".tistory.com")) & F.startswith(p, F.lit("/m/")), F.substring(p, F.lit(3), F.length(p))).otherwise(p)
    return F.struct(h.alias("host"), F.regexp_replace(p, "/+$", "").alias("path"), query(u).alias("query"))


def canonical_key(u: Column) -> Column:
    """Blog and post number of the two link forms of the blog host; null for other links."""
    blog = F.contains(host(u), F.lit("blog.naver.com"))
    by_path = F.regexp_extract_all(path(u), F.lit(r"^/([A-Za-z0-9_-]+)/(\d+)/?$"), 0)
    view = F.endswith(F.regexp_replace(path(u), "/+$", ""), F.lit("PostView.naver"))
    key = lambda a, b: F.concat(F.lit("naver_blog::"), a, F.lit("::"), b)
    from_path = F.when(F.size(by_path) > 0, key(F.regexp_extract(path(u), r"^/([A-Za-z0-9_-]+)/(\d+)/?$", 1), F.regexp_extract(path(u), r"^/([A-Za-z0-9_-]+)/(\d+)/?$", 2)))
    return F.when(blog, F.when(view, key(parameter(u, "blogId"), parameter(u, "logNo"))).otherwise(from_path))


def source_label(u: Column, domains: dict[str, str], default: str = "web") -> Column:
    """Label of the first domain that the host contains."""
    out = F.lit(default)
    for domain, label in reversed(domains.items()):
        out = F.when(F.contains(host(u), F.lit(domain)), label).otherwise(out)
    return out
