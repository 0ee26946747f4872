"""URL filters with redirect equivalence.

Pages that are names of one resource (declared canonical links, HTML refresh
redirects, and URLs equal up to scheme, default port, fragment and tracking
parameters) form connected components. A block decided for one member reaches
the members without a rule of their own, unless a member is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.llm.common import lower_ascii, written
from grainline.llm.components import connected_components

#: Fixed by the query's contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TRACKING = ("utm_[^=&#]*", "gclid", "fbclid", "ref")


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty without ``://`` or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (as host + path; ties: allow, then by text) that fits
    the host or a parent domain of it and a prefix of the path: a struct
    (rule, verdict), null if none fits. ``rules`` is a literal list."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    out = None
    for verdict, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else F.when(fits, hit).otherwise(out)
    return out


def resource_key(url: Column, tracking=TRACKING) -> Column:
    """One name for URLs that differ in scheme, host case, default port,
    fragment or tracking parameters only; null without ``://``."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    if tracking:
        query = F.regexp_replace(query, rf"(^|&)(?:{'|'.join(tracking)})(=[^&]*)?(?=&|$)", "")
    query = F.regexp_replace(query, "^&+", "")
    key = F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.contains(url, F.lit("://")), key)


def _resolved(base: Column, ref: Column) -> Column:
    """A link's absolute URL (``.`` and ``..`` parts are kept as they are)."""
    ref = F.replace(F.trim(ref), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(ref == "", None)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("#") | ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(F.when(folder.endswith("/") & (folder != F.concat(scheme, F.lit("://"))), folder)
                            .otherwise(F.concat(root, F.lit("/"))), ref))
    )


def declared_links(url: Column, html: Column) -> Column:
    """Absolute targets of a page's canonical links and refresh redirects;
    tags inside comments, scripts and styles do not count."""
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tags = F.regexp_extract_all(clean, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    value = lambda t, name: F.regexp_extract(t, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)^[^=]*=\s*", ""), r"""^["']|["']$""", "")
    canon = F.filter(tags, lambda t: bare(value(t, "rel")).rlike(r"(?i)(^|\s)canonical(\s|$)"))
    moved = F.filter(tags, lambda t: bare(value(t, "http-equiv")).rlike(r"(?i)^\s*refresh\s*$"))
    refs = F.concat(
        F.transform(canon, lambda t: bare(value(t, "href"))),
        F.transform(moved, lambda t: F.regexp_extract(bare(value(t, "content")), r"""(?is)url\s*=\s*["']?([^"']*)""", 1)),
    )
    found = F.transform(refs, lambda r: _resolved(url, r))
    maybe = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    return F.when(maybe & F.contains(url, F.lit("://")), F.filter(found, lambda x: x.isNotNull()))


def judge_urls(pages: DataFrame, rules=RULES, tracking=TRACKING) -> DataFrame:
    """page_id, host, path, rule, verdict, by_alias for every row of ``pages``
    (page_id, url, html).

    A page's own rule decides first. Else it is blocked if its component holds
    an URL, of the table or the target of a link, with a blocking rule and none
    with an allowing one; else allowed. Null urls and urls without ``://`` have
    an empty host and path, belong to no component and are allowed; null html
    declares no links; repeated rows are judged each; an empty table gives no
    rows. Hubs with very many aliases are handled by the components' grouped
    minima.
    """
    rows = pages.select("page_id", "url", "html")
    links = (
        rows.select(F.col("url"), F.explode(declared_links(F.col("url"), F.col("html"))).alias("target"))
        .select(resource_key(F.col("url"), tracking).alias("u"), resource_key(F.col("target"), tracking).alias("v"), "target")
        .filter("u IS NOT NULL AND v IS NOT NULL").distinct()
    )
    links = written(links, "links")
    labels = connected_components(links.select("u", "v"))

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = rows.select("page_id", "url").select(
        "page_id", host.alias("host"), path.alias("path"), resource_key(F.col("url"), tracking).alias("key")
    ).withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    targets = links.select(F.col("v").alias("key"), host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"))
    targets = targets.select("key", matching_rule(F.col("host"), F.col("path"), rules).alias("own"))
    said = judged.select("key", "own").unionByName(targets).filter("key IS NOT NULL AND own IS NOT NULL")
    flag = lambda v: F.max(F.col("own.verdict") == v)
    by_key = said.groupBy("key").agg(flag("block").alias("block"), flag("allow").alias("allow"))
    by_group = (
        by_key.join(labels.withColumnRenamed("node", "key"), "key", "left")
        .groupBy(F.coalesce("component", "key").alias("group"))
        .agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
        .filter("block AND NOT allow").select("group")
    )
    blocked = by_group.select(F.col("group").alias("key")).unionByName(
        labels.join(by_group, F.col("component") == F.col("group")).select(F.col("node").alias("key"))
    ).distinct().withColumn("by_alias", F.lit(True))
    out = judged.join(blocked, "key", "left")
    by_alias = F.coalesce("by_alias", F.lit(False)) & F.col("own").isNull()
    return out.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(by_alias, "block").otherwise("allow")).alias("verdict"),
        by_alias.alias("by_alias"),
    )
