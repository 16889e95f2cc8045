"""URL rules whose block decisions reach the aliases of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.llm._common import attach, col, saved
from covary.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): the rules of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*['"]?([^"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for a null or a url without ``://``."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """The url as a node of the alias graph: no fragment, scheme and host in
    lower case; null without ``://``."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(_lower(head), tail))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null. A
    rule fits its host and all subdomains if the path starts with its path.
    The rules are literals of the plan, so no table is joined."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def resolved(base: Column, ref: Column) -> Column:
    """A reference found on page ``base`` as an absolute url, null if empty."""
    ref = F.replace(ref, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?):", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (F.when(F.coalesce(ref, F.lit("")) == "", F.lit(None))
            .when(F.contains(ref, F.lit("://")), ref)
            .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
            .when(F.startswith(ref, F.lit("/")), F.concat(root, ref))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), ref)))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)``: each page's url with its canonical link and its refresh
    target, found in the html."""
    url, html = col(url_col), col(html_col)
    tags = [(CANONICAL, HREF), (REFRESH, REFRESH_URL)]
    refs = [F.regexp_extract(F.regexp_extract(html, tag, 0), ref, 1) for tag, ref in tags]
    out = pages.filter(F.contains(url, F.lit("://"))).select(
        url_node(url).alias("a"), F.explode(F.array(*[url_node(resolved(url, r)) for r in refs])).alias("b"))
    return out.filter("a <> b")


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id",
                 url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None,
                 default: str = "allow") -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict``.

    A page with a matching rule has the rule's verdict. Any other page takes
    that of its aliases, the urls connected to its own by canonical links,
    refresh targets and the rows of ``redirects`` (``source, target``): allow
    if any of them is allowed by a rule, else block if any is blocked by one,
    else ``default``. Urls that are only link targets count as aliases and
    are judged by the rules too. Null urls, and urls without ``://``, have
    empty host and path, no aliases and the default verdict; repeated rows
    are judged alike; an empty table gives an empty result. Other columns are
    not read.
    """
    url = col(url_col)
    edges = []
    if html_col is not None:
        edges.append(alias_edges(pages, url_col, html_col))
    if redirects is not None:
        edges.append(redirects.select(url_node(F.col("source")).alias("a"), url_node(F.col("target")).alias("b")))
    rows = pages.select(col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"),
                        url_node(url).alias("node")).withColumn(
        "own", matching_rule(F.col("host"), F.col("path"), rules))

    def judged(frame: DataFrame, alias: Column) -> DataFrame:
        verdict = F.coalesce("own.verdict", alias, F.lit(default))
        return frame.select(F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"),
                            verdict.alias("verdict"))

    every = None
    for e in edges:
        every = e if every is None else every.unionByName(e)
    every = None if every is None else saved(every, "url-edges")
    if every is None or every.isEmpty():
        return judged(rows, F.lit(None).cast("string"))
    nodes = saved(connected_components(every), "url-nodes")
    ruled = nodes.withColumn("own", matching_rule(url_host(F.col("node")), url_path(F.col("node")), rules))
    # 'allow' < 'block': the smallest verdict gives an explicit allow precedence
    roots = saved(ruled.groupBy("root").agg(F.min("own.verdict").alias("alias"), F.count(F.lit(1)).alias("n")),
                  "url-roots")
    total = nodes.count()
    known = attach(nodes, roots.filter("alias IS NOT NULL"), ["root"], "n", total).filter(
        "alias IS NOT NULL").select("node", "alias")
    # a url may stand on many pages: only rows without a rule need the join
    rows = saved(rows, "url-rows")
    share = saved(rows.filter("own IS NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
                  .join(known, "node"), "url-share")
    out = attach(rows, share, ["node"], "n", rows.count())
    return judged(out, F.col("alias"))
