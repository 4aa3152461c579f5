"""URL filters that treat redirect-equivalent addresses as one page.

Native DataFrame code only.  Rules decide the urls they fit.  The urls that no
rule fits take a block from their aliases: urls connected with them by redirect
or canonical-link edges.  A rule on the url itself, allow or block, always
outranks what its aliases say.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import UPPER, components

#: Most rules compiled into one expression; more is an error, never a cut.
MAX_RULES = 500
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``target`` is host and path, like ``example.com/en/``."""

    verdict: str
    target: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.target.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """The address without scheme, fragment and ``utm_`` parameters: variants
    that lead to the same page.  Empty for null or what has no ``://``."""
    query = F.regexp_extract(url, r"^(?s).*?://[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.startswith("utm_") & (x != "")), "&")
    key = F.concat(host_of(url), path_of(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.coalesce(key, F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are supported")
    ranked = sorted(rules, key=lambda r: (-len(r.target), -len(r.host), r.verdict != ALLOW, r.target))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.target).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute url; ``//host``, ``/path`` and relative forms are completed."""
    scheme = F.regexp_extract(base, r"^(?s)(.*?)://", 1)
    root = F.regexp_extract(base, r"^(?s)(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^(?s)(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (src_url, dst_url) that pages state themselves: canonical links and
    refresh redirects.  Pages without such a tag give none."""
    url, html = F.col(url_col), F.col(html_col)
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), 0)
    # an element holds at most one of both kinds of address
    href = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    goes = r"(?i)\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*([^\"'\s>]+)"
    links = F.explode(tags)
    found = (
        pages.filter(html.rlike(r"(?i)rel\s*=\s*[\"']?canonical|http-equiv\s*=\s*[\"']?refresh"))
        .select(url.alias("_url"), links.alias("_tag"))
        .select(
            "_url",
            F.when(F.col("_tag").rlike(r"(?i)rel\s*=\s*[\"']?canonical"), F.regexp_extract("_tag", href, 1))
            .when(F.col("_tag").rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"), F.regexp_extract("_tag", goes, 1))
            .alias("_link"),
        )
        .filter("_link <> '' and _url is not null")
    )
    return found.select(F.col("_url").alias("src_url"), resolved(F.col("_url"), F.col("_link")).alias("dst_url"))


def url_verdicts(
    pages: DataFrame,
    rules: list[Rule],
    edges: DataFrame | None = None,
    default: str = ALLOW,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """One row per page: (id, host, path, rule, verdict, inherited).

    ``edges`` (src_url, dst_url) adds logged redirects to those stated in the
    pages.  Components of equivalent urls are computed distributedly; a page
    without a rule is blocked if any url of its component is blocked by a rule
    (of a page or of an edge's end), and else takes ``default``.  Explicit rules
    win over inherited blocks.  Null urls and urls without ``://`` have empty
    host and path, match no rule, have no alias and take ``default``.  Repeated
    rows stay; an empty table gives no rows.  Only the named columns are read.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias(id_col), url.alias("_url"))
    judged = judged.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    judged = judged.withColumn("_found", matched_rule(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("_key", alias_key(F.col("_url")))

    stated = [] if html_col is None else [page_edges(pages, url_col, html_col)]
    stated += [] if edges is None else [edges.select("src_url", "dst_url")]
    blocked = judged.filter(F.col("_found.verdict") == BLOCK).select("_key")
    if stated:
        links = stated[0] if len(stated) == 1 else stated[0].unionAll(stated[1])
        ends = F.array(F.col("src_url"), F.col("dst_url"))
        far = links.select(F.explode(ends).alias("_url"))
        far = far.withColumn("_found", matched_rule(host_of(F.col("_url")), path_of(F.col("_url")), rules))
        blocked = blocked.unionAll(far.filter(F.col("_found.verdict") == BLOCK).select(alias_key(F.col("_url")).alias("_key")))
        nodes = components(
            links.select(alias_key(F.col("src_url")).alias("src"), alias_key(F.col("dst_url")).alias("dst")).filter(
                "src <> '' and dst <> ''"
            ),
            "url-aliases",
        )
        bad = nodes.join(blocked.distinct(), F.col("node") == F.col("_key"), "left_semi").select("component").distinct()
        aliases = nodes.join(bad, "component", "left_semi").select(F.col("node").alias("_key"))
        blocked = blocked.unionAll(aliases)
    blocked = blocked.filter("_key <> ''").distinct().select("_key", F.lit(True).alias("_blocked"))

    ruled = judged.filter("_found is not null").select(
        id_col, "host", "path", F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("verdict"), F.lit(False).alias("inherited")
    )
    free = judged.filter("_found is null").join(blocked, "_key", "left").select(
        id_col,
        "host",
        "path",
        F.lit(None).cast("string").alias("rule"),
        F.when(F.col("_blocked"), F.lit(BLOCK)).otherwise(F.lit(default)).alias("verdict"),
        F.coalesce("_blocked", F.lit(False)).alias("inherited"),
    )
    return ruled.unionAll(free)
