"""URL tables and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework import rules
from sievework.functions import urls
from sievework.functions.text import contains_any, unescape, unnest
from sievework.operators.keys import first_per_key, limit_per_key
from sievework.operators.positions import with_position
from sievework.session import cut

_LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def dedupe_urls(df: DataFrame, url: str, order: str) -> DataFrame:
    """The first row of each fingerprint."""
    return first_per_key(df, [urls.fingerprint(F.col(url))], order)


def extract_links(pages: DataFrame, page: str, url: str = "url", html: str = "html") -> DataFrame:
    """(page, pos, link), normalised, in page order, each link once per page."""
    shown = F.regexp_replace(html, _HIDDEN, "")
    raw = F.regexp_extract_all(shown, F.lit(_LINK), F.lit(1))
    hrefs = F.transform(raw, lambda h: unescape(F.regexp_replace(h, "^[\"']|[\"']$", "")))
    usable = F.filter(hrefs, lambda h: (h != "") & ~h.startswith("javascript:") & (h != "#"))
    links = F.array_distinct(F.transform(usable, lambda h: urls.normalize_url(urls.resolve_link(F.col(url), h))))
    return unnest(pages, [page], links, "link", "pos")


def bounded_crawl(
    seeds: DataFrame, links: DataFrame, max_depth: int = 2, max_pages: int = 10, same_host: bool = True,
    fetched: DataFrame | None = None,
) -> DataFrame:
    """(seed, url, depth, place) in breadth-first order.

    ``seeds(seed)`` and ``links(src, pos, link)`` hold normalised URLs. Each seed keeps at most
    ``max_pages`` rows, so no frontier grows beyond that; ``fetched(url)`` limits the result
    to pages that exist.
    """
    useful = links.groupBy("src", "link").agg(F.min("pos").alias("pos"))
    if same_host:
        # every page of a seed's frontier is on the seed's host
        useful = useful.filter(urls.host(F.col("link")) == urls.host(F.col("src")))
    if fetched is not None:
        useful = useful.join(fetched.select(F.col("url").alias("link")), "link", "left_semi")
    # a seed has at most max_pages URLs behind it, so of one page no more than the first
    # 2 * max_pages links can ever matter: hubs do not fan out
    useful = cut(limit_per_key(useful, ["src"], ["pos", "link"], 2 * max_pages).drop("rn"))
    visited = cut(seeds.select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("place")))
    frontier = visited
    for depth in range(1, max_depth + 1):
        step = frontier.join(useful, frontier["url"] == useful["src"])
        found = step.select("seed", F.col("link").alias("url"), F.struct("place", "pos").alias("_at"))
        found = found.groupBy("seed", "url").agg(F.min("_at").alias("_at"))
        found = found.join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
        done = visited.groupBy("seed").agg(F.max("place").alias("_done"))
        w = Window.partitionBy("seed").orderBy("_at")
        # row_number <= constant lets Spark cut every map task to max_pages rows per seed
        found = found.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_pages).join(done, "seed")
        found = found.filter(F.col("_rn") + F.col("_done") <= max_pages)
        frontier = cut(found.select("seed", "url", F.lit(depth).alias("depth"), (F.col("_rn") + F.col("_done")).cast("long").alias("place")))
        if frontier.isEmpty():
            break
        visited = cut(visited.unionByName(frontier))
    return visited


def robots_filter(pages: DataFrame, robots: DataFrame, url: str, agent: str = "*") -> DataFrame:
    """Adds ``allowed``; the longest matching rule of the host decides, none allows.

    ``robots(host, agent, path, allow)``. A host with very many rules or pages is no hot task:
    matches are reduced by a map-side aggregate.
    """
    mine = robots.filter(F.col("agent").isin(agent, "*")).select(F.col("host").alias("_host"), "path", "allow")
    hosts = pages.select(url).distinct().withColumn("_host", urls.host(F.col(url)))
    path = urls.part(F.col(url), 3)
    matches = hosts.join(mine, "_host").filter((F.col("path") != "") & path.startswith(F.col("path")))
    verdict = matches.groupBy(url).agg(
        F.max_by("allow", F.struct(F.length("path"), F.col("allow"))).alias("_allow")
    )
    return pages.join(verdict, url, "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")


def crawl_schedule(pages: DataFrame, url: str, order: str, delay: float = 0.5) -> DataFrame:
    """Earliest second at which each URL of a host may be fetched."""
    rows = with_position(pages.withColumn("host", urls.host(F.col(url))), order, ["host"], out="_pos")
    return rows.withColumn("offset_s", (F.col("_pos") - 1) * delay).drop("_pos")


def squeeze_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[ .\-]", "")


def match_official_site(hits: DataFrame, name: str = "name", url: str = "url", query_no: str = "query_no", rank: str = "rank") -> DataFrame:
    """(name, website): first hit that carries the name, else the first hit."""
    usable = hits.filter(~urls.is_skipped(F.col(url), "official") & (F.col(url) != ""))
    low = F.lower(url)
    for piece in ("www.", "http://", "https://"):
        low = F.replace(low, F.lit(piece), F.lit(""))
    squeezed = squeeze_name(F.col(name))
    match = F.contains(F.replace(low, F.lit("."), F.lit("")), squeezed) | (F.split_part(low, F.lit("."), F.lit(1)) == squeezed)
    return usable.groupBy(name).agg(F.min_by(url, F.struct(~match, F.col(query_no), F.col(rank))).alias("website"))


def match_profile_url(hits: DataFrame, pages: DataFrame | None = None, name: str = "name", url: str = "url", rank: str = "rank", parts: int | None = None) -> DataFrame:
    """(name, profile): first profile hit, else the first profile link in the hit's page. With ``parts`` both are dealt to so many partitions."""
    direct = F.when(F.col(url).contains("linkedin.com/company/"), F.col(url))
    rows = hits.withColumns({"_direct": direct, "_inside": F.lit(None).cast("string")})
    if pages is not None:
        inside = F.nullif(
            F.regexp_extract("html", r'(https?://[^\s"]+linkedin\.com/company/[^\s"]+)', 1), F.lit("")
        )
        rows, seen = rows.drop("_inside"), pages.select(url, inside.alias("_inside"))
        if parts is not None:
            rows, seen = rows.repartition(parts, url), seen.repartition(parts, url).hint("merge")
        rows = rows.join(seen, url, "left")
    found = rows.filter(F.col("_direct").isNotNull() | F.col("_inside").isNotNull())
    return found.groupBy(name).agg(
        F.min_by(F.coalesce("_direct", "_inside"), F.struct(F.col("_direct").isNull(), F.col(rank))).alias("profile")
    )


def domain_stats(pages: DataFrame, url: str, k: int = 5) -> DataFrame:
    """The k hosts with most results."""
    counts = pages.groupBy(urls.host(F.col(url)).alias("host")).agg(F.count(F.lit(1)).alias("results"))
    return counts.orderBy(F.desc("results"), F.asc("host")).limit(k)


def site_rules(url: Column, table: list[tuple[str, str]]) -> Column:
    """Label of the first ``(needle, label)`` rule whose needle the URL contains."""
    low = F.lower(url)
    tests = [F.when(F.contains(low, F.lit(needle)), label) for needle, label in table]
    return F.coalesce(*tests, F.lit("generic"))


def extractor_kind(url: Column) -> Column:
    site = urls.host(url)
    out = None
    for name, needle in rules.EXTRACTOR_HOSTS:
        out = F.when(contains_any(site, [needle]), name) if out is None else out.when(contains_any(site, [needle]), name)
    return out.otherwise("generic")
