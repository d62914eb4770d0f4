"""URL tables and the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework import rules
from sievework.catalog.base import like_any, query, sql_in
from sievework.functions import urls
from sievework.operators import linkgraph


def norm_cte(source: str = "select page_id, url from pages", key: str = "page_id") -> str:
    """SQL for U01 over ``source(key, url)``; percent-encoding does not occur in these tables."""
    return rf"""parts as (select *, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) as s,
      lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as h,
      lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) as p,
      regexp_extract(url, '\?([^#]*)', 1) as q from ({source})),
    kept as (select *, list_sort([x for x in string_split(q, '&') if regexp_matches(x, '^[^=]*=.')
      and split_part(x, '=', 1) not in {sql_in(rules.TRACKING_PARAMETERS)}]) as k from parts),
    norm as (select *, concat(s, '://', case when s = 'http' then regexp_replace(h, ':80$', '') else regexp_replace(h, ':443$', '') end,
      case when length(p) > 1 then regexp_replace(p, '/$', '') else p end,
      case when len(k) > 0 then concat('?', array_to_string(k, '&')) else '' end) as url_norm from kept)"""


@query("u01_normalize_urls", f"with {norm_cte()} select page_id, url_norm from norm")
def u01(t):
    return t("pages").select("page_id", urls.normalize_url(F.col("url")).alias("url_norm"))


@query("u02_fingerprint_urls", f"with {norm_cte()} select page_id, md5(url_norm) as url_fp from norm")
def u02(t):
    return t("pages").select("page_id", urls.fingerprint(F.col("url")).alias("url_fp"))


@query(
    "u03_dedupe_urls",
    f"with {norm_cte()} select min(page_id) as page_id, arg_min(url, page_id) as url from norm group by md5(url_norm)",
)
def u03(t):
    return linkgraph.dedupe_urls(t("pages").select("page_id", "url"), "url", "page_id")


@query(
    "u04_classify_site",
    "select page_id, case "
    + " ".join(f"when {like_any('lower(url)', n)} then '{k}'" for k, n in rules.SITE_TYPES)
    + " else 'generic' end as site from pages",
)
def u04(t):
    return t("pages").select("page_id", urls.site_type(F.col("url")).alias("site"))


_SOCIAL = """select page_id, case page_id % 4 when 0 then concat('https://www.Reddit.com/r/', page_id)
  when 1 then concat('https://twitter.com/u', page_id) else url end as url from pages"""


@query(
    "u05_skip_domains",
    f"select page_id, url from ({_SOCIAL}) where not {like_any('lower(url)', rules.SKIP_SETS['discover'])}",
)
def u05(t):
    url = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.Reddit.com/r/"), "page_id"))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://twitter.com/u"), "page_id"))
        .otherwise(F.col("url"))
    )
    pages = t("pages").select("page_id", url.alias("url"))
    return pages.filter(~urls.is_skipped(F.col("url")))


LINKS_SQL = r"""hrefs as (select page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) as s, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) as h,
      unnest(l) as raw, generate_subscripts(l, 1) as i from (select page_id, url, regexp_extract_all(
        regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
        '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1) as l from pages)),
    clean as (select page_id, s, h, i, replace(replace(regexp_replace(raw, '^["'']|["'']$', '', 'g'), '&quot;', '"'), '&amp;', '&') as r from hrefs),
    full_links as (select page_id, i, case when r like 'http://%' or r like 'https://%' then r when r like '/%' then concat(s, '://', h, r)
      else concat(s, '://', h, '/', r) end as url from clean where r <> '' and r <> '#' and r not like 'javascript:%')"""


def _links_sql() -> str:
    return f"""{LINKS_SQL}, {norm_cte('select page_id, i, url from full_links')},
    firsts as (select page_id, url_norm as link, min(i) as i from norm group by 1, 2)"""


@query(
    "u06_extract_links",
    f"with {_links_sql()} select page_id, cast(row_number() over (partition by page_id order by i) - 1 as int) as pos, link from firsts",
)
def u06(t):
    return linkgraph.extract_links(t("pages", True), "page_id")


@query(
    "u07_bounded_crawl",
    f"""with pn as (with {norm_cte()} select page_id, url_norm as src from norm), seeds as (select distinct src as seed from pn),
    links as (with {_links_sql()} select f.link, pn.src, min(f.page_id * 10000 + f.i) as pos from firsts f join pn using (page_id)
      group by 1, 2),
    near as (select *, regexp_extract(src, '^[a-z]+://([^/?#]*)', 1) as a, regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) as b from links),
    l1 as (select src as seed, link as url, row_number() over (partition by src order by pos) + 1 as place from near
      where a = b and link <> src qualify place <= 10),
    l2c as (select l1.seed, near.link as url, min((l1.place, near.pos)) as first_at from l1 join near on near.src = l1.url
      where a = b and regexp_extract(l1.seed, '^[a-z]+://([^/?#]*)', 1) = b group by 1, 2),
    done as (select seed, max(place) as d from (select seed, 1 as place from seeds union all select seed, place from l1) group by 1),
    l2 as (select c.seed, c.url, row_number() over (partition by c.seed order by first_at) + d as place from l2c c join done using (seed)
      where c.url <> c.seed and not exists (select 1 from l1 where l1.seed = c.seed and l1.url = c.url) qualify place <= 10)
    select seed, seed as url, 0 as depth, 1 as place from seeds union all select seed, url, 1, place from l1
    union all select seed, url, 2, place from l2""",
)
def u07(t):
    """Links of all copies of a URL count; their order is page, then place on the page."""
    pages = t("pages", True)
    src = pages.select("page_id", urls.normalize_url(F.col("url")).alias("src"))
    found = linkgraph.extract_links(pages, "page_id").withColumn("pos", F.col("page_id") * 10000 + F.col("pos"))
    links = found.join(src, "page_id").groupBy("src", "link").agg(F.min("pos").alias("pos"))
    seeds = src.select(F.col("src").alias("seed")).distinct()
    return linkgraph.bounded_crawl(seeds, links)


_ROBOTS = """select distinct h as host, unnest([('/en', false), ('/en/2', true), ('/de/1', false), ('/', true)]) as r
  from (select lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as h from pages) where length(h) % 2 = 0"""


@query(
    "u08_robots_filter",
    f"""with rb as (select host, r[1] as path, r[2] as allow from ({_ROBOTS})),
    p as (select page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as h,
      regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) as pa from pages)
    select page_id, url, coalesce((select arg_max(allow, length(path)) from rb where rb.host = p.h and starts_with(p.pa, rb.path)), true)
      as allowed from p""",
)
def u08(t):
    pages = t("pages").select("page_id", "url")
    rule = F.explode(
        F.array(
            *[F.struct(F.lit(p).alias("path"), F.lit(a).alias("allow")) for p, a in (("/en", False), ("/en/2", True), ("/de/1", False), ("/", True))]
        )
    )
    hosts = pages.select(urls.host(F.col("url")).alias("host")).distinct().filter(F.length("host") % 2 == 0)
    robots = hosts.select("host", F.lit("*").alias("agent"), rule.alias("r")).select("host", "agent", "r.path", "r.allow")
    return linkgraph.robots_filter(pages, robots, "url").select("page_id", "url", "allowed")


@query(
    "u09_crawl_schedule",
    """with p as (select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as host from pages)
    select page_id, host, (row_number() over (partition by host order by page_id) - 1) * 0.5 as offset_s from p""",
)
def u09(t):
    return linkgraph.crawl_schedule(t("pages").select("page_id", "url"), "url", "page_id").select("page_id", "host", "offset_s")


# hits: every page is a hit for the company its host is named after, and for a stranger
_HITS = r"""select split_part(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^(www|m|blog)\.', ''), '.', 1) as name,
  page_id, url from pages"""


def _hits(t):
    site = F.regexp_replace(urls.host(F.col("url")), r"^(www|m|blog)\.", "")
    return t("pages").select(
        F.split_part(site, F.lit("."), F.lit(1)).alias("name"),
        F.col("url"),
        (F.col("page_id") % 3).alias("query_no"),
        F.col("page_id").alias("rank"),
        "html",
    )


@query(
    "u10_match_official_site",
    rf"""with hits as ({_HITS}), m as (select *, replace(replace(replace(lower(url), 'www.', ''), 'http://', ''), 'https://', '') as u,
      regexp_replace(name, '[ .\-]', '', 'g') as sq from hits),
    s as (select *, (contains(replace(u, '.', ''), sq) or split_part(u, '.', 1) = sq) as hit from m)
    select name, arg_min(url, (not hit, page_id % 3, page_id)) as website from s group by name""",
)
def u10(t):
    return linkgraph.match_official_site(_hits(t))


@query(
    "u11_match_profile_url",
    rf"""with hits as ({_HITS}), h as (select name, page_id, case when page_id % 7 = 0 then concat('https://www.linkedin.com/company/', name)
      else url end as url from hits)
    select name, arg_min(url, page_id) as profile from h where contains(url, 'linkedin.com/company/') group by name""",
)
def u11(t):
    url = F.when(F.col("rank") % 7 == 0, F.concat(F.lit("https://www.linkedin.com/company/"), "name")).otherwise(F.col("url"))
    return linkgraph.match_profile_url(_hits(t).withColumn("url", url))


@query(
    "u11_match_profile_in_page",
    rf"""with hits as ({_HITS}), h as (select name, page_id, case when page_id % 7 = 0 then concat('https://www.linkedin.com/company/', name)
      else url end as url from hits),
    p as (select url, concat('https://www.linkedin.com/company/', name, '-in') as inside from hits where page_id % 5 = 0),
    r as (select name, page_id, case when contains(url, 'linkedin.com/company/') then url end as direct, inside from h left join p using (url))
    select name, coalesce(arg_min(direct, page_id) filter (where direct is not null),
      arg_min(inside, page_id) filter (where inside is not null)) as profile from r group by name
    having count(direct) + count(inside) > 0""",
)
def u11_in_page(t):
    """Some hits are profiles, and some pages of the others link to one."""
    hits = _hits(t)
    url = F.when(F.col("rank") % 7 == 0, F.concat(F.lit("https://www.linkedin.com/company/"), "name")).otherwise(F.col("url"))
    link = F.concat(F.lit('<a href="https://www.linkedin.com/company/'), "name", F.lit('-in">profile</a>'))
    pages = hits.select("url", F.when(F.col("rank") % 5 == 0, F.concat("html", link)).otherwise(F.col("html")).alias("html"))
    return linkgraph.match_profile_url(hits.drop("html").withColumn("url", url), pages)


@query(
    "u12_domain_stats",
    """select lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as host, count(*) as results from pages group by 1
    order by results desc, host limit 5""",
)
def u12(t):
    return linkgraph.domain_stats(t("pages"), "url")


@query(
    "u12_pages_per_host",
    f"with {norm_cte()}, d as (select distinct url_norm, h from norm) select h as host, count(*) as pages from d group by 1",
)
def u12_pages(t):
    """Flagship: distinct pages per host after normalisation."""
    normal = t("pages").select(urls.host(F.col("url")).alias("host"), urls.normalize_url(F.col("url")).alias("u")).distinct()
    return normal.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "j12_site_rules",
    "select page_id, case when contains(lower(url), 'blog.') then 'blog' when contains(lower(url), '.org') then 'ngo' "
    "else 'generic' end as label from pages",
)
def j12(t):
    return t("pages").select("page_id", linkgraph.site_rules(F.col("url"), [("blog.", "blog"), (".org", "ngo")]).alias("label"))
