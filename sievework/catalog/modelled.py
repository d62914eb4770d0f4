"""M01-M09 and P01-P09 with the deterministic stand-in model."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sievework.catalog.base import query
from sievework.catalog.fields import F01_SQL, named
from sievework.catalog.sources import scratch
from sievework.operators import model as m
from sievework.operators import names
from sievework.plans import flows
from sievework.session import dealt


def _queries(t):
    """Distinct part names as search queries."""
    return t("part").groupBy(F.col("p_name").alias("query")).agg(F.min("p_partkey").alias("query_id"))


_ENDS = "['companies', 'vendors', 'startups']"


@query(
    "m01_expand_queries",
    f"""with q as (select p_name as query, min(p_partkey) as query_id from part group by 1), x as (select *, unnest([0, 1, 2, 3]) as pos from q)
    select query_id, pos, case when pos = 0 then query else concat(query, ' ', {_ENDS}[pos]) end as query from x""",
)
def m01(t):
    return m.expand_queries(_queries(t), "query_id", "query", 3, m.rule_model)


@query(
    "m02_extract_names",
    r"""with n as (select doc_id, unnest(l) as name, generate_subscripts(l, 1) as i from (select doc_id, regexp_extract_all(replace(text, chr(10), ' '), '(?:^|[^\p{L}\p{N}_])([A-Z][a-zà-ÿ]{6,})(?:$|[^\p{L}\p{N}_])', 1) as l from documents)),
    d as (select doc_id, name, min(i) as i from n group by 1, 2)
    select doc_id, name from d""",
)
def m02(t):
    out = m.extract_names(t("documents", True).select("doc_id", "text"), ["doc_id"], F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("metal coating"), m.rule_model)
    return out.select("doc_id", "name")


def _listed(t):
    """Three names per part."""
    return t("part").select("p_partkey", F.array("p_name", F.concat("p_name", F.lit(" "), "p_brand"), F.concat("p_type", F.lit(" works"))).alias("names"))


_NAMES = "(select p_partkey, unnest([p_name, concat(p_name, ' ', p_brand), concat(p_type, ' works')]) as name from part)"


@query("m03_validate_names", f"select p_partkey, concat('https://p.org/', p_partkey) as url, name from {_NAMES} where length(name) % 2 = 0")
def m03(t):
    rows = _listed(t).withColumn("url", F.concat(F.lit("https://p.org/"), F.col("p_partkey").cast("string")))
    return m.validate_names(rows, ["p_partkey"], "names", "url", m.rule_model).select("p_partkey", "url", "name")


@query("m04_filter_relevant", f"select p_partkey, name from {_NAMES} where length(name) % 3 = 0")
def m04(t):
    return m.filter_relevant(_listed(t), ["p_partkey"], "names", F.lit("DLC coating"), m.rule_model).select("p_partkey", "name")


@query("m05_choose_names")
def m05(t):
    rows = t("part").groupBy(F.concat("p_name", F.lit(" "), "p_brand").alias("name")).agg(F.min("p_partkey").alias("id"))
    groups = names.group_names(rows, "id", "name")
    return m.choose_names(groups, groups, m.rule_model)


@query(
    "m06_extract_structured",
    r"""with p as (select doc_id, unnest(generate_series(0, (length(text) - 1) // 15000)) as i, text from documents where text <> ''), d as (select doc_id, i, trim(substring(text, i * 15000 + 1, 15000), ' ' || chr(10)) as x from p),
    e as (select doc_id, i, left(split_part(x, '.', 1), 200) as d, regexp_extract(x, '\b(19|20)\d{2}\b') as y from d),
    s as (select doc_id, coalesce(arg_min(d, i) filter (trim(d) <> ''), '') as d, coalesce(arg_min(y, i) filter (y <> ''), '') as y from e group by 1)
    select doc_id, 'page' as source, 'Product Description' as field, d as value from s where trim(d) <> '' union all select doc_id, 'page', 'Founded Year', y from s where y <> ''""",
)
def m06(t):
    docs = t("documents", True).select("doc_id", F.lit("page").alias("source"), F.col("text").alias("content"))
    out = m.extract_structured(docs, "doc_id", "source", "content", ["Product Description", "Founded Year", "Location"], m.rule_model)
    return out.select("doc_id", "source", "field", "value")


@query(
    "m07_analyze",
    r"""with d as (select doc_id, regexp_extract(text, '\b(?:19|20)\d{2}\b') as y from documents)
    select doc_id, case when y <> '' then concat('{"Founded Year":"', y, '"}') else '{"Founded Year":null}' end as data, 0.9 as confidence from d""",
)
def m07(t):
    return m.analyze(t("documents", True).select("doc_id", "text"), "doc_id", F.col("text"), ["Founded Year"], m.rule_model)


def _correcting(prompts: list[str]) -> list[str]:
    """A stand-in that changes every record and adds one to batches whose first name ends in 1."""
    answers = []
    for prompt in prompts:
        records = json.loads(prompt.split("RECORDS: ", 1)[1])
        first = records[0]["name"]
        more = [{"name": f"beside {first}"}] if first.endswith("1") else []
        answers.append(json.dumps([{"name": r["name"].upper()} for r in records] + more))
    return answers


@query(
    "m08_validate_companies",
    """with c as (select c_custkey, c_name, row_number() over (order by c_custkey) - 1 as n from customer)
    select c_custkey, concat('{"name":"', upper(c_name), '"}') as record from c
    union all select null, concat('{"name":"beside ', c_name, '"}') from c where n % 5 = 0 and c_name like '%1'""",
)
def m08(t):
    rows = t("customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"))).alias("record"))
    return m.validate_companies(rows, "c_custkey", "record", "coatings", _correcting)


def _first_words(prompts: list[str]) -> list[str]:
    """A stand-in that merges names: each becomes its first word."""
    return [json.dumps([n.split(" ")[0] for n in json.loads(p.split("NAMES: ", 1)[1])]) for p in prompts]


@query("m09_llm_dedupe", "select distinct split_part(p_name, ' ', 1) as p_name from part")
def m09(t):
    return m.llm_dedupe(t("part").select("p_partkey", "p_name"), "p_partkey", "p_name", _first_words)


#: Hits per query: all of them.
EVERY = 1_000_000_000


def _page_hits(t):
    """Every page is a hit of one of the part-name queries, and every query has its share of them."""
    queries = _queries(t)
    many = max(1, queries.count())
    pages = t("pages").select(
        "page_id", "url", (F.col("page_id") % many).alias("query_no"), F.col("page_id").cast("int").alias("rank"),
        F.lit("A page").alias("title"), F.lit("Based in Oslo. Founded in 1999.").alias("snippet"),
    )
    from sievework.operators.positions import with_position

    numbered = with_position(queries, "query_id", out="n").select("query_id", (F.col("n") - 1).alias("query_no"))
    return queries, pages.join(numbered, "query_no").drop("query_no", "page_id")


@query("p01_discover")
def p01(t):
    queries, hits = _page_hits(t)
    found = flows.discover(queries, hits, t("pages").select("url", "html"), m.rule_model, EVERY, EVERY)
    return found.companies


def _company_hits(t):
    site = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), r"^(www|m|blog)\.", "")
    return t("pages").select(
        F.split_part(site, F.lit("."), F.lit(1)).alias("name"), (F.col("page_id") % 3).cast("int").alias("query_no"),
        F.col("page_id").cast("int").alias("rank"), F.lit("A page").alias("title"), "url", F.concat(F.lit("Snippet "), F.col("page_id").cast("string")).alias("snippet"),
    )


@query("p02_enrich")
def p02(t):
    hits = _company_hits(t)
    return flows.enrich(hits.select("name").distinct(), hits, t("pages").select("url", "html"))


_EVERY = {
    "website": ("c_custkey % 2 = 0", "concat('<p>Located in City', c_custkey % 97, '.</p>')", "concat('https://firm', c_custkey, '.com/about')"),
    "linkedin": ("c_custkey % 3 = 0", "concat('<section>Founded in ', 1900 + c_custkey % 100, '.</section>')", "concat('https://www.linkedin.com/company/firm', c_custkey)"),
    "crunchbase": ("c_custkey % 5 = 0", "concat('<p>Industry: Trade', c_custkey % 13, '.</p>')", "concat('https://www.crunchbase.com/organization/firm', c_custkey)"),
    "news": ("c_custkey % 11 = 0", "concat('<p>It raised a ', c_custkey % 9, ' million round.</p>')", "concat('https://news.example.org/firm', c_custkey)"),
    "wiki": ("true", "concat('<p>The year ', 1950 + c_custkey % 50, ' was good</p>')", "concat('https://wiki.example.org/firm', c_custkey)"),
}


@query(
    "p02_enrich_gaps",
    """select concat('Firm', c_custkey) as name, concat('https://firm', c_custkey, '.com/about') as website, concat('https://www.linkedin.com/company/firm', c_custkey) as linkedin,
    case when c_custkey % 2 = 0 then concat('City', c_custkey % 97) when c_custkey % 7 = 0 then concat('Town', c_custkey % 89) end as location,
    cast(case when c_custkey % 3 = 0 then 1900 + c_custkey % 100 else 1950 + c_custkey % 50 end as varchar) as founded_year,
    case when c_custkey % 5 = 0 then concat('Trade', c_custkey % 13) end as industry, case when c_custkey % 11 = 0 then concat(c_custkey % 9, ' million') end as funding,
    case when c_custkey % 7 = 0 then concat('Makes goods. Headquartered in Town', c_custkey % 89, '.') else 'Makes goods.' end as product_description from customer""",
)
def p02_gaps(t):
    """Pages made by rule for every customer, so that each source fills something for some of them."""
    rows = dealt(t("customer").select("c_custkey"), "c_custkey").select("c_custkey", F.concat(F.lit("Firm"), "c_custkey").alias("name"))
    snippet = F.expr("case when c_custkey % 7 = 0 then concat('Makes goods. Headquartered in Town', c_custkey % 89, '.') else 'Makes goods.' end")
    hits, pages = None, None
    for rank, (has, body, url) in enumerate(_EVERY.values(), 1):
        hit = rows.select("name", F.lit(0).alias("query_no"), F.lit(rank).alias("rank"), F.lit("Hit").alias("title"), F.expr(url).alias("url"), (snippet if rank == 1 else F.lit("")).alias("snippet"))
        html = F.expr(f"concat('<html><head><title>Firm</title></head><body><p>A page.</p>', case when {has} then {body} else '' end, '</body></html>')")
        page = rows.select(F.expr(url).alias("url"), html.alias("html"))
        hits, pages = (hit, page) if hits is None else (hits.unionByName(hit), pages.unionByName(page))
    return flows.enrich_gaps(rows.select("name"), hits, pages, m.rule_model)


@query("p03_validate", """select c_custkey, case when c_custkey % 2 = 0 then 'done' else concat('{"name":"', c_name, '"}') end as record from customer""")
def p03(t):
    rows = t("customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.to_json(F.struct(F.col("c_name").alias("name"))).alias("record"))
    done = rows.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("done").alias("record"))
    return flows.validate(rows, "c_custkey", "record", "coatings", m.rule_model, done)


def _hits_of(t):
    def find(companies):
        """About three pages for every company, by hash of its name; all pages are named by some slot."""
        many = max(1, t("pages").count() // 3)
        slots = t("pages").select("url", (F.col("page_id") % many).alias("slot"), F.col("page_id").cast("int").alias("rank"))
        mine = companies.select("name", F.pmod(F.xxhash64("name"), F.lit(many)).alias("slot")).distinct()
        return mine.join(slots, "slot").select(
            "name", F.lit(0).alias("query_no"), "rank", F.lit("A page").alias("title"), "url", F.lit("Based in Oslo.").alias("snippet")
        )

    return find


@query("p04_find_and_enrich")
def p04(t):
    queries, hits = _page_hits(t)
    spark = queries.sparkSession
    out = flows.find_and_enrich(spark, queries, hits, t("pages").select("url", "html"), _hits_of(t), m.rule_model, scratch(spark, "both"), "20240101_000000", EVERY, EVERY)
    return out["export"].select(*[F.col(f"`{c}`").alias(c.lower().replace("/", "_").replace(" ", "_")) for c in out["export"].columns])


@query("p05_two_phase_search")
def p05(t):
    queries, hits = _page_hits(t)
    return flows.two_phase_search(queries, hits, t("pages").select("url", "html"), _hits_of(t), m.rule_model, 50, EVERY, EVERY)


@query("p06_clean_and_chunk")
def p06(t):
    out = flows.clean_and_chunk(t("pages").withColumn("grp", F.lit("all")), "grp", "page_id", 2000, keep_breaks=True)
    return out.select("grp", F.coalesce("part", F.lit(-1)).alias("part"), "chunk_index", "total_chunks", "chunk")


@query("p07_dedupe_file", "with n as (select min(p_partkey) as pos, p_name from part group by p_name) select pos from n")
def p07(t):
    rows = t("part").select(F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" LLC")).alias("Company Name"))
    spark = rows.sparkSession
    old, new = scratch(spark, "file"), scratch(spark, "file-deduped")
    rows.write.parquet(old)
    flows.dedupe_file(spark, old, new, fuzzy=False)
    return spark.read.parquet(new).select("pos")


@query("p07_dedupe_file_fuzzy")
def p07_fuzzy(t):
    """The fuzzy form over part names with their brand."""
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" LLC"))
    rows = t("part").groupBy(name.alias("Company Name")).agg(F.min("p_partkey").alias("pos"))
    spark = rows.sparkSession
    old, new = scratch(spark, "file"), scratch(spark, "file-deduped")
    rows.write.parquet(old)
    flows.dedupe_file(spark, old, new)
    return spark.read.parquet(new).select("pos")


@query("p08_search_and_extract")
def p08(t):
    _, hits = _page_hits(t)
    return flows.search_and_extract(hits, t("pages").select("url", "html"), EVERY).fillna("")


_RANKED = f"""(select c_custkey, {F01_SQL} as company_name, 'Not available' as founded_year, c_mktsegment as location, 'Not available' as website from customer)"""


@query(
    "p09_rank_and_export",
    f"""with c as (select *, 0.6 * len(list_intersect(['customer', 'building', 'machinery'], list_distinct(regexp_extract_all(lower(concat_ws(' ', company_name, founded_year, location, website)), '[a-z0-9_]+')))) / 3.0 + 0.4 * 4 / 8.0 as s
      from {_RANKED}) select c_custkey, company_name, founded_year, location, website, round(s, 6) as confidence from c where s >= 0.2""",
)
def p09(t):
    rows = named(t).select("c_custkey", F.col("name").alias("company_name"), F.concat(F.lit("Based in "), "c_mktsegment").alias("location"))
    out = flows.rank_and_export(rows, "customer building machinery", ["Company Name", "Founded Year", "Location", "Website"], "c_custkey", 0.2)
    return out.withColumn("confidence", F.round("confidence", 6))
