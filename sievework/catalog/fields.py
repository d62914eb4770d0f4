"""Field rules and relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework import rules
from sievework.catalog.base import WORD, query, sql_list
from sievework.functions import fields as fld
from sievework.operators import relevance

SUFFIXES = ["Inc", "Co Inc", "Inc Co", "LLC.", "gmbh", "S.A.", "Holding", "B.V.", "Ltd", "'Corp'", "P.L.C.", "Company AG", "Limited"]
NAMED = f"concat(replace(c_name, '#', ' '), ' ', {sql_list(SUFFIXES)}[cast(c_custkey % 13 as int) + 1])"


def named(t):
    """Customers under names with legal suffixes."""
    ends = F.array(*[F.lit(s) for s in SUFFIXES])
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" "), F.element_at(ends, (F.col("c_custkey") % 13 + 1).cast("int")))
    return t("customer").withColumn("name", name)


def _chain(expression: str, patterns: list[str]) -> str:
    for p in patterns:
        expression = f"regexp_replace({expression}, '(?i){p}', '')"
    return expression


F01_SQL = "trim(" + _chain(
    f"rtrim(trim({NAMED}), '.')", [rf"\s+{s.replace('.', chr(92) + '.')}\.?$" for s in rules.NAME_SUFFIXES]
) + ")"
F02_SQL = (
    "trim(regexp_replace(regexp_replace("
    + _chain(NAMED, rules.PLAIN_NAME_SUFFIX_PATTERNS)
    + r""", '[''"`]', '', 'g'), '\s+', ' ', 'g'))"""
)


@query("f01_company_name", f"select c_custkey, {F01_SQL} as name from customer")
def f01(t):
    return named(t).select("c_custkey", fld.company_name(F.col("name")).alias("name"))


@query("f02_basic_clean_name", f"select c_custkey, {F02_SQL} as name from customer")
def f02(t):
    return named(t).select("c_custkey", fld.basic_clean_name(F.col("name")).alias("name"))


YEAR_TEXT = "concat('Est. ', cast(1880 + o_orderkey % 200 as varchar), ' or ', cast(o_orderkey as varchar))"


@query(
    "f03_founded_year",
    rf"""with y as (select o_orderkey, regexp_extract({YEAR_TEXT}, '\b(19|20)\d{{2}}\b') as y from orders)
    select o_orderkey, case when try_cast(y as int) between 1900 and 2025 then y else '' end as year from y""",
)
def f03(t):
    text = F.concat(F.lit("Est. "), (1880 + F.col("o_orderkey") % 200).cast("string"), F.lit(" or "), F.col("o_orderkey").cast("string"))
    year = F.coalesce(fld.founded_year(text, 2025).cast("string"), F.lit(""))
    return t("orders").select("o_orderkey", year.alias("year"))


def _prefix_sql(prefixes: list[str], text: str) -> str:
    out = f"trim({text})"
    for p in prefixes:
        out = f"trim(regexp_replace({out}, '^(?i:{p})', ''))"
    return f"rtrim({out}, '.,')"


def _prefixed(prefixes: list[str], key, value):
    heads = F.array(*[F.lit(p) for p in [*prefixes, ""]])
    return F.concat(F.upper(F.element_at(heads, (key % (len(prefixes) + 1) + 1).cast("int"))), F.lit(" "), value)


def _prefixed_sql(prefixes: list[str], key: str, value: str) -> str:
    return f"concat(upper({sql_list([*prefixes, ''])}[cast({key} % {len(prefixes) + 1} as int) + 1]), ' ', {value})"


@query(
    "f04_location",
    "select c_custkey, "
    + _prefix_sql(rules.LOCATION_PREFIXES, _prefixed_sql(rules.LOCATION_PREFIXES, "c_custkey", "concat(c_mktsegment, ' City.,')"))
    + " as location from customer",
)
def f04(t):
    raw = _prefixed(rules.LOCATION_PREFIXES, F.col("c_custkey"), F.concat("c_mktsegment", F.lit(" City.,")))
    return t("customer").select("c_custkey", fld.location(raw).alias("location"))


@query(
    "f05_website",
    f"""with w as (select c_custkey, lower(trim(case c_custkey % 5 when 0 then concat(' ', c_mktsegment, '.com ') when 1 then concat('HTTP://', c_mktsegment, '.co.uk/a b')
      when 2 then concat('https://', c_mktsegment, '.com:8080') when 3 then concat(c_mktsegment, '.org?x=1') else c_mktsegment end)) as w from customer),
    u as (select c_custkey, case when w like 'http://%' or w like 'https://%' then w else concat('https://', w) end as u from w)
    select c_custkey, case when regexp_matches(u, '{rules.WEBSITE_PATTERN}') then u else '' end as website from u""",
)
def f05(t):
    seg = F.col("c_mktsegment")
    raw = (
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" "), seg, F.lit(".com ")))
        .when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("HTTP://"), seg, F.lit(".co.uk/a b")))
        .when(F.col("c_custkey") % 5 == 2, F.concat(F.lit("https://"), seg, F.lit(".com:8080")))
        .when(F.col("c_custkey") % 5 == 3, F.concat(seg, F.lit(".org?x=1")))
        .otherwise(seg)
    )
    return t("customer").select("c_custkey", F.coalesce(fld.website(raw), F.lit("")).alias("website"))


PEOPLE = "concat(c_name, ' and  ', c_mktsegment, ' & Sons|Max / Co.,')"


def _commas_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+and\s+', ', ', 'g'), '\s*[&|/]\s*', ', ', 'g')"


@query(
    "f06_founders",
    "select c_custkey, "
    + _commas_sql(_prefix_sql(rules.FOUNDER_PREFIXES, _prefixed_sql(rules.FOUNDER_PREFIXES, "c_custkey", PEOPLE)))
    + " as founders from customer",
)
def f06(t):
    raw = _prefixed(rules.FOUNDER_PREFIXES, F.col("c_custkey"), F.expr(PEOPLE))
    return t("customer").select("c_custkey", fld.founders(raw).alias("founders"))


MONEY = "concat('$', cast(c_custkey as varchar), 'M Series A.')"


@query(
    "f07_funding",
    "select c_custkey, "
    + _prefix_sql(rules.FUNDING_PREFIXES, _prefixed_sql(rules.FUNDING_PREFIXES, "c_custkey", MONEY))
    + " as funding from customer",
)
def f07(t):
    raw = _prefixed(rules.FUNDING_PREFIXES, F.col("c_custkey"), F.expr(MONEY.replace("varchar", "string")))
    return t("customer").select("c_custkey", fld.funding(raw).alias("funding"))


@query(
    "f08_tech_stack",
    "select p_partkey, "
    + _commas_sql(_prefix_sql(rules.TECH_PREFIXES, _prefixed_sql(rules.TECH_PREFIXES, "p_partkey", "concat(p_name, ' and ', p_type, '/', p_brand)")))
    + " as tech from part",
)
def f08(t):
    raw = _prefixed(rules.TECH_PREFIXES, F.col("p_partkey"), F.expr("concat(p_name, ' and ', p_type, '/', p_brand)"))
    return t("part").select("p_partkey", fld.tech_stack(raw).alias("tech"))


@query(
    "f09_description",
    r"""with d as (select doc_id, regexp_replace(trim(lower(text)), '\s+', ' ', 'g') as x from documents)
    select doc_id, concat(upper(left(x, 1)), substring(x, 2)) as description from d""",
)
def f09(t):
    return t("documents").select("doc_id", fld.description(F.lower("text")).alias("description"))


SIZE_TEXT = (
    "case p_partkey % 6 when 0 then concat(p_size, '-', p_size + 40, ' people') when 1 then concat('about ', p_size) "
    "when 2 then 'a Small team' when 3 then 'LARGE' when 4 then 'enterprise, medium' else p_type end"
)


@query(
    "f10_team_size",
    rf"""with s as (select p_partkey, {SIZE_TEXT} as x from part), n as (select *, regexp_extract(x, '\b\d+(-\d+)?\b') as n, lower(x) as l from s)
    select p_partkey, case when n <> '' then n when contains(l, 'small') then '1-10' when contains(l, 'medium') then '11-50'
      when contains(l, 'large') then '51-200' when contains(l, 'enterprise') then '201+' else '' end as team_size from n""",
)
def f10(t):
    return t("part").select("p_partkey", F.coalesce(fld.team_size(F.expr(SIZE_TEXT)), F.lit("")).alias("team_size"))


SOCIAL = (
    "concat('see https://twitter.com/', s_suppkey, ' https://x.com/b', s_suppkey, ' and https://www.netflix.com/', s_suppkey % 3, "
    "case when s_suppkey % 2 = 0 then concat(' https://github.com/', s_name) else concat(' http://site.org/', s_name) end)"
)


@query(
    "f11_social_media",
    rf"""with u as (select s_suppkey, regexp_extract_all({SOCIAL}, 'https?://\S+') as l from supplier),
    x as (select s_suppkey, unnest(l) as url, generate_subscripts(l, 1) as i from u),
    p as (select *, case when contains(url, 'twitter.com') or contains(url, 'x.com') then 'Twitter' when contains(url, 'linkedin.com') then 'LinkedIn'
      when contains(url, 'facebook.com') then 'Facebook' when contains(url, 'instagram.com') then 'Instagram'
      when contains(url, 'github.com') then 'GitHub' when contains(url, 'youtube.com') then 'YouTube' else 'Other' end as platform from x)
    select s_suppkey, platform, arg_max(url, i) as url from p group by 1, 2""",
)
def f11(t):
    return t("supplier").select("s_suppkey", F.explode(fld.social_media(F.expr(SOCIAL))).alias("platform", "url"))


RIVALS = "concat('Competitors: ', s_name, ' Inc, Beta', s_suppkey, ' LLC and Gamma GmbH | Delta / , Sandy Co')"


def _f01_of(x: str) -> str:
    return "trim(" + _chain(
        f"rtrim(trim({x}), '.')", [rf"\s+{s.replace('.', chr(92) + '.')}\.?$" for s in rules.NAME_SUFFIXES]
    ) + ")"


@query(
    "f12_competitors",
    rf"""with c as (select s_suppkey, trim(regexp_replace({RIVALS}, '^(?i:Competitors:)', '')) as x from supplier),
    p as (select s_suppkey, unnest(l) as x, generate_subscripts(l, 1) as i from (select s_suppkey, regexp_split_to_array(x, ',|\band\b|[&|/]') as l from c)),
    n as (select s_suppkey, i, {_f01_of('x')} as name from p)
    select s_suppkey, cast(row_number() over (partition by s_suppkey order by i) - 1 as int) as pos, name from n where name <> ''""",
)
def f12(t):
    return t("supplier").select("s_suppkey", F.posexplode(fld.competitors(F.expr(RIVALS))).alias("pos", "name"))


@query(
    "f13_standardize_companies",
    f"""with y as (select *, regexp_extract(concat('since ', cast(1890 + c_custkey % 150 as varchar)), '\\b(19|20)\\d{{2}}\\b') as y from customer)
    select c_custkey, {F01_SQL} as company_name, case when try_cast(y as int) between 1900 and 2025 then y else 'Not available' end as founded_year,
      rtrim(trim(concat(c_mktsegment, ' City.')), '.,') as location, 'Not available' as website from y""",
)
def f13(t):
    raw = named(t).select(
        "c_custkey",
        F.col("name").alias("company_name"),
        F.concat(F.lit("since "), (1890 + F.col("c_custkey") % 150).cast("string")).alias("Founded Year"),
        F.concat(F.lit("Based in "), "c_mktsegment", F.lit(" City.")).alias("location"),
    )
    return fld.standardize_companies(raw, current_year=2025, keep=("c_custkey",))


LINE = "case p_partkey % 4 when 0 then concat(p_partkey, '. ', p_name) when 1 then concat('- ', p_name) when 2 then concat('* ', p_name) else p_name end"


@query("f14_strip_query_markers", rf"select p_partkey, trim(regexp_replace(trim({LINE}), '^(\d+\. |- |\* )', '')) as line from part")
def f14(t):
    return t("part").select("p_partkey", fld.strip_query_marker(F.expr(LINE)).alias("line"))


def answer_rows(t):
    """Events as model answers; the event type picks the field."""
    field = (
        F.when(F.col("event_type") == "signup", "Location")
        .when(F.col("event_type") == "error", "Founded Year")
        .when(F.col("event_type") == "click", "Funding")
        .when(F.col("event_type") == "view", "Team")
        .otherwise("Tags")
    )
    data = F.concat(F.lit('{"'), field, F.lit('": '), "props", F.lit(', "Website": null, "Industry": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return t("events").select("event_id", data.alias("data"))


_ANSWER_SQL = """a as (select event_id, case event_type when 'signup' then 'Location' when 'error' then 'Founded Year' when 'click' then 'Funding'
  when 'view' then 'Team' else 'Tags' end as f, replace(props, ': ', ':') as p, json_extract_string(props, '$.k') as k from events)"""


@query(
    "f15_coerce_fields",
    f"""with {_ANSWER_SQL} select event_id, f as field, case when f in ('Location', 'Founded Year') then 'str' else 'dict' end as kind, p as value,
      case when f in ('Location', 'Founded Year') then concat('Field ''', f, ''' has unexpected type: dict') else '' end as warning from a
    union all select event_id, 'Industry', 'str', k, 'Field ''Industry'' has unexpected type: int' from a""",
)
def f15(t):
    rows = fld.coerce_fields(answer_rows(t), "event_id", "data")
    return rows.withColumn("warning", F.coalesce("warning", F.lit("")))


@query(
    "f16_drop_empty_fields",
    """with f as (select c_custkey, unnest([('segment', c_mktsegment), ('note', case c_custkey % 4 when 0 then 'null' when 1 then 'Not available'
      when 2 then '' else c_name end), ('size', case when c_custkey % 3 = 0 then null else 'x' end)]) as kv from customer)
    select c_custkey, kv[1] as field, kv[2] as value from f where kv[2] is not null and kv[2] not in ('null', 'Not available', '')""",
)
def f16(t):
    key = F.col("c_custkey")
    note = F.when(key % 4 == 0, "null").when(key % 4 == 1, "Not available").when(key % 4 == 2, "").otherwise(F.col("c_name"))
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("note"), note, F.lit("size"), F.when(key % 3 != 0, "x"))
    return t("customer").select("c_custkey", F.explode(fld.drop_empty_fields(m)).alias("field", "value"))


_ASKED = ["Website", " founders", "TEAM SIZE", "fund", "Colour", "location", "name"]


@query(
    "f17_validate_fields",
    f"""with c as (select unnest({sql_list(rules.FIELD_CATALOGUE)}) as f), r as (select c_custkey, trim({sql_list(_ASKED)}[cast(c_custkey % 7 as int) + 1]) as w from customer),
    b as (select c_custkey, w, (select max(f) from c where lower(f) = lower(w)) as e,
      (select string_agg(f, ', ' order by list_position({sql_list(rules.FIELD_CATALOGUE)}, f)) from c where contains(lower(f), lower(w))) as near from r)
    select distinct c_custkey, coalesce(e, w) as field, e is not null as valid, case when e is not null then '' else coalesce(near, '') end as suggestions from b
    union select c_custkey, unnest({sql_list(rules.BASIC_FIELDS)}), true, '' from customer""",
)
def f17(t):
    asked = F.array(*[F.lit(a) for a in _ASKED])
    req = t("customer").select("c_custkey", F.element_at(asked, (F.col("c_custkey") % 7 + 1).cast("int")).alias("field"))
    return fld.validate_fields(req, "c_custkey", "field")


@query(
    "f18_validate_settings",
    """with s as (select p_partkey, trim(left(p_name, cast(p_partkey % 9 as int))) as query, case when p_partkey % 5 = 0 then null else p_partkey % 5 - 1 end as mr,
      case when p_partkey % 3 = 0 then null else p_size / 40.0 end as mc, case p_partkey % 4 when 0 then null when 1 then 'CSV' when 2 then 'json' else 'xml' end as fmt from part),
    d as (select p_partkey, query, coalesce(mr, 50) as max_results, coalesce(mc, 0.8) as min_confidence, coalesce(lower(fmt), 'csv') as output_format from s)
    select p_partkey, query, max_results, output_format, concat_ws('; ', case when query = '' then 'query is empty' when length(query) < 3 then 'query is shorter than 3 characters' end,
      case when max_results < 1 then 'max_results is below 1' end, case when not min_confidence between 0 and 1 then 'min_confidence is outside 0..1' end,
      case when output_format not in ('csv', 'json') then 'output_format is not csv or json' end) as problems from d""",
)
def f18(t):
    key = F.col("p_partkey")
    raw = t("part").select(
        "p_partkey",
        F.left("p_name", (key % 9).cast("int")).alias("query"),
        F.when(key % 5 != 0, (key % 5 - 1).cast("int")).alias("max_results"),
        F.when(key % 3 != 0, F.col("p_size") / 40.0).alias("min_confidence"),
        F.when(key % 4 == 1, "CSV").when(key % 4 == 2, "json").when(key % 4 == 3, "xml").alias("output_format"),
    )
    return fld.validate_settings(raw).select("p_partkey", "query", "max_results", "output_format", "problems")


# ------------------------------------------------------------------ relevance

QUERY = "that with thea onth leaux queau the of"
_TERMS = [w for w in QUERY.split() if w not in rules.TERM_STOPWORDS]
_WORDS = [w for w in QUERY.split() if len(w) > 3]
R01_SQL = rf"len(list_intersect({sql_list(_TERMS)}, list_distinct(regexp_extract_all(lower(text), '[{WORD}]+')))) / {float(len(_TERMS))}"


@query("r01_content_relevance", f"select doc_id, round({R01_SQL}, 6) as relevance from documents")
def r01(t):
    rel = relevance.content_relevance([F.col("text")], F.lit(QUERY))
    return t("documents", True).select("doc_id", F.round(rel, 6).alias("relevance"))


_PART = {"Company Name": "name", "Location": "place", "Website": "site", "Technology Stack": "tech"}


def _records(t):
    key = F.col("p_partkey")
    return t("part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.when(key % 3 != 0, F.col("p_brand")).alias("place"),
        F.when(key % 4 == 0, "Unknown").when(key % 4 == 1, "").otherwise(F.col("p_type")).alias("site"),
        F.col("p_type").alias("tech"),
    )


_RECORDS = """(select p_partkey, p_name as name, case when p_partkey % 3 <> 0 then p_brand end as place,
  case p_partkey % 4 when 0 then 'Unknown' when 1 then '' else p_type end as site, p_type as tech from part)"""
R02_SQL = "(1 + (case when place is not null then 1 else 0 end) + (case when site not in ('', 'Unknown') then 1 else 0 end) + 1) / 8.0"


@query("r02_information_quality", f"select p_partkey, {R02_SQL} as quality from {_RECORDS}")
def r02(t):
    return _records(t).select("p_partkey", relevance.information_quality(_PART).alias("quality"))


_PQ = "small red widget of economy steel"
_PT = [w for w in _PQ.split() if w not in rules.TERM_STOPWORDS]
R03_SQL = (
    f"0.6 * len(list_intersect({sql_list(_PT)}, list_distinct(regexp_extract_all(lower(concat_ws(' ', name, place, site, tech)), '[{WORD}]+'))))"
    f" / {float(len(_PT))} + 0.4 * {R02_SQL}"
)


@query("r03_score", f"select p_partkey, round({R03_SQL}, 6) as score from {_RECORDS}")
def r03(t):
    rel = relevance.content_relevance([F.col(c) for c in _PART.values()], F.lit(_PQ))
    return _records(t).select("p_partkey", F.round(relevance.score(rel, relevance.information_quality(_PART)), 6).alias("score"))


@query(
    "r04_rank",
    f"with s as (select p_partkey, name, {R03_SQL} as c from {_RECORDS}) select p_partkey, name, round(c, 6) as confidence from s where c >= 0.3 order by c desc, p_partkey",
)
def r04(t):
    ranked = relevance.rank(_records(t), _PQ, _PART, "p_partkey", 0.3)
    return ranked.select("p_partkey", "name", F.round("confidence", 6).alias("confidence"))


_HITS_SQL = " + ".join(f"cast(contains(lower(x), '{w}') as int)" for w in _WORDS)


@query(
    "r05_is_relevant",
    f"select doc_id from (select doc_id, text as x from documents) where trim(x) <> '' and ({_HITS_SQL}) / {float(len(_WORDS))} >= 0.4",
)
def r05(t):
    return t("documents", True).filter(relevance.is_relevant(F.col("text"), QUERY, 0.4)).select("doc_id")


@query(
    "r06_top_paragraphs",
    f"""with p as (select doc_id, list_filter([trim(y) for y in string_split(text, chr(10))], lambda z: z <> '') as l from documents),
    r as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) - 1 as pos from p),
    s as (select doc_id, pos, x as paragraph, ({_HITS_SQL}) / (length(x) / 100.0) as score from r)
    select doc_id, pos, paragraph, round(score, 6) as score, rn from (select *, row_number() over (partition by doc_id order by score desc, pos) as rn from s)
    where rn <= 3""",
)
def r06(t):
    top = relevance.top_paragraphs(t("documents", True), "doc_id", "text", QUERY, 3, "\n")
    return top.withColumn("score", F.round("score", 6))


