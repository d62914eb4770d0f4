"""Rule-based extraction and answer parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework import rules
from sievework.catalog.base import like_any, query, sql_in, sql_list
from sievework.functions import parsing
from sievework.functions.text import strip
from sievework.operators import extract

ORG_TEXT = r"regexp_replace(text, '\. ', ' Inc. ', 'g')"
_ORGS = (
    "list_sort(list_distinct(list_concat("
    + ", ".join(f"regexp_extract_all({ORG_TEXT}, '{p}', 1)" for p in rules.ORG_PATTERNS)
    + ")))"
)


def _org_text():
    return F.regexp_replace("text", r"\. ", " Inc. ")


@query("e01_extract_orgs", f"select doc_id, array_to_string({_ORGS}, '|') as orgs from documents")
def e01(t):
    return t("documents", True).select("doc_id", F.array_join(extract.extract_orgs(_org_text()), "|").alias("orgs"))


_FIRST = ["Google", "Ai", "Apple", "Acme", "Beta Works", "Twitter", "Ox"]


@query(
    "e02_filter_common_orgs",
    f"""with o as (select c_custkey, {sql_list(_FIRST)}[cast(c_custkey % 7 as int) + 1] as o from customer)
    select c_custkey, o as org from o where o not in {sql_in(rules.COMMON_ORGS)} and length(o) > 2""",
)
def e02(t):
    org = F.element_at(F.array(*[F.lit(o) for o in _FIRST]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return t("customer").select("c_custkey", F.explode(extract.filter_common_orgs(F.array(org))).alias("org"))


_FACT_TEXT = """concat(case c_custkey % 3 when 0 then concat('Based in ', c_mktsegment, ' Town. ') when 1 then concat('HQ: ', c_mktsegment, ', CA. ') else 'Nowhere. ' end,
  case c_custkey % 4 when 0 then concat('FOUNDED in ', 1950 + c_custkey % 70, '. ') when 1 then concat('Since ', 1960 + c_custkey % 60, '. ') else '' end,
  case c_custkey % 5 when 0 then 'Sector: metal, wood. ' when 1 then 'It operates in the paper industry. ' else '' end,
  case c_custkey % 2 when 0 then concat('It raised a $', c_custkey, 'M seed round. ') else concat('Funding of $', c_custkey, 'K. ') end,
  'Founders: A', c_custkey, ' and B.')"""


def _facts_sql(rule_set: str) -> str:
    out = []
    for field in dict.fromkeys(f for f, _ in rules.FACT_RULES[rule_set]):
        tries = [f"nullif(trim(regexp_extract(x, '{p}', 1)), '')" for f, p in rules.FACT_RULES[rule_set] if f == field]
        out.append(f"coalesce({', '.join(tries)}, '') as {rules.snake(field)}")
    return f"select c_custkey, {', '.join(out)} from (select c_custkey, {_FACT_TEXT} as x from customer)"


def _facts(t, rule_set):
    df = t("customer").select("c_custkey", F.expr(_FACT_TEXT).alias("x"))
    return extract.extract_facts(df, "x", rule_set, ["c_custkey"]).fillna("")


@query("e03_extract_facts_site", _facts_sql("site"))
def e03(t):
    return _facts(t, "site")


@query("e04_extract_facts_page", _facts_sql("page"))
def e04(t):
    return _facts(t, "page")


@query("e05_extract_facts_search", _facts_sql("search"))
def e05(t):
    return _facts(t, "search")


_UI = sql_list([*rules.UI_WORDS[:9], "Read More now", "Acme", "Xy"])


@query(
    "e06_is_likely_name",
    f"""with n as (select p_partkey, case p_partkey % 3 when 0 then {_UI}[cast(p_partkey % 12 as int) + 1] else concat(upper(left(p_name, 1)), substring(p_name, 2)) end as name from part)
    select p_partkey, name from n where lower(name) not in {sql_in(rules.UI_WORDS)} and length(name) > 2 and not {like_any('lower(name)', rules.UI_PHRASES)}""",
)
def e06(t):
    ui = F.array(*[F.lit(w) for w in [*rules.UI_WORDS[:9], "Read More now", "Acme", "Xy"]])
    name = F.when(F.col("p_partkey") % 3 == 0, F.element_at(ui, (F.col("p_partkey") % 12 + 1).cast("int"))).otherwise(
        F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 100))
    )
    return t("part").select("p_partkey", name.alias("name")).filter(extract.is_likely_name(F.col("name")))


@query(
    "e07_best_org_match",
    f"""with o as (select doc_id, split_part(text, ' ', 1) as name, {_ORGS} as orgs from documents),
    x as (select doc_id, name, unnest(orgs) as org, generate_subscripts(orgs, 1) as i from o),
    s as (select *, case when lower(org) = lower(name) then 2.0 when contains(lower(org), lower(name)) or contains(lower(name), lower(org)) then
      len(list_intersect(list_distinct(string_split(lower(org), '')), list_distinct(string_split(lower(name), ''))))
      / len(list_distinct(list_concat(string_split(lower(org), ''), string_split(lower(name), '')))) else 0.0 end as score from x)
    select o.doc_id, o.name, coalesce((select arg_max(org, (score, -i)) from s where s.doc_id = o.doc_id and score > 0.5), '') as best_org from o""",
)
def e07(t):
    df = t("documents", True).select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("name"), extract.extract_orgs(_org_text()).alias("orgs"))
    return extract.best_org_match(df, "doc_id", "name", "orgs").fillna("")


# a mention of a document is its 30th word
_MENTION = "split_part(text, ' ', 30)"


def _mentions(t):
    docs = t("documents", True).withColumn("name", strip(F.split_part("text", F.lit(" "), F.lit(30)))).filter("length(name) > 2 and not contains(name, '\\n')")
    return docs.select("name", F.col("doc_id").alias("url"))


@query(
    "e08_mention_context",
    rf"""with m as (select doc_id, text, trim({_MENTION}) as name from documents),
    a as (select *, instr(lower(text), lower(name)) - 1 as hit, length(text) as len from m where length(name) > 2 and not contains(name, chr(10))),
    w as (select *, greatest(0, hit - 200) as l, least(len, hit + length(name) + 200) as r from a where hit >= 0),
    e as (select *, reverse(substring(text, l - least(l, 100) + 1, least(l, 100) + 1)) as b, substring(text, r + 1, 100) as f from w),
    s as (select *, case when l = 0 then 0 when instr(b, chr(10)) > 0 then l - (instr(b, chr(10)) - 1) else l - least(l, 100) end as st,
      case when instr(f, chr(10)) > 0 then r + instr(f, chr(10)) - 1 else r + length(f) end as en from e)
    select name, doc_id as url, 
      trim(concat(substring(text, st + 1, hit - st), '**', substring(text, hit + 1, length(name)), '**', substring(text, hit + length(name) + 1, en - hit - length(name))), ' ' || chr(10)) as context
    from s""",
)
def e08(t):
    pages = t("documents").select(F.col("doc_id").alias("url"), F.col("text").alias("content"))
    return extract.mention_context(_mentions(t), pages)


_KW = [*[w for w in "that with theon leaux queau".split() if len(w) > 3 and w not in rules.KEYWORD_SKIP], *rules.INDUSTRY_KEYWORDS]


@query(
    "e09_keyword_relevance",
    f"""with k as (select doc_id, lower(text) as x, length(text) as n, list_filter({sql_list(_KW)}, lambda w: contains(lower(text), w)) as h from documents where text <> ''),
    r as (select doc_id, x, unnest(h) as keyword from k)
    select doc_id, concat('Doc', doc_id) as name, keyword, round(least(1.0, ((length(x) - length(replace(x, keyword, ''))) // length(keyword)) / 10.0), 6) as score from r""",
)
def e09(t):
    docs = t("documents", True).select("doc_id", F.concat(F.lit("Doc"), "doc_id").alias("name"), F.col("text").alias("context"))
    docs = docs.withColumn("query", F.lit("that with theon leaux queau"))
    out = extract.keyword_relevance(docs, "name", "context", F.col("query"), ["doc_id"])
    return out.withColumn("score", F.round("score", 6))


_ANSWER = """case event_id % 10 when 0 then concat('```json', chr(10), props, chr(10), '```') when 1 then concat('```', chr(10), '[', props, ',', props, ']', chr(10), '```')
  when 2 then concat('Here it is: ', props, ' - done') when 3 then '[1, 2]' when 4 then '  ' when 5 then 'nothing to parse' when 6 then concat('Here: [', props, ', ', props, '] done')
  when 7 then concat(props, ' and more words') when 8 then 'see {1} and [2, 3] there' else props end"""


@query(
    "e10_parse_model_json",
    f"""with a as (select event_id, replace(props, ': ', ':') as p from events)
    select event_id, event_id % 10 not in (3, 4, 5, 8) as valid, case when event_id % 10 in (1, 6) then concat('[', p, ',', p, ']') when event_id % 10 in (3, 4, 5, 8) then '' else p end as json,
      case event_id % 10 when 3 then 'List response contains non-object items' when 4 then 'Empty response' when 5 then 'JSON parsing error' when 8 then 'List response contains non-object items' else '' end as error from a""",
)
def e10(t):
    answers = t("events").select("event_id", F.expr(_ANSWER).alias("answer"))
    return parsing.parse_model_json(answers, "answer", ["event_id"]).fillna("", ["json", "error"])


_NAMES = """case event_id % 4 when 0 then concat(event_type, ', U', user_id, ' , ,') when 1 then 'No startups found' when 2 then concat('["', event_type, '", "U', user_id, '"]') else event_type end"""


@query(
    "e11_parse_name_list",
    """select event_id, unnest(case event_id % 4 when 3 then [event_type] else [event_type, concat('U', user_id)] end) as name,
      unnest(case event_id % 4 when 3 then [0] else [0, 1] end) as pos from events where event_id % 4 <> 1""",
)
def e11(t):
    return t("events").select("event_id", F.posexplode(parsing.parse_name_list(F.expr(_NAMES))).alias("pos", "name"))


_EXPANSION = "concat('1. ', p_name, chr(10), chr(10), '2. ', upper(p_name), chr(10), '- ', p_type, ' ', p_brand, chr(10), '* ', p_type, chr(10), p_type, chr(10), '10. big ', p_name, chr(10), 'x ', p_name)"


@query(
    "e12_parse_query_expansions",
    """select p_partkey, unnest([p_name, concat(p_type, ' ', p_brand), p_type, concat('big ', p_name)]) as query, unnest([0, 1, 2, 3]) as pos from part""",
)
def e12(t):
    queries = parsing.parse_query_expansions(F.col("p_name"), F.expr(_EXPANSION), 3)
    return t("part").select("p_partkey", F.posexplode(queries).alias("pos", "query"))
