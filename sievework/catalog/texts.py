"""Text and HTML jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework import rules
from sievework.catalog.base import WORD, like_any, query, sql_in
from sievework.functions import text as tx
from sievework.operators import extract

MIXED = "concat(text, ' see https://a.example.com/x?y=1 or www.b.org/z, mail j.doe@mail.example.org (50% off) #1')"
NORMAL = rf"trim(regexp_replace(lower(text), '[^{WORD}]+', ' ', 'g'))"


@query("t01_clean_text", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as clean from documents")
def t01(t):
    return t("documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query(
    "t02_remove_patterns",
    rf"""with d as (select doc_id, {MIXED} as m from documents)
    select doc_id, regexp_replace(m, 'https?://\S+|www\.\S+', '', 'g') as no_urls,
      regexp_replace(m, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', '', 'g') as no_emails,
      regexp_replace(m, '[^{WORD}\s.,;:!?()\[\]{{}}"''-]', '', 'g') as no_special from d""",
)
def t02(t):
    m = F.expr(MIXED)
    return t("documents", True).select(
        "doc_id",
        tx.remove_urls(m).alias("no_urls"),
        tx.remove_emails(m).alias("no_emails"),
        tx.remove_special(m).alias("no_special"),
    )


@query("t03_html_to_text")
def t03(t):
    return extract.html_to_text(t("pages", True)).select("page_id", "url", "text")


@query("t04_main_content")
def t04(t):
    return extract.main_content(t("pages", True).select("page_id", "html"))


@query("t05_prune_elements")
def t05(t):
    return extract.pruned_text(t("pages", True).select("page_id", "html"))


@query("t06_html_to_markdown")
def t06(t):
    return extract.html_to_markdown(t("pages", True).select("page_id", "html"))


@query(
    "t07_clean_pdf_text",
    r"""with d as (select doc_id, replace(text, chr(10), chr(12)) as p, text from documents)
    select doc_id, trim(regexp_replace(p, '\s+', ' ', 'g')) as clean,
      array_to_string([concat('<p>', trim(x), '</p>') for x in string_split(text, chr(10)) if trim(x) <> ''], chr(10)) as html
    from d""",
)
def t07(t):
    text = F.col("text")
    paged = F.replace(text, F.lit("\n"), F.lit("\f"))
    return t("documents").select(
        "doc_id",
        tx.clean_pdf_text(paged).alias("clean"),
        tx.to_paragraph_html(F.replace(text, F.lit("\n"), F.lit("\n\n"))).alias("html"),
    )


@query(
    "t08_process_content",
    r"""select doc_id, source, regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
      'https?://\S+|www\.\S+', '', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '', 'g') as text
    from documents""",
)
def t08(t):
    kind = F.when(F.col("source") == "src1", "pdf").when(F.col("source") == "src2", "image").otherwise("text")
    docs = t("documents", True).select("doc_id", "source", F.col("text").alias("content"), kind.alias("kind"))
    return extract.process_content(docs, "content", "kind").select("doc_id", "source", "text")


@query("t08_process_content_html")
def t08_html(t):
    pages = t("pages", True).select("page_id", F.col("html").alias("content"), F.lit("html").alias("kind"))
    return extract.process_content(pages, "content", "kind").select("page_id", "text")


def _threads(t):
    """Forum pages made of conversations: every turn is a comment row."""
    row = F.concat(
        F.lit('<tr class="athing comtr"><td><div class="comment">'), F.col("text"), F.lit("</div></td></tr>")
    )
    turns = F.array_sort(F.collect_list(F.struct("turn", row.alias("r"))))
    body = F.array_join(F.transform(turns, lambda x: x["r"]), "")
    title = F.when(F.col("conv_id") % 2 == 0, "Ask: Who is hiring?").otherwise("A talk")
    return t("conversations").groupBy("conv_id").agg(body.alias("b")).select(
        "conv_id", F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body><table>"), "b", F.lit("</table></body></html>")).alias("html")
    )


@query(
    "t09_extract_forum_thread",
    rf"""with r as (select *, row_number() over (partition by conv_id order by turn) as rn, trim(text, ' ' || chr(10)) as c from conversations),
    k as (select conv_id, rn, case when conv_id % 2 = 0 then regexp_replace(c, '\s+', ' ', 'g') else c end as c from r where
      (conv_id % 2 = 0 and length(c) >= 100 and {like_any('lower(c)', rules.HIRING_WORDS)}) or (conv_id % 2 = 1 and c <> '')
      union all select distinct conv_id, 0, '# A talk' from conversations where conv_id % 2 = 1),
    s as (select distinct conv_id from conversations)
    select s.conv_id, coalesce(string_agg(c, concat(chr(10), chr(10), '---', chr(10), chr(10)) order by rn), '') as thread_text from s left join k using (conv_id) group by 1""",
)
def t09(t):
    return extract.extract_forum_thread(_threads(t), "conv_id")


@query("t10_extract_by_site")
def t10(t):
    hosts = F.array(*[F.lit(h) for h in ("www.linkedin.com", "www.crunchbase.com", "techcrunch.com", "news.ycombinator.com", "x.example.org")])
    url = F.concat(F.lit("https://"), F.element_at(hosts, (F.col("page_id") % 5 + 1).cast("int")), F.lit("/p/"), "page_id")
    return extract.extract_by_site(t("pages", True).withColumn("url", url), "page_id")


@query("t11_page_fields_text")
def t11(t):
    return extract.page_fields_text(t("pages", True), "page_id", "website")


@query(
    "t12_page_title_name",
    r"""with p as (select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1) as t from pages)
    select page_id, trim(split_part(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
      '&#39;', ''''), '&amp;', '&'), '-', 1)) as name from p""",
)
def t12(t):
    return t("pages").select("page_id", tx.page_title_name(F.col("html")).alias("name"))


@query(
    "t13_content_stats",
    r"""with d as (select doc_id, length(text) as raw_length,
      length(trim(regexp_replace(text, '\s+', ' ', 'g'))) as clean_length from documents where trim(text) <> '')
    select doc_id, raw_length, clean_length, round((raw_length - clean_length) / raw_length * 100, 2) as reduction from d""",
)
def t13(t):
    docs = t("documents").filter(~tx.is_blank(F.col("text"))).select(
        "doc_id", F.length("text").alias("raw_length"), F.length(tx.clean_text(F.col("text"))).alias("clean_length")
    )
    return docs.withColumn("reduction", tx.reduction_percent(F.col("raw_length"), F.col("clean_length")))


@query("t14_normalize_query", f"select doc_id, {NORMAL} as normal from documents")
def t14(t):
    return t("documents", True).select("doc_id", tx.normalize_query(F.col("text")).alias("normal"))


@query(
    "t15_extract_keywords",
    rf"""with d as (select doc_id, string_split({NORMAL}, ' ') as w from documents)
    select doc_id, array_to_string([x for x in w if x not in {sql_in(rules.QUERY_STOPWORDS)}], ' ') as no_stopwords,
      array_to_string([x for x in w if length(x) > 2 and x not in {sql_in(rules.QUERY_STOPWORDS)}], ' ') as keywords from d""",
)
def t15(t):
    text = F.col("text")
    return t("documents", True).select(
        "doc_id",
        tx.remove_stopwords(tx.normalize_query(text)).alias("no_stopwords"),
        F.array_join(tx.extract_keywords(text), " ").alias("keywords"),
    )


@query(
    "t16_extract_terms",
    rf"""select doc_id, array_to_string([x for x in regexp_extract_all(lower(text), '[{WORD}]+')
      if length(x) > 1 and x not in {sql_in(rules.TERM_STOPWORDS)}], ' ') as terms from documents""",
)
def t16(t):
    return t("documents", True).select("doc_id", F.array_join(tx.extract_terms(F.col("text")), " ").alias("terms"))


@query(
    "t17_truncate_text",
    """select doc_id, case when length(text) > 15000 then concat(left(text, 15000), '...') else text end as prompt_text,
      left(text, 5000) as fallback_text from documents""",
)
def t17(t):
    text = F.col("text")
    return t("documents").select(
        "doc_id", tx.truncate_text(text, 15000, "...").alias("prompt_text"), tx.truncate_text(text, 5000).alias("fallback_text")
    )
