"""Rule-based extraction jobs (E01-E09) and the HTML jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sievework import rules
from sievework.functions import markup, urls
from sievework.functions.text import clean_text, contains_any, count_matches, remove_emails, remove_urls, strip, truncate_text
from sievework.functions.text import clean_pdf_text, unescape, unnest


def _add(df: DataFrame, fn, inputs: list[str], out: str, kind: T.DataType) -> DataFrame:
    rest = [f for f in df.schema.fields if f.name not in inputs]
    schema = T.StructType([*rest, T.StructField(out, kind)])
    return df.mapInArrow(markup.batches(fn, inputs, out, to_arrow_type(kind)), schema)


def html_to_text(
    pages: DataFrame, html: str = "html", out: str = "text", keep_breaks: bool = False,
    max_input: int | None = None, max_output: int | None = None,
) -> DataFrame:
    """T03. Whole pages by default. ``keep_breaks`` puts a blank line between text runs."""
    if max_input:
        pages = pages.withColumn(html, truncate_text(F.col(html), max_input))
    separator = "\n\n" if keep_breaks else " "
    df = _add(pages, lambda h: markup.html_to_text(h or "", separator), [html], out, T.StringType())
    text = strip(F.col(out)) if keep_breaks else clean_text(F.col(out))
    return df.withColumn(out, truncate_text(text, max_output) if max_output else text)


def main_content(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """T04 without pruning."""
    df = _add(pages, lambda h: markup.main_content(markup.parse(h or "")), [html], out, T.StringType())
    return df.withColumn(out, clean_text(F.col(out)))


def pruned_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All text that is left after pruning."""
    df = _add(pages, lambda h: markup.prune(markup.parse(h or "")).text(" ", True), [html], out, T.StringType())
    return df.withColumn(out, clean_text(F.col(out)))


def html_to_markdown(pages: DataFrame, html: str = "html", out: str = "markdown") -> DataFrame:
    """T06."""
    return _add(pages, lambda h: markup.html_to_markdown(h or ""), [html], out, T.StringType())


def process_content(df: DataFrame, content: str, kind: str, out: str = "text") -> DataFrame:
    """Html, pdf, image or plain text to cleaned text."""
    html = html_to_text(df.filter(F.col(kind) == "html"), content, out)
    other = df.filter(F.coalesce(F.col(kind) != "html", F.lit(True)))
    other = other.withColumn(
        out, F.when(F.col(kind) == "pdf", clean_pdf_text(F.col(content))).otherwise(clean_text(F.col(content)))
    ).drop(content)
    return html.unionByName(other).withColumn(out, remove_emails(remove_urls(clean_text(F.col(out)))))


def extract_forum_thread(pages: DataFrame, page: str, html: str = "html", limit: int | None = None, jobs: int | None = None, talk: int | None = None) -> DataFrame:
    """(page, thread_text). Comments become rows; the choice among them is native.

    ``jobs`` and ``talk`` look at the first so many comments only, ``limit`` cuts the text.
    """
    hiring = F.lower(html).contains("who is hiring")
    title = unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))
    staged = pages.select(page, html, hiring.alias("hiring"), title.alias("title"))
    comments = _add(staged, lambda h: markup.forum_comments(h or ""), [html], "comments", T.ArrayType(T.StringType()))
    texts = F.transform("comments", lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    looked, read = ((lambda t, n=n: F.lit(True) if n is None else t["i"] < n) for n in (jobs, talk))
    offers = F.filter(texts, lambda t: looked(t) & (F.length(t["c"]) >= 100) & contains_any(F.lower(t["c"]), rules.HIRING_WORDS))
    said = F.filter(texts, lambda t: read(t) & (t["c"] != ""))
    head = F.when(F.col("title") != "", F.array(F.concat(F.lit("# "), "title"))).otherwise(F.array().cast("array<string>"))
    parts = F.when(F.col("hiring"), F.transform(offers, lambda t: F.regexp_replace(t["c"], r"(?U)\s+", " "))).otherwise(
        F.concat(head, F.transform(said, lambda t: t["c"]))
    )
    whole = F.array_join(parts, "\n\n---\n\n")
    return comments.select(page, (whole if limit is None else truncate_text(whole, limit)).alias("thread_text"))


def extract_by_site(pages: DataFrame, page: str, url: str = "url", html: str = "html") -> DataFrame:
    """(page, kind, content) with labelled lines, by host of the URL."""
    site = urls.host(F.col(url))
    kind = None
    for name, needle in rules.EXTRACTOR_HOSTS:
        kind = F.when(site.contains(needle), name) if kind is None else kind.when(site.contains(needle), name)
    staged = pages.select(page, kind.otherwise("generic").alias("kind"), html).withColumn("_kind", F.col("kind"))
    parts = _add(staged, lambda k, h: markup.site_fields(k, h or ""), ["_kind", html], "parts", T.MapType(T.StringType(), T.StringType()))
    order = ["Title", "Company Name", "Description", "Details", "Funding", "Content", "Comments"]
    lines = [
        F.when(
            F.try_element_at("parts", F.lit(k)) != "",
            F.concat(F.lit("Comments:\n" if k == "Comments" else k + ": "), F.col("parts")[k]),
        )
        for k in order
    ]
    return parts.select(page, "kind", F.concat_ws("\n\n", *lines).alias("content"))


def page_fields_text(pages: DataFrame, page: str, role: str = "website", html: str = "html", raw_below: int = 0) -> DataFrame:
    """(page, page_text). With ``raw_below``, a page with fewer characters found is given as it is, markup and all."""
    staged = pages.select(page, F.col(html).alias("_raw"), html)
    s = _add(staged, lambda h: markup.page_sections(role, h or ""), [html], "s", T.MapType(T.StringType(), T.StringType()))

    def labelled(key: str, label: str, end: str) -> Column:
        value = F.col("s")[key]
        return F.when(value != "", F.concat(F.lit(label), value, F.lit(end))).otherwise("")

    text = F.concat(
        labelled("title", "Title: ", "\n\n"),
        labelled("description", "Meta Description: ", "\n\n"),
        labelled("og_description", "OG Description: ", "\n\n"),
        labelled("sections", "", "\n\n"),
        labelled("body", "", "\n"),
        labelled("social", "\n", ""),
    )
    return s.select(page, F.when(F.length(text) < raw_below, F.col("_raw")).otherwise(text).alias("page_text"))


def extract_orgs(text: Column) -> Column:
    """Distinct names before a legal or trade word, sorted."""
    found = [F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(1)) for p in rules.ORG_PATTERNS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def filter_common_orgs(orgs: Column) -> Column:
    """E02."""
    return F.filter(orgs, lambda o: ~o.isin(*rules.COMMON_ORGS) & (F.length(o) > 2))


def extract_facts(df: DataFrame, text: str, rule_set: str, keep: list[str], known: dict[str, str] | None = None) -> DataFrame:
    """One column per field; the first pattern that matches counts.

    ``known`` maps a field to a column whose non-blank value is kept.
    """
    out = [F.col(k) for k in keep]
    for field in dict.fromkeys(f for f, _ in rules.FACT_RULES[rule_set]):
        tries = [
            F.nullif(strip(F.regexp_extract(F.col(text), "(?U)" + p, 1)), F.lit(""))
            for f, p in rules.FACT_RULES[rule_set]
            if f == field
        ]
        if known and field in known:
            tries.insert(0, F.nullif(F.col(known[field]), F.lit("")))
        out.append(F.coalesce(*tries).alias(rules.snake(field)))
    return df.select(*out)


def is_likely_name(name: Column) -> Column:
    """E06."""
    low = F.lower(name)
    return ~low.isin(*rules.UI_WORDS) & (F.length(name) > 2) & ~contains_any(low, rules.UI_PHRASES)


def best_org_match(df: DataFrame, key: str, name: str, orgs: str) -> DataFrame:
    """(key, name, best_org); names and orgs by containment and shared letters.

    An exact match scores 1. The orgs of a row are the array of that row, so no join is needed.
    """

    def letters(c: Column) -> Column:
        return F.array_distinct(F.split(F.lower(c), ""))

    def scored(o):
        a, b = F.lower(o), F.lower(F.col(name))
        hit = F.contains(a, b) | F.contains(b, a)
        score = F.size(F.array_intersect(letters(o), letters(F.col(name)))) / F.size(
            F.array_union(letters(o), letters(F.col(name)))
        )
        return F.struct(F.when(a == b, 2.0).when(hit, score).otherwise(0.0).alias("s"), o.alias("o"))

    best = F.aggregate(
        F.transform(F.col(orgs), scored),
        F.struct(F.lit(0.5).cast("double").alias("s"), F.lit(None).cast("string").alias("o")),
        lambda acc, e: F.when(e["s"] > acc["s"], e).otherwise(acc),
    )
    return df.select(key, name, best["o"].alias("best_org"))


def mention_context(
    mentions: DataFrame, pages: DataFrame, name: str = "name", url: str = "url", content: str = "content", window: int = 200,
    max_content: int | None = None,
) -> DataFrame:
    """(name, url, context) around the first mention, widened to line ends, highlighted.

    With ``max_content`` longer pages get a notice in place of the context.
    """
    rows = mentions.filter(~F.lower(name).isin(*rules.NO_CONTEXT_NAMES)).join(pages.select(url, content), url)
    at = F.instr(F.lower(content), F.lower(F.col(name))) - 1
    rows = rows.withColumn("_at", at).filter("_at >= 0")
    n, length = F.length(name), F.length(content)
    left = F.greatest(F.lit(0), F.col("_at") - window)
    right = F.least(length, F.col("_at") + n + window)
    # up to 100 more characters on either side, stopping at a line break
    reach = F.least(left, F.lit(100))
    before = F.reverse(F.substring(F.col(content), left - reach + 1, reach + 1))
    back = F.instr(before, "\n")
    start = F.when(left == 0, 0).otherwise(left - F.when(back > 0, back - 1).otherwise(reach))
    after = F.substring(F.col(content), right + 1, F.lit(100))
    ahead = F.instr(after, "\n")
    end = right + F.when(ahead > 0, ahead - 1).otherwise(F.length(after))
    rows = rows.withColumns({"_s": start.cast("int"), "_e": end.cast("int")})
    piece = F.substring(F.col(content), F.col("_s") + 1, F.col("_e") - F.col("_s"))
    rows = rows.withColumn("_lead", F.substring(F.col(content), F.col("_s") + 1, F.col("_at") - F.col("_s")))
    hit = F.substring(F.col(content), F.col("_at") + 1, n)
    rest = F.substring(F.col(content), F.col("_at") + n + 1, F.col("_e") - F.col("_at") - n)
    context = strip(F.concat(F.col("_lead"), F.lit("**"), hit, F.lit("**"), rest))
    if max_content:
        notice = F.concat(F.lit("Context extraction skipped for "), F.col(name), F.lit(" due to large content size"))
        context = F.when(length > max_content, notice).otherwise(context)
    return rows.select(name, url, F.when(F.length(piece) == 0, None).otherwise(context).alias("context"))


def keyword_relevance(mentions: DataFrame, name: str, context: str, query: str, keep: list[str], most: int | None = None, max_context: int | None = None) -> DataFrame:
    """(keep, name, keyword, score): query words first, then the industry list.

    ``most`` keeps the first so many keywords of a row; with ``max_context`` longer contexts get one row, ("relevant", 0.5).
    """
    words = F.filter(
        F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*rules.KEYWORD_SKIP)
    )
    keywords = F.array_distinct(F.concat(words, F.array(*[F.lit(k) for k in rules.INDUSTRY_KEYWORDS])))
    low = F.lower(context)
    hits = F.filter(keywords, lambda k: F.contains(low, k))
    hits = hits if most is None else F.slice(hits, 1, most)
    scored = F.transform(
        hits,
        lambda k: F.struct(k.alias("keyword"), F.least(F.lit(1.0), count_matches(low, k) / 10.0).alias("score")),
    )
    too_long = F.array(F.struct(F.lit("relevant").alias("keyword"), F.lit(0.5).cast("double").alias("score")))
    rows = mentions.filter(is_likely_name(F.col(name)) & (F.col(context) != ""))
    found = scored if max_context is None else F.when(F.length(context) > max_context, too_long).otherwise(scored)
    rows = unnest(rows, [*keep, name], found, "k")
    return rows.select(*keep, name, "k.keyword", "k.score")
