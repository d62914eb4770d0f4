"""Text rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import rules

# every character a Unicode-aware ``\s`` accepts
BLANKS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
)


def strip(c: Column) -> Column:
    """Trim every kind of blank, not only the space."""
    return F.btrim(c, F.lit(BLANKS))


def words_literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def contains_any(c: Column, needles: list[str]) -> Column:
    """True when any needle is a substring of ``c``."""
    test = F.lit(False)
    for needle in needles:
        test = test | c.contains(needle)
    return test


def is_blank(c: Column, sentinels: tuple[str, ...] = ()) -> Column:
    """NULL, only blanks, or one of the given spellings of "nothing"."""
    test = c.isNull() | (strip(c) == "")
    return test | c.isin(*sentinels) if sentinels else test


def clean_text(c: Column) -> Column:
    """Runs of blanks become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + rules.URL_PATTERN, "")


def remove_emails(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + rules.EMAIL_PATTERN, "")


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + rules.SPECIAL_PATTERN, "")


def clean_pdf_text(c: Column) -> Column:
    """Form feeds separate pages, then blanks collapse."""
    return clean_text(F.regexp_replace(c, "\f", "\n\n"))


def to_paragraph_html(c: Column) -> Column:
    """Wrap each paragraph in ``<p>``."""
    parts = F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")


def page_title(html: Column) -> Column:
    return unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))


def page_title_name(html: Column) -> Column:
    """The part of the page title before the first dash."""
    return strip(F.split_part(page_title(html), F.lit("-"), F.lit(1)))


def meta_description(html: Column) -> Column:
    tag = F.regexp_extract(html, r"""(?is)<meta\s[^>]*name\s*=\s*["']description["'][^>]*>""", 0)
    double = F.regexp_extract(tag, r'(?is)content\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, r"(?is)content\s*=\s*'([^']*)'", 1)
    return strip(unescape(F.when(double != "", double).otherwise(single)))


def unescape(c: Column) -> Column:
    """The five named entities; ``&amp;`` last so that nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def reduction_percent(raw: Column, clean: Column) -> Column:
    """Share of characters removed, in percent with two decimals."""
    return F.when(raw > 0, F.round((raw - clean) / raw * 100, 2)).otherwise(F.lit(0.0))


def normalize_query(c: Column) -> Column:
    """Lower, everything but word characters to a space, collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))


def remove_stopwords(c: Column) -> Column:
    stop = words_literal(rules.QUERY_STOPWORDS)
    parts = F.split(strip(c), r"(?U)\s+")
    return F.array_join(F.filter(parts, lambda w: ~F.array_contains(stop, F.lower(w))), " ")


def extract_keywords(c: Column) -> Column:
    """Normalised words that are no stop words and longer than two characters."""
    stop = rules.QUERY_STOPWORDS
    return F.filter(
        F.split(normalize_query(c), " "), lambda w: (F.length(w) > 2) & ~w.isin(*stop)
    )


def has_keyword(c: Column) -> Column:
    """Whether T15 finds any keyword; stops at the first one."""
    stop = "|".join(rules.QUERY_STOPWORDS)
    return F.lower(c).rlike(rf"(?U)(?<!\w)(?!(?:{stop})(?!\w))\w{{3,}}")


def extract_terms(c: Column) -> Column:
    """Word tokens without stop words and single characters."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return F.filter(tokens, lambda w: (F.length(w) > 1) & ~w.isin(*rules.TERM_STOPWORDS))


def truncate_text(c: Column, limit: int, mark: str = "") -> Column:
    """Keep ``limit`` characters; ``mark`` shows that something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def split_paragraphs(c: Column, delimiter: str = r"(?U)\n\s*\n") -> Column:
    """Paragraphs, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(c, delimiter), strip), lambda p: p != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, even where ``body`` loops over it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keep: list[str | Column], items: Column, value: str, pos: str = "_pos") -> DataFrame:
    """One row per item of an array, with its place.

    The outer form with a check of the place afterwards: the plain form makes the optimizer
    add "size > 0 and not null" filters that work out an expensive ``items`` again.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, value)).filter(F.col(pos).isNotNull())
    return rows.drop(pos) if pos == "_pos" else rows


def count_matches(c: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    return ((F.length(c) - F.length(F.replace(c, needle, F.lit("")))) / F.length(needle)).cast("int")
