"""Field standardisation as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import rules
from sievework.functions.text import contains_any, is_blank, let, strip


def _drop_prefixes(c: Column, prefixes: list[str]) -> Column:
    out = strip(c)
    for prefix in prefixes:
        hit = F.lower(out).startswith(prefix.lower())
        out = F.when(hit, strip(F.substring(out, len(prefix) + 1, 1 << 30))).otherwise(out)
    return F.rtrim(out, F.lit(".,"))


def _comma_separated(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)\s+and\s+", ", ")
    return F.regexp_replace(c, r"(?U)\s*[&|/]\s*", ", ")


def company_name(c: Column) -> Column:
    """legal suffixes go one after the other, in list order."""
    out = F.rtrim(strip(c), F.lit("."))
    for suffix in rules.NAME_SUFFIXES:
        out = F.regexp_replace(out, rf"(?iU)\s+{re.escape(suffix)}\.?$", "")
    return strip(out)


def basic_clean_name(c: Column) -> Column:
    """the other suffix list, quotes removed, blanks collapsed."""
    out = c
    for pattern in rules.PLAIN_NAME_SUFFIX_PATTERNS:
        out = F.regexp_replace(out, "(?iU)" + pattern, "")
    out = F.regexp_replace(out, "['\"`]", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def name_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def founded_year(c: Column, current_year: int) -> Column:
    """only the first year-like token counts."""
    year = F.regexp_extract(c, r"(?U)\b(?:19|20)\d{2}\b", 0).try_cast("int")
    return F.when(year.between(1900, current_year), year)


def location(c: Column) -> Column:
    return _drop_prefixes(c, rules.LOCATION_PREFIXES)


def website(c: Column) -> Column:
    """F05."""
    low = F.lower(strip(c))
    url = F.when(low.startswith("http://") | low.startswith("https://"), low).otherwise(
        F.concat(F.lit("https://"), low)
    )
    return F.when(url.rlike(rules.WEBSITE_PATTERN), url)


def founders(c: Column) -> Column:
    return _comma_separated(_drop_prefixes(c, rules.FOUNDER_PREFIXES))


def funding(c: Column) -> Column:
    return _drop_prefixes(c, rules.FUNDING_PREFIXES)


def tech_stack(c: Column) -> Column:
    return _comma_separated(_drop_prefixes(c, rules.TECH_PREFIXES))


# characters whose upper case is several ones, and their single capital: sharp s, and Greek vowels with iota below
_SEVERAL = "ß" + "".join(map(chr, [*range(8064, 8072), *range(8080, 8088), *range(8096, 8104), 8115, 8131, 8179]))
_SINGLE = "ẞ" + "".join(map(chr, [*range(8072, 8080), *range(8088, 8096), *range(8104, 8112), 8124, 8140, 8188]))


def capital(c: Column) -> Column:
    """Upper case of one character as one character; without a single capital it stays as it is."""
    return F.when(F.length(F.upper(c)) > 1, F.translate(c, _SEVERAL, _SINGLE)).otherwise(F.upper(c))


def description(c: Column) -> Column:
    """only the first character changes case."""
    flat = F.regexp_replace(strip(c), r"(?U)\s+", " ")
    return F.concat(capital(F.left(flat, F.lit(1))), F.substring(flat, 2, 1 << 30))


def team_size(c: Column) -> Column:
    """a number or range, else a size word."""
    number = F.regexp_extract(c, r"(?U)\b\d+(?:-\d+)?\b", 0)
    low = F.lower(c)
    out = F.when(number != "", number)
    for word, size in rules.SIZE_WORDS:
        out = out.when(low.contains(word), size)
    return out


def social_media(c: Column) -> Column:
    """platform -> its last URL."""
    urls = F.regexp_extract_all(c, F.lit(r"(?U)https?://[^\s]+"), F.lit(0))

    def platform(url: Column) -> Column:
        out = None
        for name, needles in rules.SOCIAL_PLATFORMS:
            test = contains_any(url, needles)
            out = F.when(test, name) if out is None else out.when(test, name)
        return out.otherwise("Other")

    names = [name for name, _ in rules.SOCIAL_PLATFORMS] + ["Other"]
    tagged = F.transform(urls, lambda u: F.struct(platform(u).alias("p"), u.alias("u")))

    def by_platform(pairs: Column) -> Column:
        def last_of(name: str) -> Column:
            return F.try_element_at(F.filter(pairs, lambda t: t["p"] == name), F.lit(-1))["u"]

        return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[last_of(n) for n in names]))

    return F.map_filter(let(tagged, by_platform), lambda _, v: v.isNotNull())


def competitors(c: Column) -> Column:
    """list of cleaned names."""
    out = strip(c)
    for prefix in rules.COMPETITOR_PREFIXES:
        hit = F.lower(out).startswith(prefix.lower())
        out = F.when(hit, strip(F.substring(out, len(prefix) + 1, 1 << 30))).otherwise(out)
    return F.filter(
        F.transform(F.split(out, r"(?U),|\band\b|[&|/]"), company_name), lambda n: n != ""
    )


def field_rules(current_year: int) -> dict[str, object]:
    """Field title -> column rule."""
    return {
        "Company Name": company_name,
        "Founded Year": lambda c: founded_year(c, current_year).cast("string"),
        "Location": location,
        "Website": website,
        "Founders": founders,
        "Funding Information": funding,
        "Technology Stack": tech_stack,
        "Product Description": description,
        "Team Size": team_size,
        "Social Media": lambda c: F.to_json(social_media(c)),
        "Latest News": description,
        "Competitors": lambda c: F.to_json(competitors(c)),
        "Business Model": description,
        "Target Market": description,
    }


def standardize_companies(
    df: DataFrame, fields: list[str] | None = None, current_year: int = 2025, keep: tuple[str, ...] = ()
) -> DataFrame:
    """one projection; the snake_case column wins over the title-case one."""
    table = field_rules(current_year)
    out = [F.col(k) for k in keep]
    for title in fields or rules.BASIC_FIELDS:
        key = title.lower().replace(" ", "_")
        source = key if key in df.columns else title if title in df.columns else None
        if source is None:
            out.append(F.lit(rules.NOT_AVAILABLE).alias(key))
            continue
        rule = table.get(title, strip)
        out.append(F.coalesce(rule(F.col(f"`{source}`").cast("string")), F.lit(rules.NOT_AVAILABLE)).alias(key))
    return df.select(*out)


def strip_query_marker(c: Column) -> Column:
    """'3. ', '- ' or '* ' at the start of a line."""
    return strip(F.regexp_replace(strip(c), r"^(?:\d+\. |- |\* )", ""))


def drop_empty_fields(fields: Column) -> Column:
    """F16 on a ``map<string,string>``: NULL and every spelling of "nothing" go."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & ~v.isin(*rules.EMPTY_SPELLINGS, "[]", "{}"))


def coerce_fields(df: DataFrame, key: str, data: str, kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """JSON objects to long rows (key, field, kind, value, warning), wrong kinds converted.

    Text is kept as it is; lists and objects are JSON text. ``kind`` is the kind after
    conversion.
    """
    kinds = kinds or rules.FIELD_KINDS
    expected = F.create_map(
        *[x for f, k in kinds.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in k]))]
    )
    parsed = df.select(F.col(key), F.try_parse_json(F.col(data)).alias("_v"))
    rows = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    shape = F.schema_of_variant("value")
    kind = (
        F.when(shape == "STRING", "str")
        .when(shape == "BOOLEAN", "bool")
        .when(shape == "BIGINT", "int")
        .when(shape.startswith("ARRAY"), "list")
        .when(shape.startswith("OBJECT"), "dict")
        .otherwise("float")
    )
    rows = rows.filter(shape != "VOID").select(
        key,
        F.col("key").alias("field"),
        kind.alias("kind"),
        F.when(shape == "STRING", F.try_variant_get("value", "$", "string"))
        .otherwise(F.to_json("value"))
        .alias("value"),
        F.try_element_at(expected, F.col("key")).alias("_want"),
    )
    wrong = F.col("_want").isNotNull() & ~F.array_contains("_want", F.col("kind"))
    to_text = F.array_contains("_want", "str") & (F.col("kind") != "str")
    to_list = F.array_contains("_want", "list") & (F.col("kind") == "str")
    to_map = F.array_contains("_want", "dict") & (F.col("kind") == "str")
    as_list = F.to_json(F.transform(F.split("value", ","), strip))
    json_like = F.schema_of_variant(F.try_parse_json("value"))
    return rows.select(
        key,
        "field",
        F.when(wrong & to_text, "str")
        .when(wrong & to_list, "list")
        .when(wrong & to_map & json_like.startswith("OBJECT"), "dict")
        .otherwise(F.col("kind"))
        .alias("kind"),
        F.when(wrong & to_list & ~to_text, as_list).otherwise(F.col("value")).alias("value"),
        F.when(
            wrong,
            F.format_string("Field '%s' has unexpected type: %s", F.col("field"), F.col("kind")),
        ).alias("warning"),
    )


def validate_fields(requests: DataFrame, request: str, field: str) -> DataFrame:
    """(request, field, valid, suggestions); basics are added to every request."""
    catalogue = F.array(*[F.lit(f) for f in rules.FIELD_CATALOGUE])
    wanted = F.lower(strip(F.col(field)))
    exact = F.filter(catalogue, lambda f: F.lower(f) == wanted)
    near = F.filter(catalogue, lambda f: F.lower(f).contains(wanted))
    checked = requests.select(
        F.col(request),
        F.coalesce(F.try_element_at(exact, F.lit(1)), strip(F.col(field))).alias("field"),
        (F.size(exact) > 0).alias("valid"),
        F.when(F.size(exact) > 0, "").otherwise(F.array_join(near, ", ")).alias("suggestions"),
    )
    basics = (
        requests.select(request)
        .distinct()
        .select(
            request,
            F.explode(F.array(*[F.lit(f) for f in rules.BASIC_FIELDS])).alias("field"),
            F.lit(True).alias("valid"),
            F.lit("").alias("suggestions"),
        )
    )
    return checked.unionByName(basics).distinct()


def validate_settings(df: DataFrame) -> DataFrame:
    """defaults filled in, and the list of problems of each settings row."""
    query = strip(F.col("query"))
    filled = df.withColumns(
        {
            "query": query,
            "max_results": F.coalesce("max_results", F.lit(50)),
            "min_confidence": F.coalesce("min_confidence", F.lit(0.8)),
            "output_format": F.coalesce(F.lower("output_format"), F.lit("csv")),
        }
    )
    problems = F.array_compact(
        F.array(
            F.when(is_blank(F.col("query")), "query is empty").when(
                F.length("query") < 3, "query is shorter than 3 characters"
            ),
            F.when(F.col("max_results") < 1, "max_results is below 1"),
            F.when(~F.col("min_confidence").between(0.0, 1.0), "min_confidence is outside 0..1"),
            F.when(~F.col("output_format").isin("csv", "json"), "output_format is not csv or json"),
        )
    )
    return filled.withColumn("problems", F.array_join(problems, "; "))
