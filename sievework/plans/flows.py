"""Whole flows put together from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import rules
from sievework.functions import urls
from sievework.functions.fields import standardize_companies
from sievework.functions.text import is_blank, meta_description, page_title, page_title_name, unnest
from sievework.operators import chunks, extract, joins, linkgraph, model as m, names, relevance, reports
from sievework.operators.keys import first_per_key, limit_per_key, limit_per_query
from sievework.operators.model import Model
from sievework.operators.positions import with_position
from sievework.operators.similarity import dedupe_queries
from sievework.sources import companies as files
from sievework.session import cut, parts_for


@dataclass
class Discovery:
    """Companies found, and the tables the reports are made of."""

    companies: DataFrame
    stages: DataFrame
    mentions: DataFrame


def discover(queries: DataFrame, hits: DataFrame, pages: DataFrame, model: Model | None = None, per_batch: int = 5, max_results: int = 10) -> Discovery:
    """P01. ``queries(query_id, query)``, ``hits(query_id, rank, title, url, snippet)``, ``pages(url, html)``.

    Without a model the names come from the organisation patterns and are all kept.
    """
    wanted = dedupe_queries(queries, "query_id", "query")
    few = limit_per_query(hits.join(wanted, "query_id"), "query_id", "rank", per_batch, max_results)
    few = few.filter(~urls.is_skipped(F.col("url")))
    found, one = joins.pages_of_hits(cut(few), pages)
    # a page that several queries hit is read and parsed once
    texts = cut(extract.html_to_text(one.select("url_norm", "html")))
    known = found.join(texts, "url_norm")
    keep = ["query_id", "rank", "url", "url_norm", "title", "query"]
    if model is None:
        orgs = extract.filter_common_orgs(extract.extract_orgs(F.col("text")))
        named = unnest(known, keep, orgs, "name", "name_pos")
    else:
        named = m.extract_names(known, keep, F.col("text"), F.col("query"), model)
    named = cut(named.filter(extract.is_likely_name(F.col("name"))))
    stage = [named.select("name", F.lit("Potential").alias("stage")), named.select("name", F.lit("LLM Extracted").alias("stage"))]
    final = named
    if model is not None:
        listed = F.array_sort(F.collect_list(F.struct("name_pos", "name")))
        asked = named.groupBy(*keep).agg(F.transform(listed, lambda x: x["name"]).alias("names"))
        rest = [k for k in keep if k != "url"]
        valid = cut(m.validate_names(asked, rest, "names", "url", model))
        stage.append(valid.select("name", F.lit("Validated").alias("stage")))
        again = F.array_sort(F.collect_list(F.struct("name_pos", "name")))
        asked = valid.groupBy(*keep).agg(F.transform(again, lambda x: x["name"]).alias("names"))
        final = cut(m.filter_relevant(asked, keep, "names", F.col("query"), model))
    stage.append(final.select("name", F.lit("Final").alias("stage")))
    rows = first_per_key(final, [joins.trimmed_key(F.col("name"))], F.struct("query_id", "rank", "url", "name_pos"))
    rows = rows.select(
        F.col("name").alias("Company Name"),
        F.lit("Search").alias("Source"),
        F.col("title").alias("Found In"),
        F.col("url").alias("Original URL"),
    )
    stages = stage[0]
    for s in stage[1:]:
        stages = stages.unionByName(s)
    mentions = named.select("name", "url", "query_id", "query", "url_norm").distinct()
    return Discovery(rows, stages, mentions)


def enrich(companies: DataFrame, hits: DataFrame, pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """P02. ``companies(name)``, ``hits(name, query_no, rank, title, url, snippet)``, ``pages(url, html)``.

    Facts of every source become rows with a priority; the first non-blank one counts.
    ``known(name, data...)`` are results from earlier runs; only the others are worked on.
    """

    def compute(todo: DataFrame) -> DataFrame:
        mine = hits.join(todo.select("name").distinct(), "name", "left_semi")
        site = linkgraph.match_official_site(mine)
        profile = linkgraph.match_profile_url(mine, pages)
        found, one = joins.pages_of_hits(mine, pages)
        texts = cut(extract.page_fields_text(one, "url_norm", "website"))
        texts = found.select("name", "query_no", "rank", "snippet", "title", "url_norm").join(texts, "url_norm")
        seen = texts.drop("page_text")
        facts = extract.extract_facts(texts, "page_text", "site", ["name", "query_no", "rank", "snippet"])
        fields = ["Location", "Founded Year", "Industry", "Funding"]
        order = F.struct(F.lit(4).alias("source"), "query_no", "rank")
        rows = facts.select("name", order.alias("priority"), *[F.col(rules.snake(f)).alias(f) for f in fields])
        long = rows.unpivot(["name", "priority"], fields, "field", "value")
        described = seen.select(
            "name", F.struct(F.lit(5).alias("source"), "query_no", "rank").alias("priority"),
            F.lit("Product Description").alias("field"), F.col("snippet").alias("value"),
        )
        fixed = [
            (site.select("name", F.col("website").alias("value")), "Website", 1),
            (profile.select("name", F.col("profile").alias("value")), "LinkedIn", 2),
        ]
        for frame, field, source in fixed:
            long = long.unionByName(
                frame.select(
                    "name",
                    F.struct(F.lit(source).alias("source"), F.lit(0).cast("int").alias("query_no"), F.lit(0).cast("int").alias("rank")).alias("priority"),
                    F.lit(field).alias("field"),
                    "value",
                )
            )
        long = long.unionByName(described)
        titles = ["Website", "LinkedIn", "Location", "Founded Year", "Industry", "Funding", "Product Description"]
        merged = joins.merge_facts(long, titles, "name")
        return todo.select("name").distinct().join(merged, "name", "left")

    if known is None:
        return compute(companies)
    return joins.with_cache(companies, known, ["name"], compute)


#: What the gap-driven flow fills, and the field of A18 that each of the asked ones answers to.
GAP_TARGETS = ["Website", "LinkedIn", "Location", "Founded Year", "Industry", "Funding", "Product Description"]
GAP_NAMES = {"Location": "Location", "Founded Year": "Founded Year", "Industry": "Industry", "Funding": "Funding", "Company Description": "Product Description"}


def _gaps(filled: DataFrame) -> DataFrame:
    """(name, missing): companies with blank cells, and which."""
    missing = reports.missing_fields({gap: rules.snake(title) for gap, title in GAP_NAMES.items()})
    titles = F.create_map(*[F.lit(x) for pair in GAP_NAMES.items() for x in pair])
    asked = F.transform(F.filter(missing, lambda g: g.isin(*GAP_NAMES)), lambda g: F.try_element_at(titles, g))
    return filled.select("name", asked.alias("missing")).filter(F.size("missing") > 0)


def _fill(filled: DataFrame, facts: DataFrame, parts: int) -> DataFrame:
    """The table with its blank cells taken from facts (name, field, value, priority), both dealt to so many partitions."""
    filled, facts = (df.repartition(parts, "name") for df in (filled, facts))
    merged = joins.merge_facts(facts, GAP_TARGETS, "name")
    new = merged.select(F.col("name").alias("_name"), *[F.col(c).alias(f"_{c}") for c in map(rules.snake, GAP_TARGETS)])
    cells = [F.when(is_blank(F.col(c)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in map(rules.snake, GAP_TARGETS)]
    return filled.join(new.hint("merge"), F.col("name") == F.col("_name"), "left").select("name", *cells)


def _rule_facts(texts: DataFrame, text: str, rule_set: str) -> DataFrame:
    """Facts of texts (name, order, text) by rules, in long form."""
    found = extract.extract_facts(texts, text, rule_set, ["name", "order"])
    known = [f for f in dict.fromkeys(f for f, _ in rules.FACT_RULES[rule_set]) if f in GAP_TARGETS]
    rows = found.select("name", F.col("order").alias("priority"), *[F.col(rules.snake(f)).alias(f) for f in known])
    return rows.unpivot(["name", "priority"], known, "field", "value")


def _ask_in_turn(filled: DataFrame, texts: DataFrame, model: Model, parts: int) -> DataFrame:
    """M06 text by text: a company's next text goes out only while it has blank cells, and names just those."""
    placed = cut(with_position(texts.select("name", "source", "order", "page_text"), "order", ["name"], out="at"))
    turns = placed.agg(F.max("at")).first()[0] or 0
    for turn in range(1, turns + 1):
        left = cut(placed.filter(F.col("at") >= turn).repartition(parts, "name").join(_gaps(filled).hint("merge"), "name"))
        if left.isEmpty():
            break
        told = m.extract_structured(left.filter(F.col("at") == turn), "name", "source", "page_text", "missing", model)
        filled = cut(_fill(filled, told.select("name", "field", "value", F.lit(0).alias("priority")), parts))
    return filled


def enrich_gaps(companies: DataFrame, hits: DataFrame, pages: DataFrame, model: Model | None = None) -> DataFrame:
    """P02 source by source: each one is read for the companies that still have blank cells, and for those cells only.

    ``companies(name)``, ``hits(name, query_no, rank, title, url, snippet)``, ``pages(url, html)``. After website, profile and snippets come
    the official site, LinkedIn, Crunchbase, the combined search results (A17) and all other pages. Of each source rules
    read first; then the ``model`` is asked text by text for what is left (M06). Companies that are full are not joined to the next
    source, so none of their pages are parsed and none of their texts are sent. Rows are dealt out by the number of companies, and joins are
    merges: sizes are estimated from the files behind the input, and names or URLs made from a small file may be gigabytes in every executor.
    """
    todo = companies.select("name").distinct()
    parts = parts_for(todo.count(), 10_000)
    # written once: eight steps read the hits, and each source would pick the pages of all hits anew
    mine = cut(hits.repartition(parts, "name").join(todo.repartition(parts, "name").hint("merge"), "name", "left_semi"))
    found, one = joins.pages_of_hits(mine, pages, parts=parts)
    one = cut(one)
    site, profile = cut(linkgraph.match_official_site(mine)), linkgraph.match_profile_url(mine, pages, parts=parts)
    order = F.struct("query_no", "rank", "url")
    first = F.struct(F.lit(0).alias("query_no"), F.lit(0).alias("rank"), F.lit("").alias("url"))
    facts = site.select("name", F.lit("Website").alias("field"), F.col("website").alias("value"), first.alias("priority"))
    facts = facts.unionByName(profile.select("name", F.lit("LinkedIn").alias("field"), F.col("profile").alias("value"), first.alias("priority")))
    described = mine.select("name", F.lit("Product Description").alias("field"), F.col("snippet").alias("value"), F.struct(F.col("query_no").cast("int").alias("query_no"), F.col("rank").cast("int").alias("rank"), "url").alias("priority"))
    empty = todo.select("name", *[F.lit(None).cast("string").alias(rules.snake(f)) for f in GAP_TARGETS])
    filled = cut(_fill(empty, facts.unionByName(described), parts))

    own = urls.host(F.col("url")) == urls.host(F.col("website"))
    kind = linkgraph.extractor_kind(F.col("url"))
    source = F.when(kind.isin("linkedin", "crunchbase"), kind).when(own, "website").otherwise("other")
    placed = cut(found.join(site.hint("merge"), "name", "left").select("name", "query_no", "rank", "url", "url_norm", source.alias("source"), order.alias("order")))

    def read(filled: DataFrame, source: str, role: str) -> DataFrame:
        asked = cut(placed.filter(F.col("source") == source).repartition(parts, "name").join(_gaps(filled).hint("merge"), "name", "left_semi"))
        texts = extract.page_fields_text(one.join(asked.select("url_norm").distinct().hint("merge"), "url_norm", "left_semi"), "url_norm", role)
        texts = cut(asked.repartition(parts, "url_norm").join(texts.hint("merge"), "url_norm"))
        filled = cut(_fill(filled, _rule_facts(texts, "page_text", "site"), parts))
        return filled if model is None else _ask_in_turn(filled, texts, model, parts)

    for source_name in ("website", "linkedin", "crunchbase"):
        filled = read(filled, source_name, source_name)
    listed = mine.join(_gaps(filled).hint("merge"), "name", "left_semi")
    texts = reports.combine_snippets(listed, "name", "rank", F.col("title"), F.col("url"), F.col("snippet"))
    texts = cut(texts.select("name", F.lit("search").alias("source"), F.lit(0).alias("order"), F.col("combined").alias("page_text")))
    filled = cut(_fill(filled, _rule_facts(texts, "page_text", "search"), parts))
    filled = filled if model is None else _ask_in_turn(filled, texts, model, parts)
    return read(filled, "other", "search")


def validate(df: DataFrame, index: str, record: str, query: str, model: Model, done: DataFrame | None = None) -> DataFrame:
    """Records checked in batches; ``done(index, record)`` are results from earlier runs."""

    def compute(todo: DataFrame) -> DataFrame:
        return m.validate_companies(todo.select(index, record), index, record, query, model)

    base = df.select(F.col(index).cast("long").alias(index), record)
    return compute(base) if done is None else joins.with_cache(base, done, [index], compute)


def find_and_enrich(
    spark: SparkSession, queries: DataFrame, hits: DataFrame, pages: DataFrame, company_hits, model: Model | None, base: str,
    stamp: str, per_batch: int = 5, per_query: int = 10,
) -> dict[str, DataFrame]:
    """Discovery, enrichment, export rows and reports; a finished phase is read back, not redone.

    ``company_hits`` is a function from the companies table to their search hits.
    """
    found_at, rich_at = f"{base}_discovery_{stamp}", f"{base}_enrichment_{stamp}"
    stages_at, mentions_at = f"{base}_stages_{stamp}", f"{base}_mentions_{stamp}"
    found = files.read_checkpoint(spark, found_at)
    if found.isEmpty():
        result = discover(queries, hits, pages, model, per_batch, per_query)
        result.stages.write.mode("overwrite").parquet(stages_at)
        result.mentions.write.mode("overwrite").parquet(mentions_at)
        files.write_checkpoint(result.companies, base, "discovery", stamp=stamp)
        found = files.read_checkpoint(spark, found_at)
    rich = files.read_checkpoint(spark, rich_at)
    if rich.isEmpty():
        base_rows = found.select(F.col("Company Name").alias("name"))
        enriched = enrich(base_rows, company_hits(base_rows), pages)
        titles = {rules.snake(t): t for t in rules.EXPORT_COLUMNS}
        renamed = enriched.select(
            F.col("name").alias("Company Name"), *[F.col(c).alias(titles[c]) for c in enriched.columns if c in titles]
        )
        full = found.join(renamed, "Company Name", "left")
        files.write_checkpoint(full, base, "enrichment", stamp=stamp)
        rich = files.read_checkpoint(spark, rich_at)
    stages, mentions = spark.read.parquet(stages_at), spark.read.parquet(mentions_at)
    return {
        "export": files.export_rows(rich),
        "funnel": reports.funnel(stages),
        "membership": joins.stage_membership(stages),
        "completion": reports.field_completion(
            rich.select("Company Name", *[F.col(f"`{c}`") for c in ("Website", "Location", "Founded Year") if c in rich.columns]),
            "Company Name",
            [c for c in ("Website", "Location", "Founded Year") if c in rich.columns],
        ),
        "queries": reports.query_effectiveness(mentions, "query", "name"),
        "edges": reports.edge_table(mentions, "name", "url"),
    }


def two_phase_search(queries: DataFrame, hits: DataFrame, pages: DataFrame, company_hits, model: Model | None, max_results: int, per_batch: int = 5, per_query: int = 10) -> DataFrame:
    """Found and enriched companies, each name once, ``max_results`` rows."""
    found = cut(discover(queries, hits, pages, model, per_batch, per_query).companies.select(F.col("Company Name").alias("name")))
    enriched = enrich(found, company_hits(found), pages)
    unique = first_per_key(enriched, [joins.trimmed_key(F.col("name"))], "name")
    return unique.orderBy("name").limit(max_results)


def clean_and_chunk(pages: DataFrame, group: str, page: str, size: int = 50000, query: str | None = None, keep_breaks: bool = True) -> DataFrame:
    """Pages to text to chunks with their sources."""
    base = pages.select(
        group, page, "url", page_title(F.col("html")).alias("title"),
        (F.col(query) if query else F.lit(None).cast("string")).alias("search_query"), "html",
    )
    texts = extract.html_to_text(base, keep_breaks=keep_breaks)
    return chunks.chunk_batch(texts, group, page, "text", size)


def dedupe_file(spark: SparkSession, path: str, out: str, fuzzy: bool = True) -> None:
    """Deduplicate a Parquet table of companies into a new folder."""
    df = spark.read.parquet(path)
    done = names.dedupe_companies(df, "pos", "Company Name") if fuzzy else names.dedupe_basic(df, "pos", "Company Name")
    done.write.mode("errorifexists").parquet(out)


def search_and_extract(hits: DataFrame, pages: DataFrame, n: int, query: str = "query_id") -> DataFrame:
    """Up to n companies per query from three times as many hits."""
    more = limit_per_key(hits, [query], ["rank"], 3 * n).drop("rn")
    found, one = joins.pages_of_hits(more, pages)
    about = [page_title_name(F.col("html")).alias("company_name"), meta_description(F.col("html")).alias("description")]
    texts = cut(extract.pruned_text(one.select("url_norm", "html", *about), "html"))
    texts = found.select(query, "rank", "url", "snippet", "url_norm").join(texts, "url_norm").drop("url_norm")
    facts = extract.extract_facts(texts, "text", "search", [query, "rank"])
    named = texts.select(query, "rank", "url", "snippet", "company_name", "description")
    rows = named.join(facts, [query, "rank"]).filter(~is_blank(F.col("company_name")))
    rows = rows.withColumn(
        "product_description", F.coalesce(F.nullif(F.col("description"), F.lit("")), "snippet")
    ).drop("description", "snippet")
    return limit_per_key(rows, [query], ["rank"], n)


def rank_and_export(df: DataFrame, query: str, fields: list[str], order: str, min_confidence: float = 0.0, current_year: int = 2025) -> DataFrame:
    """Standardised, scored and ordered rows."""
    clean = standardize_companies(df, fields, current_year, keep=(order,))
    columns = {f: f.lower().replace(" ", "_") for f in fields}
    return relevance.rank(clean, query, columns, order, min_confidence)
