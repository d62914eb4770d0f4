import pytest
from pyspark.sql import functions as F

from sievework.operators import reports
from sievework.plans import flows

PAGE = "<html><head><title>List</title></head><body><nav>Menu</nav><p>{}</p></body></html>"


def toy_model(prompts):
    """Names are the words in capitals; 'NOPE' is not valid, 'FAR' is not relevant."""
    out = []
    for p in prompts:
        task, rest = p.split("\n", 1)
        if task == "TASK extract":
            out.append(", ".join(w for w in rest.split("TEXT: ")[1].replace(".", " ").split() if w.isupper()))
        else:
            names = rest.split("NAMES: ")[1].split(", ")
            out.append(", ".join(n for n in names if n != ("NOPE" if task == "TASK validate" else "FAR")))
    return out


@pytest.fixture()
def web(spark):
    queries = spark.createDataFrame([(1, "metal coats"), (2, "Metal  coats!"), (3, "wood oils")], "query_id long, query string")
    hits = [
        (1, 1, "https://a.org/x?utm_source=q"), (1, 2, "https://www.facebook.com/p"), (1, 3, "https://b.org/y"), (2, 1, "https://c.org/"),
        (3, 1, "https://B.org/y/"), (3, 2, "https://none.org/"),
    ]
    hits = spark.createDataFrame([(q, r, "Hit", u, "snip") for q, r, u in hits], "query_id long, rank int, title string, url string, snippet string")
    pages = [
        ("https://a.org/x", PAGE.format("ACME and NOPE and AB make coats.")),
        ("https://b.org/y", PAGE.format("BETA and acme and FAR and ACME.")),
        ("https://www.facebook.com/p", PAGE.format("SOCIAL.")),
        ("https://c.org", PAGE.format("GAMMA.")),
    ]
    return queries, hits, spark.createDataFrame(pages, "url string, html string")


def test_discover(web):
    found = flows.discover(*web, model=toy_model)
    rows = sorted((r["Company Name"], r["Original URL"]) for r in found.companies.collect())
    # query 2 repeats query 1, the social page is skipped, each name stays with its first hit
    assert rows == [("ACME", "https://a.org/x?utm_source=q"), ("BETA", "https://b.org/y")]
    stages = {r["stage"]: r["names"] for r in reports.funnel(found.stages).collect()}
    assert stages == {"Potential": 4, "LLM Extracted": 4, "Validated": 3, "Final": 2}


def test_enrich_takes_the_first_filled_source(spark):
    pages = spark.createDataFrame(
        [
            ("https://other.org", "<title>t</title><p>" + "x " * 60 + "Founded in 1990. Located in Rome.</p>"),
            ("https://acme.com", "<title>t</title><p>" + "y " * 60 + 'Based in Oslo.</p><a href="https://www.linkedin.com/company/acme">in</a>'),
        ],
        "url string, html string",
    )
    hits = spark.createDataFrame(
        [("Acme", 0, 1, "t", "https://other.org", ""), ("Acme", 0, 2, "t", "https://acme.com", "Makes coats"), ("Zed", 0, 1, "t", "https://gone.org", "s")],
        "name string, query_no int, rank int, title string, url string, snippet string",
    )
    got = {r["name"]: r for r in flows.enrich(hits.select("name").distinct(), hits, pages).collect()}
    acme = got["Acme"]
    assert (acme["website"], acme["location"], acme["founded_year"], acme["product_description"]) == ("https://acme.com", "Rome", "1990", "Makes coats")
    assert acme["linkedin"] == "https://www.linkedin.com/company/acme"
    assert got["Zed"]["website"] == "https://gone.org" and got["Zed"]["location"] is None
    known = spark.createDataFrame([("Acme", "kept")], "name string, website string")
    again = {r["name"]: r["website"] for r in flows.enrich(hits.select("name").distinct(), hits, pages, known).collect()}
    assert again == {"Acme": "kept", "Zed": "https://gone.org"}


def test_find_and_enrich_resumes(spark, web, tmp_path):
    queries, hits, pages = web

    def company_hits(companies):
        return companies.select("name", F.lit(0).alias("query_no"), F.lit(1).alias("rank"), F.lit("t").alias("title"), F.lit("https://a.org/x").alias("url"), F.lit("s").alias("snippet"))

    base = str(tmp_path / "run")
    first = flows.find_and_enrich(spark, queries, hits, pages, company_hits, toy_model, base, "20240101_000000")

    def broken(prompts):
        raise AssertionError("a finished phase must not run again")

    again = flows.find_and_enrich(spark, queries.filter("false"), hits, pages, None, broken, base, "20240101_000000")
    names = [sorted(r["Company Name"] for r in out["export"].collect()) for out in (first, again)]
    assert names == [["ACME", "BETA"]] * 2
    assert {r["name"]: r["final"] for r in again["membership"].collect()} == {"ACME": "Yes", "BETA": "Yes", "NOPE": "No", "FAR": "No"}
    assert {r["field"]: r["completion"] for r in again["completion"].collect()}["Website"] == 100.0


def test_search_and_extract(spark, web):
    _, hits, pages = web
    rows = flows.search_and_extract(hits, pages, 2).collect()
    assert sorted((r["query_id"], r["rn"], r["company_name"], r["product_description"]) for r in rows) == [
        (1, 1, "List", "snip"), (1, 2, "List", "snip"), (3, 1, "List", "snip"),
    ]  # "https://c.org/" and "https://c.org" are different pages: a lone slash is kept


def test_two_phase_search(web):
    queries, hits, pages = web
    out = flows.two_phase_search(
        queries, hits, pages,
        lambda c: c.select("name", F.lit(0).alias("query_no"), F.lit(1).alias("rank"), F.lit("t").alias("title"), F.lit("https://b.org/y").alias("url"), F.lit("s").alias("snippet")),
        toy_model, 1,
    )
    assert [(r["name"], r["website"]) for r in out.collect()] == [("ACME", "https://b.org/y")]


def test_enrich_gaps_asks_only_for_what_is_blank(spark, tmp_path):
    page = "<html><head><title>t</title></head><body>{}</body></html>"
    pages = [
        ("https://acme.com", "<p>Located in Oslo.</p><p>Founded in 1990.</p><p>Industry: Coats.</p><p>They raised a big round.</p>"),
        ("https://zed.com", "<p>Located in Rome.</p>"), ("https://www.linkedin.com/company/zed", "<section>Founded in 1980.</section>"),
        ("https://www.crunchbase.com/organization/zed", "<p>Industry: Oils.</p>"), ("https://a.org/zed", "<p>one</p>"), ("https://b.org/zed", "<p>FUNDS</p>"), ("https://c.org/zed", "<p>three</p>"),
        ("https://d.org/acme", "<p>never read</p>"), ("https://bare.com", "<p>nothing</p>"),
    ]
    hits = [("Acme", 0, 1, "https://acme.com", "Makes coats"), ("Acme", 0, 2, "https://d.org/acme", "")]
    hits += [("Zed", 0, i, u, "Headquartered in Paris." if i == 1 else "") for i, (u, _) in enumerate(pages[1:7], 1)] + [("Bare", 0, 1, "https://bare.com", None)]
    hits = spark.createDataFrame([(n, q, r, "t", u, s) for n, q, r, u, s in hits], "name string, query_no int, rank int, title string, url string, snippet string")
    pages = spark.createDataFrame([(u, page.format(b)) for u, b in pages], "url string, html string")
    log = str(tmp_path / "asked")

    def model(prompts):
        import json

        out = []
        for p in prompts:
            with open(log, "a") as f:
                f.write(json.dumps(p) + "\n")
            out.append(json.dumps({"Funding": "$5m", "Location": "Elsewhere"} if "FUNDS" in p else {"Funding": "Not available"}))
        return out

    got = {r["name"]: r for r in flows.enrich_gaps(hits.select("name"), hits, pages, model).collect()}
    assert tuple(got["Acme"]) == ("Acme", "https://acme.com", None, "Oslo", "1990", "Coats", "big", "Makes coats")
    assert tuple(got["Zed"])[1:] == ("https://zed.com", "https://www.linkedin.com/company/zed", "Rome", "1980", "Oils", "$5m", "Headquartered in Paris.")
    assert got["Bare"]["location"] is None and got["Bare"]["website"] == "https://bare.com"
    import json

    with open(log) as f:
        asked = [json.loads(line) for line in f]
    assert not any("COMPANY: Acme" in p for p in asked)  # full after its own site
    zed = [p for p in asked if "COMPANY: Zed" in p]
    assert all('FIELDS: ["Location"' not in p for p in zed) and any("FUNDS" in p for p in zed) and not any("three" in p for p in zed)
    assert "never read" not in str(asked)
    rules_only = {r["name"]: r["funding"] for r in flows.enrich_gaps(hits.select("name"), hits, pages).collect()}
    assert rules_only == {"Acme": "big", "Zed": None, "Bare": None}


def test_a_file_of_near_equal_names_keeps_the_first_of_each(spark, tmp_path):
    names = ["Acme Paints", "Bolt Coatings LLC", "Acme Paint", "Acme Paints, Inc.", "Nordic Resin", "Bolt Coating", "Nordic Resin LLC"]
    spark.createDataFrame(list(enumerate(names)), "pos long, `Company Name` string").write.parquet(str(tmp_path / "old"))
    flows.dedupe_file(spark, str(tmp_path / "old"), str(tmp_path / "fuzzy"))
    flows.dedupe_file(spark, str(tmp_path / "old"), str(tmp_path / "plain"), fuzzy=False)
    kept = [sorted(r.pos for r in spark.read.parquet(str(tmp_path / form)).collect()) for form in ("fuzzy", "plain")]
    # 3 has the letters of 0, and names of such a group are compared with no others, so 2 stays; 5 is near 1; 6 is 4 without its suffix
    assert kept == [[0, 1, 2, 4], [0, 1, 2, 3, 4, 5]]


def test_enrich_gaps_query_deals_its_narrow_rows_out(spark, monkeypatch):
    """One scan task has all customers; the pages made of them, which are sorted by task, lie in partitions of bounded size."""
    from sievework.catalog import modelled

    taken = {}
    monkeypatch.setattr(modelled.flows, "enrich_gaps", lambda companies, hits, pages, model: taken.update(hits=hits, pages=pages))
    customers = spark.range(600_000).coalesce(1).withColumnRenamed("id", "c_custkey")
    modelled.p02_gaps(lambda name, heavy=False: customers)
    for frame in taken.values():
        sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3_000_000 and max(sizes) < 55_000


def test_gaps_read_the_pages_a_fixed_number_of_times(spark):
    """One reading finds the profiles, one picks the pages of the hits; no source picks them anew."""
    rows = [(f"Firm{i}", f"https://firm{i}.com/about", f"<html><body><p>Located in City{i}.</p></body></html>") for i in range(4)]
    companies = spark.createDataFrame([(r[0],) for r in rows], "name string")
    hits = spark.createDataFrame([(name, 0, 1, "Hit", url, "") for name, url, _ in rows], "name string, query_no int, rank int, title string, url string, snippet string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pages = spark.createDataFrame([(url, html) for _, url, html in rows], "url string, html string").mapInArrow(counted, "url string, html string")
    got = flows.enrich_gaps(companies, hits, pages)
    assert sorted(r.website for r in got.collect()) == sorted(url for _, url, _ in rows)
    assert read.value == 2 * len(rows)
