import pytest
from pyspark.sql import functions as F

from sievework.functions import fields as fld
from sievework.functions import parsing
from sievework.functions import text as tx
from sievework.operators import extract


def one(spark, value, rule):
    return spark.createDataFrame([(value,)], "v string").select(rule(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "rule,value,want",
    [
        (fld.company_name, "Acme Co Inc", "Acme"),
        (fld.company_name, "Acme Inc Co", "Acme Inc"),
        (fld.company_name, " Beta LLC. ", "Beta"),
        (fld.company_name, "Gamma s.a.", "Gamma s.a"),
        (fld.basic_clean_name, "'Delta'  P.L.C.", "Delta"),
        (fld.location, "HQ in Based in Oslo.,", "Based in Oslo"),
        (fld.location, "located in based in Oslo", "Oslo"),
        (fld.website, "Example.com", "https://example.com"),
        (fld.website, "http://example.com:80", None),
        (fld.website, "https://example.com?x=1", None),
        (fld.founders, "Founders: A and B & C.", "A, B, C"),
        (fld.funding, "Raised $5M.", "$5M"),
        (fld.description, "hello   World", "Hello World"),
        (fld.description, "ßa b", "ẞa b"),
        (fld.description, "ᾳ b", "ᾼ b"),
        (fld.description, "ﬁ b", "ﬁ b"),
        (fld.team_size, "11-50 people", "11-50"),
        (fld.team_size, "a Medium-sized small firm", "1-10"),
        (fld.team_size, "none", None),
        (fld.strip_query_marker, "12. robots", "robots"),
        (tx.normalize_query, "  Déjà-vu, C++! ", "déjà vu c"),
        (tx.clean_text, "a\n\n b c ", "a b c"),
        (tx.remove_emails, "mail a.b@c.org now", "mail  now"),
    ],
)
def test_rules(spark, rule, value, want):
    assert one(spark, value, rule) == want


@pytest.mark.parametrize("value,want", [("since 2031 or 1999", None), ("in 1999", 1999), ("12005", None)])
def test_year(spark, value, want):
    assert one(spark, value, lambda c: fld.founded_year(c, 2025)) == want


def test_social_media_last_url_and_wide_match(spark):
    got = one(spark, "https://x.com/a https://www.netflix.com/b https://youtube.com/c", fld.social_media)
    assert got == {"Twitter": "https://www.netflix.com/b", "YouTube": "https://youtube.com/c"}


def test_competitors(spark):
    assert one(spark, "Competitors: Acme Inc, Beta and Gamma | , Sandy", fld.competitors) == ["Acme", "Beta", "Gamma", "Sandy"]


@pytest.mark.parametrize(
    "answer,valid,json,error",
    [
        ('```json\n{"a": 1}\n```', True, '{"a":1}', None),
        ("```\n[]\n```", True, "[]", None),
        ('Sure: {"a": {"b": 2}} bye', True, '{"a":{"b":2}}', None),
        ('[{"a": 1}, 2]', False, None, "List response contains non-object items"),
        ("5", False, None, "Unexpected response type"),
        ("", False, None, "Empty response"),
        ("{broken", False, None, "JSON parsing error"),
    ],
)
def test_model_json(spark, answer, valid, json, error):
    df = spark.createDataFrame([(1, answer)], "id int, answer string")
    r = parsing.parse_model_json(df, "answer", ["id"]).first()
    assert (r["valid"], r["json"], r["error"]) == (valid, json, error)


def test_expansions_keep_the_original_first(spark):
    df = spark.createDataFrame([("AI startups", "1. ai STARTUPS\n2. ml firms\n- ml firms\n* robots\n\nbots")], "q string, a string")
    for n in (1, 3, 5, 10, 20):
        got = df.select(parsing.parse_query_expansions(F.col("q"), F.col("a"), n)).first()[0]
        assert got == ["AI startups", "ml firms", "robots", "bots"][: n + 1]


def test_mention_context(spark):
    text = "x" * 150 + "\n" + "a" * 250 + " Acme makes coats. " + "b" * 400
    pages = spark.createDataFrame([("u", text)], "url string, content string")
    mentions = spark.createDataFrame([("acme", "u"), ("Share", "u"), ("zzz", "u")], "name string, url string")
    rows = extract.mention_context(mentions, pages).collect()
    assert [r["name"] for r in rows] == ["acme"]
    context = rows[0]["context"]
    assert context.startswith("a" * 250 + " **Acme** makes") and context.endswith("b") and "x" not in context
    assert len(context) == 251 + 8 + (200 + 100)


def test_has_keyword_agrees_with_the_list(spark):
    texts = ["", "a of the", "ab cd", "the_x", "these and THOSE!", "about abouts", "x-ray", "naïve", "in into, 123", "12 of", "é è à", "thé the"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", tx.has_keyword(F.col("t")).alias("a"), (F.size(tx.extract_keywords(F.col("t"))) > 0).alias("b")).collect()
    assert [(r["t"], r["a"]) for r in rows] == [(r["t"], r["b"]) for r in rows]
