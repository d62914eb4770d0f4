import pyarrow as pa
import pytest

from sievework.functions import markup
from sievework.operators import extract

LONG = "long text " * 15


@pytest.mark.parametrize(
    "html,want",
    [
        ("<body><nav>n</nav><p>a<p>b<script>x</script></body>", "a b"),
        ('<body><div class="Top-AD">x</div><div id="cookie-bar">y</div><p>keep</p></body>', "keep"),
        ("<body><!-- no --><p>one<br>two</body>", "one two"),
        (f'<body>out<div id="content">{LONG}</div></body>', LONG.strip()),
        ('<body>out<div id="content">short</div></body>', "out short"),
        ('<body>x<section class="post-a">small</section><div class="main">the larger one</div></body>', "the larger one"),
        ("<p>no body at all", "no body at all"),
        ('<body><div class="menu">only furniture</div></body>', "only furniture"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("", ""),
    ],
)
def test_html_to_text(html, want):
    assert markup.html_to_text(html).split() == want.split()


def test_markdown():
    html = '<h2>Head</h2><p>See <a href="/x">this <b>one</b></a><img src=i></p><ol><li>a<li>b</ol><table><tr><th>k<th>v<tr><td>1<td>2</table>'
    assert markup.html_to_markdown(html) == "## Head\n\nSee [this **one**](/x)\n\n1. a\n2. b\n\nk | v\n--- | ---\n1 | 2"


def page(title, comments):
    rows = "".join(f'<tr class="athing comtr"><td><div class="comment">{c}</div></td></tr>' for c in comments)
    return f"<html><head><title>{title}</title></head><body><table>{rows}</table></body></html>"


def test_forum_threads(spark):
    hiring = ["We are hiring a developer. " + "x " * 60, "too short hiring", "nothing of note here " * 10, "Apply now\nby  email " + "y " * 60]
    rows = [(1, page("Ask: Who is hiring?", hiring)), (2, page("Talk", [f"c{i}" for i in range(25)]))]
    df = spark.createDataFrame(rows, "id int, html string")
    got, whole = ({r["id"]: r["thread_text"] for r in extract.extract_forum_thread(df, "id", **limits).collect()} for limits in ({"jobs": 50, "talk": 20}, {}))
    assert whole[1] == got[1] and whole[2].split("\n\n---\n\n") == ["# Talk", *[f"c{i}" for i in range(25)]]
    jobs = got[1].split("\n\n---\n\n")
    assert len(jobs) == 2 and jobs[1].startswith("Apply now by email y y")
    assert got[2].split("\n\n---\n\n") == ["# Talk", *[f"c{i}" for i in range(20)]]


def test_sites_and_page_fields(spark):
    rows = [
        (1, "https://www.linkedin.com/company/x", '<h1 class="org-top-card-summary__title big"> X </h1><dd class="org-about-company-module__company-size-definition-text">5</dd>'),
        (2, "https://www.crunchbase.com/x", '<h1 class="profile-name">Y</h1><span class="funding-total">$1</span>'),
        (3, "https://any.org", "<title>T</title><div class='my-content'><p>a</p><p>b</p></div><p>out</p>"),
    ]
    df = spark.createDataFrame(rows, "id int, url string, html string")
    got = {r["id"]: (r["kind"], r["content"]) for r in extract.extract_by_site(df, "id").collect()}
    assert got == {
        1: ("linkedin", "Company Name: X\n\nDetails: 5"),
        2: ("crunchbase", "Company Name: Y\n\nFunding: $1"),
        3: ("generic", "Title: T\n\nContent: a\n\nb"),
    }
    html = f'<title>T</title><meta name="description" content="D"><div class="about-us">About {LONG}</div><p>body</p><a href="https://twitter.com/x">t</a>'
    df = spark.createDataFrame([(1, html), (2, "<p>tiny</p>")], "id int, html string")
    got = {r["id"]: r["page_text"] for r in extract.page_fields_text(df, "id", raw_below=100).collect()}
    assert got[1] == f"Title: T\n\nMeta Description: D\n\nAbout {LONG.strip()}\n\nbody\n\nSocial Media Link: https://twitter.com/x"
    assert got[2] == "<p>tiny</p>"


def test_a_short_page_stays_text_unless_asked(spark):
    df = spark.createDataFrame([(1, "<p>Short</p>")], "id int, html string")
    assert extract.page_fields_text(df, "id").first()["page_text"] == "Short\n"


@pytest.mark.parametrize("tag", ["div", "b", "span", "li"])
def test_pages_of_any_depth(tag):
    deep = f"<{tag}>" * 20_000
    marks = "**" * 20_000 if tag == "b" else ""
    assert markup.html_to_markdown(f"{deep}end") == f"{marks}end{marks}"
    assert markup.html_to_text(f"{deep}end").strip() == "end"
    markup.html_to_text(deep)


def test_marks_keep_their_text_together():
    html = "<p>One <b> two <i>three </i></b>four <a href='u'> five</a><br>six <img src=x><script>no</script></p>"
    assert markup.html_to_markdown(html) == "One **two _three_**four [five](u)\nsix"


def test_few_rows_of_a_large_batch_are_python_objects_at_once():
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "html": [None if n % 9 == 0 else "x" * n for n in range(1000)]})
    kind = pa.map_(pa.string(), pa.int64())
    made = list(markup.batches(lambda h: {"n": len(h or "")}, ["html"], "size", kind)([batch]))
    assert max(b.num_rows for b in made) <= 256 and made[0].schema.field("size").type == kind
    rows = [r for b in made for r in b.to_pylist()]
    assert rows == [{"id": n, "size": [("n", 0 if n % 9 == 0 else n)]} for n in range(1000)]
