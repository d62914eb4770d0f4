"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sievework.llm.common import named, pieces, renamed
from sievework.llm.crf import Chain, best_paths, train

FEATURES = 1 << 15
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)[^>]*>?""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements that start and end a block, that never hold anything, that hold no text of a page, and whose content is no markup.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("button canvas head iframe math noscript object option script select style svg template textarea title audio video map datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Silent elements that a new one of the same name ends.
ALONE = frozenset("button option select".split())
#: What can be in a head; any other element ends one that is left open.
HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: What a new element closes, if it is open inside of the second set.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Elements and names that mark what is not the article, in pages whose markup says where the article is.
OUTSIDE_TAGS = frozenset("aside footer form header nav".split())
MEANING = OUTSIDE_TAGS | {"article", "main"}
OUTSIDE_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie footer header menu nav navigation newsletter notice promo related replies share sidebar social sponsored subscribe widget".split()
)


def feature(name: str, known: dict[str, int] = {}) -> int:  # noqa: B006  remembered in the worker
    found = known.get(name)
    if found is None:
        if len(known) > 200_000:
            known.clear()
        found = known[name] = zlib.crc32(name.encode("utf-8", "replace")) % FEATURES
    return found


class Block:
    """Text of a leaf block with white space turned into one space, features of its ancestors and of its parent,
    the names of its ancestors, and how much of it is in links."""

    __slots__ = ("text", "above", "parent", "names", "linked")

    def __init__(self, text: str, above: list[int], parent: str, names: frozenset[str], linked: int):
        self.text, self.above, self.parent, self.names, self.linked = text, above, parent, names, linked


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order. Elements that are not closed end where browsers end them, roughly; nothing fails.

    What stands in a button, select, object and the like is no text of the page, a button inside of a sentence included. One that
    is never closed, or not before the next one of its kind, doesn't silence what follows.
    """
    found: list[Block] = []
    unclosed: set[str] = set()

    def silences(name: str) -> bool:
        if name not in SILENT or name in unclosed:
            return False
        if name == "head":
            return True
        m = re.compile(f"<(/?){name}\\b" if name in ALONE else f"<(/){name}\\b", re.I).search(page, at)
        if m is None:
            unclosed.add(name)
        return m is not None and bool(m.group(1))

    # (tag, features, names, silent, in a link, features of the innermost element that has a name or a meaning)
    stack: list[tuple[str, list[int], frozenset[str], bool, bool, list[int]]] = [("", [], frozenset(), False, False, [])]
    text: list[str] = []
    linked, at, parent = 0, 0, stack[0]

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                found.append(Block(line, parent[1] + parent[5], parent[0], parent[2], linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked, parent
        top = stack[-1]
        if piece and not top[3]:
            if not text:
                parent = next(x for x in reversed(stack) if x[0] in BLOCK or not x[0])
            text.append(piece)
            if top[4]:
                linked += len(piece)

    for m in iter(lambda: TOKEN.search(page, at), None):
        add(page[at : m.start()])
        at = m.end()
        closing, name, attributes = m.group(1), m.group(2), m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        if not closing and stack[-1][0] == "head" and name not in HEAD:
            stack.pop()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
        if name in BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block starts
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in CLOSES:
            closes, within = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in within:
                    break
        top = stack[-1]
        own = {w.lower() for n in NAMES.finditer(attributes) for w in PARTS.findall(n.group(1) or n.group(2) or n.group(3) or "")} if attributes.strip() else ()
        ids, near = top[1], top[5]
        if name in BLOCK or own:
            ids = [*ids, feature(f"tag {name}"), *[feature(f"name {w}") for w in sorted(own)]]
        if own or name in MEANING:
            near = [feature(f"near {w}") for w in ([name] if name in MEANING else []) + sorted(own)] * 2
        stack.append((name, ids, top[2] | {name} | {f".{w}" for w in own}, top[3] or silences(name), top[4] or name == "a", near))
    add(page[at:])
    flush()
    return found


def block_features(blocks: list[Block]) -> list[list[int]]:
    """Feature ids of each block: ancestors' tags and names, parent, and what the text looks like."""
    made, n = [], len(blocks)
    for i, b in enumerate(blocks):
        t = b.text
        words = t.count(" ") + 1
        size = f"{min(9, words.bit_length())}"
        links = f"{min(4, 5 * b.linked // max(1, len(t)))}"
        ids = [
            *b.above, feature("bias"), feature(f"parent {b.parent}"), feature(f"words {size}"), feature(f"links {links}"), feature(f"parent {b.parent} words {size}"),
            feature(f"links {links} words {size}"), feature(f"end {t[-1] if t[-1] in '.!?:…' else ''}"), feature(f"stops {min(3, 10 * (t.count('. ') + t.count(', ')) // words)}"),
            feature(f"place {5 * i // n}"), feature(f"caps {4 * sum(map(str.isupper, t[:80])) // max(1, len(t[:80]))}"),
        ]
        if "©" in t[:40]:
            ids.append(feature("copyright"))
        if words <= 12:
            ids.extend(feature(f"word {w}") for w in set(t.lower().split()))
        made.append(ids)
    return made


def marked(block: Block) -> bool:
    """Whether the page's own markup says that the block is of the article."""
    names = block.names
    return ("article" in names or "main" in names) and not names & OUTSIDE_TAGS and not any(n[1:] in OUTSIDE_NAMES for n in names if n[0] == ".")


def labelled_page(texts: list[str], foreign: list[str], r: random.Random) -> tuple[str, list[int]]:
    """A page made of an article's blocks and other text, in markup of one of many habits, with 1 for each block of the article."""
    page, labels = [], []

    def put(markup: str, *inside: tuple[str, str], article: bool = False) -> None:
        tag, _, rest = markup.partition(" ")
        page.append(f"<{markup}>" + "".join(f"<{t}>{html.escape(x)}</{t.split()[0]}>" for t, x in inside) + f"</{tag}>")
        labels.extend([int(article)] * sum(bool(x.split()) for _, x in inside))

    def some(n: int, most: int = 4) -> list[str]:
        return [" ".join(r.choice(foreign).split()[: r.randint(1, most)]) for _ in range(n)]

    def line(most: int = 30) -> str:
        return " ".join(r.choice(foreign).split()[:most])

    def named_div(*names: str) -> str:
        return f'{r.choice(["div", "div", "section", "ul"])} {r.choice(["class", "id"])}="{r.choice(["", "site-", "main-", "page-"])}{r.choice(names)}{r.choice(["", "-box", " wide", "_1"])}"'

    def menu() -> None:
        links = [("li", x) for x in some(r.randint(3, 8))]
        put(r.choice(["nav", "ul class=menu", named_div("menu", "nav", "navbar", "breadcrumbs")]), *links)

    def banner() -> None:
        put(r.choice(["header", named_div("header", "masthead", "top", "branding")]), (r.choice(["h1", "p", "div"]), line(6)), *[("p", line(9))] * r.randint(0, 1))

    def aside() -> None:
        put(r.choice(["aside", named_div("sidebar", "related", "widget", "rail", "popular")]), ("h3", line(4)), *[(r.choice(["p", "li"]), line(r.choice([5, 25]))) for _ in range(r.randint(1, 5))])

    def notice() -> None:
        put(named_div("cookie", "notice", "consent", "alert", "gdpr", "banner", "popup"), ("p", r.choice(["We use cookies. ", "This site uses cookies. ", "Notice: ", "", ""]) + line(20)))

    def advert() -> None:
        put(named_div("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor"), (r.choice(["p", "div", "span"]), line(r.choice([6, 25]))))

    def form() -> None:
        put(r.choice(["form", 'form class="newsletter"', 'form id="search"', 'form class="subscribe"']), ("label", line(5)), *[("p", line(15))] * r.randint(0, 2))
        # label is inline: it runs into nothing else, as what follows is a block

    def comments() -> None:
        put(named_div("comments", "comment-list", "responses", "replies", "discussion", "reader-comments"), ("h3", r.choice(["Comments", "Responses", line(3)])), *[(r.choice(["p", "li", "div class=comment"]), line(60)) for _ in range(r.randint(1, 6))])

    def share() -> None:
        put(named_div("share", "social", "tags", "meta", "byline"), *[("li", x) for x in some(r.randint(1, 4), 2)])

    def foot() -> None:
        put(r.choice(["footer", "footer", named_div("footer", "bottom", "copyright", "legal")]), ("p", r.choice(["© ", "Copyright ", ""]) + line(15)))

    busy = r.choice([0.0, 0.5, 1.0, 1.0, 1.0])  # some pages are the article and little else
    for part, chance in ((banner, 0.5), (menu, 0.8), (notice, 0.4), (advert, 0.5), (aside, 0.2)):
        if r.random() < chance * busy:
            part()
    container = r.choice(["article", "article", "main", "div class=post", "div class=entry-content", 'div id="content"', "div class=story-body", "section class=article-text", "td", "div", "", 'div class="article-body"'])
    page.append(f"<{container}>" if container else "")
    inner = [x for x in (advert, aside, share, form, notice) if r.random() < 0.12 * busy]
    for k, text in enumerate(texts):
        if k and inner and r.random() < 0.3:
            inner.pop()()
        tag = r.choice(["h1", "h1", "h2", "p"]) if not k else r.choice(["p"] * 8 + ["li", "li", "h2", "blockquote", "div"])
        page.append(f"<{tag}>{html.escape(text)}</{tag}>")
        labels.append(1)
    if r.random() < 0.25 * busy:
        comments()
    page.append(f"</{container.split()[0]}>" if container else "")
    for part, chance in ((share, 0.3), (comments, 0.5), (form, 0.4), (aside, 0.5), (advert, 0.3), (menu, 0.2), (foot, 0.8), (notice, 0.15)):
        if r.random() < chance * busy:
            part()
    return "<html><head><title>x</title></head><body>" + "".join(page) + "</body></html>", labels


def fit(pages: DataFrame, *, page_id: str = "page_id", text: str = "html", most: int = 250, copies: int = 6, rounds: int = 60, signs: int = 1 << 18, blocks: int = 400, article_blocks: int = 40) -> Chain:
    """A model from about ``most`` pages, picked by a hash, whose own markup says where the article is.

    Each of them is learned as it is and, ``copies`` times, with its article's blocks put into markup of other habits
    between menus, headers, footers, sidebars, notices, adverts, forms and comments, whose words come from other
    pages. Pages without such markup teach nothing; without any page a few built-in words are used. The sample is
    bounded: of a picked page with over ``signs`` signs both ends are read, as many blocks as ``blocks`` are learned from, half of
    them from its end, and ``article_blocks`` of its article, spread over all of it.
    """
    half = signs // 2
    ends = F.concat(F.substring("t", 1, half), F.right("t", F.lit(half)))

    def spread(items: list, most: int) -> list:
        return items if len(items) <= most else [items[i * len(items) // most] for i in range(most)]

    def both_ends(items: list) -> list:
        return items if len(items) <= blocks else items[: blocks // 2] + items[-(blocks // 2) :]

    rows = pages.select(named(page_id).alias("k"), named(text).alias("t")).filter("t is not null")
    n = rows.count()
    picked = rows.filter(F.pmod(F.xxhash64("k", F.octet_length("t"), F.lit(5)), F.lit(1 << 40)) < int(min(1.0, most / max(1, n)) * (1 << 40)))
    pages_read = sorted(r.t for r in picked.select(F.when(F.length("t") > signs, ends).otherwise(F.col("t")).alias("t")).limit(4 * most).collect())
    r = random.Random(11)
    parsed = [b for b in (blocks_of(t) for t in pages_read) if b]
    articles = [[x.text for x in b if marked(x)] for b in parsed]
    articles = [spread(a, article_blocks) for a in articles if a] or [["A short title", "Some words of a text that goes on for a while, with a stop at the end."]]
    foreign = [t for a in articles for t in a if t.strip()]
    sequences, labels = [], []
    for b in parsed:
        if any(marked(x) for x in b):
            sequences.append(both_ends(b))
            labels.append([int(marked(x)) for x in sequences[-1]])
    for a in articles:
        for _ in range(copies):
            page, own = labelled_page(r.choice([a, a[:1] + r.sample(a[1:], min(len(a) - 1, r.randint(1, 8)))]), foreign, r)
            made = blocks_of(page)
            if len(made) == len(own):
                sequences.append(made)
                labels.append(own)
    lists = [f for s in sequences for f in block_features(s)]
    ids, owner = np.concatenate([np.array(x) for x in lists]), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return train(ids, owner, np.array([k for own in labels for k in own]), np.array([len(s) for s in sequences]), FEATURES, 2, rounds)


def extract_pages(found: list[str], model: Chain) -> list[tuple[str, int, int]]:
    """(main text, blocks kept, blocks) of each page."""
    parsed = [blocks_of(t) for t in found]
    lengths = np.array([len(b) for b in parsed], np.int64)
    if not lengths.sum():
        return [("", 0, 0) for _ in found]
    lists = [f for b in parsed for f in block_features(b)]
    sizes = [len(x) for x in lists]
    ids = np.fromiter((i for x in lists for i in x), np.int64, sum(sizes))
    scores = model.scores(ids, np.repeat(np.arange(len(lists)), sizes), len(lists))
    best = best_paths(model, scores, lengths)
    out, at = [], 0
    for b in parsed:
        kept = [x.text for x, k in zip(b, best[at : at + len(b)]) if k]
        out.append((" ".join(kept), len(kept), len(b)))
        at += len(b)
    return out


def main_text(pages: DataFrame, model: Chain, *, html_column: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: all columns but the html) with text, n_chars (code points), n_kept and n_blocks.

    Blocks that Viterbi labels as the article, joined in page order by one space; character references are decoded and
    white space inside a block is one space. Null, empty and block-less pages give an empty text. Whole pages are
    read, in Arrow batches cut by bytes; repeated rows are read each; an empty table gives no rows.
    """
    kept = [c for c in pages.columns if c != html_column] if carry is None else carry
    rows = pages.select(*[named(c).alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(named(html_column), F.lit("")).alias("html"))
    own = rows.schema.fields[: len(kept)]
    names = [f.name for f in own] + ["text", "n_chars", "n_kept", "n_blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html", 2 << 20):
            made = extract_pages(part.column("html").to_pylist(), model)
            columns = [pa.array([x[0] for x in made], pa.string()), pa.array([len(x[0]) for x in made], pa.int64())] + [pa.array([x[k] for x in made], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], names=names)

    schema = StructType([*own, StructField("text", StringType()), *[StructField(c, LongType()) for c in names[-3:]]])
    return rows.mapInArrow(run, schema).select(*renamed(kept, names[len(kept) :]), *names[len(kept) :])
