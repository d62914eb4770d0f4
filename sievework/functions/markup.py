"""Arrow-batch HTML reading: a small element tree over the standard library parser.

Spark spreads the pages; each task only walks the pages of its own Arrow batches. Whatever
can be written as a column expression (links, titles, trimming, caps) is not in here.
"""

from __future__ import annotations

from collections import Counter, deque
from html.parser import HTMLParser

import pyarrow as pa

from sievework import rules

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
_SAME = {"li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
         "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
_BARRIER = set("table ul ol dl div section article main body html select".split())
_SILENT = {"script", "style", "template"}


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def classes(self) -> list[str]:
        whole = self.attrs.get("class") or ""
        return [whole, *whole.split()] if whole else []

    def walk(self):
        """Every element below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def strings(self):
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in _SILENT:
                stack.extend(reversed(node.children))

    def text(self, separator: str = "", stripped: bool = False) -> str:
        if stripped:
            return separator.join(s for s in (t.strip() for t in self.strings()) if s)
        return separator.join(self.strings())

    def find(self, tags=None, cls: str | None = None, has: list[str] | None = None):
        """Elements by tag, exact class, or a class that contains one of ``has``."""
        for node in self.walk():
            if tags is not None and node.tag not in tags:
                continue
            if cls is not None and cls not in node.classes():
                continue
            if has is not None and not any(w in c.lower() for c in node.classes() for w in has):
                continue
            yield node

    def first(self, *args, **kwargs):
        return next(self.find(*args, **kwargs), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]
        self.many: Counter = Counter()  # open elements by tag, so that deep pages aren't searched for what isn't there

    def _end(self, depth: int):
        self.many.subtract(e.tag for e in self.open[depth:])
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK and self.many["p"]:
            self._close({"p"})
        if tag in _SAME:
            self._close(_SAME[tag])
        node = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.many[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if not self.many[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self._end(depth)
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _close(self, tags: set[str]):
        if not any(self.many[t] for t in tags):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                self._end(depth)
                return
            if self.open[depth].tag in _BARRIER:
                return


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def prune(root: Element) -> Element:
    """Drop unwanted tags and elements whose class or id names furniture."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _unwanted(c)]
        stack.extend(c for c in node.children if isinstance(c, Element))
    return root


def _unwanted(node: Element) -> bool:
    if node.tag in rules.DROPPED_TAGS:
        return True
    marks = (node.attrs.get("class", "") + " " + node.attrs.get("id", "")).lower()
    return any(word in marks for word in rules.DROPPED_CLASS_WORDS)


def main_content(root: Element, separator: str = " ") -> str:
    """T04."""
    by_id: dict[str, Element] = {}
    for node in root.walk():
        by_id.setdefault(node.attrs.get("id", ""), node)
    for wanted in rules.CONTENT_IDS:
        node = by_id.get(wanted)
        if node is not None and len(node.text(stripped=True)) > 100:
            return node.text(separator, True)
    boxes = list(root.find(rules.CONTENT_TAGS, has=rules.CONTENT_CLASS_WORDS))
    if boxes:
        return max(boxes, key=lambda b: len(b.text())).text(separator, True)
    body = root.first(["body"])
    return (body or root).text(separator, True)


def html_to_text(html: str, separator: str = " ") -> str:
    """Pruned main content, else unpruned, else markdown, else all text."""
    text = main_content(prune(parse(html)), separator)
    if text.strip():
        return text
    whole = parse(html)
    return main_content(whole, separator).strip() or html_to_markdown(html).strip() or whole.text(separator, True)


def _trim(parts: deque) -> None:
    """Takes white space off both ends of a text in parts."""
    while parts and not parts[0].strip():
        parts.popleft()
    while parts and not parts[-1].strip():
        parts.pop()
    if parts:
        parts[0] = parts[0].lstrip()
        parts[-1] = parts[-1].rstrip()


def _inline(nodes: list) -> str:
    """Text of nodes with links and emphasis marked. Elements of any depth: own stack, and the shorter part is moved."""
    open_marks: list[tuple[str, str]] = []
    texts: list[deque] = [deque()]
    todo: list = list(reversed(nodes))
    while todo:
        node = todo.pop()
        if node is None:  # the end of a marked element
            before, after = open_marks.pop()
            inner, outer = texts.pop(), texts[-1]
            _trim(inner)
            inner.appendleft(before)
            inner.append(after)
            if len(inner) > len(outer):
                inner.extendleft(reversed(outer))
                texts[-1] = inner
            else:
                outer.extend(inner)
        elif isinstance(node, str):
            texts[-1].append(node)
        elif node.tag == "br":
            texts[-1].append("\n")
        elif node.tag not in _SILENT and node.tag != "img":
            mark = _MARKS.get(node.tag)
            if node.tag == "a" and node.attrs.get("href"):
                mark = ("[", f"]({node.attrs['href']})")
            if mark:
                open_marks.append(mark)
                texts.append(deque())
                todo.append(None)
            todo.extend(reversed(node.children))
    return "".join(texts[0])


_MARKS = {"b": ("**", "**"), "strong": ("**", "**"), "i": ("_", "_"), "em": ("_", "_")}


def _tidy(nodes: list) -> str:
    return "\n".join(" ".join(line.split()) for line in _inline(nodes).strip().split("\n"))


def _list_lines(box: Element) -> str:
    items = [c for c in box.children if isinstance(c, Element) and c.tag == "li"]
    return "\n".join((f"{n}. " if box.tag == "ol" else "* ") + _tidy(item.children) for n, item in enumerate(items, 1))


def _table_lines(box: Element) -> str:
    rows = [" | ".join(_tidy(c.children) for c in row.children if isinstance(c, Element)) for row in box.find(["tr"])]
    if len(rows) > 1:
        rows.insert(1, " | ".join(["---"] * (rows[0].count(" | ") + 1)))
    return "\n".join(rows)


def html_to_markdown(html: str) -> str:
    """Headings, lists, links and tables; images dropped; no wrapping. Pages of any depth."""
    out: list[str] = []
    frames: list[tuple] = [(iter(parse(html).children), [])]  # open blocks: what is left of each, and its run of inline nodes

    def flush(run: list):
        if run and (text := _tidy(run)):
            out.append(text)
        run.clear()

    while frames:
        children, run = frames[-1]
        child = next(children, None)
        tag = child.tag if isinstance(child, Element) else None
        if child is None:
            flush(run)
            frames.pop()
        elif tag in _SILENT or tag == "head":
            continue
        elif tag in ("ul", "ol"):
            flush(run)
            out.append(_list_lines(child))
        elif tag == "table":
            flush(run)
            out.append(_table_lines(child))
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            flush(run)
            out.append("#" * int(tag[1]) + " " + _tidy(child.children))
        elif tag in _BLOCK or tag in ("body", "html"):
            flush(run)
            frames.append((iter(child.children), []))
        else:
            run.append(child)
    return "\n\n".join(t for t in out if t.strip())


def forum_comments(html: str) -> list[str]:
    """Text of each comment of a forum thread, in page order; '' when a row has none."""
    rows = parse(html).find(["tr"], cls="athing comtr")
    boxes = (row.first(["div"], cls="comment") for row in rows)
    return [box.text("\n", True) if box is not None else "" for box in boxes]


def _one(root: Element, tag: str, cls: str | None = None) -> str:
    node = root.first([tag], cls=cls)
    return node.text().strip() if node is not None else ""


def site_fields(kind: str, html: str) -> dict[str, str]:
    """The labelled parts of a page, by kind of site; '' when missing."""
    root = parse(html)
    if kind == "linkedin":
        details = root.find(["dd"], cls="org-about-company-module__company-size-definition-text")
        return {
            "Company Name": _one(root, "h1", "org-top-card-summary__title"),
            "Description": _one(root, "p", "org-about-us-organization-description__text"),
            "Details": ", ".join(d.text().strip() for d in details),
        }
    if kind == "crunchbase":
        return {
            "Company Name": _one(root, "h1", "profile-name"),
            "Description": _one(root, "span", "description"),
            "Funding": _one(root, "span", "funding-total"),
        }
    if kind == "techcrunch":
        box = root.first(["div"], cls="article-content")
        paragraphs = [p.text().strip() for p in box.find(["p"])] if box is not None else []
        return {"Title": _one(root, "h1", "article__title"), "Content": "\n\n".join(paragraphs)}
    if kind == "forum":
        comments = [c.text().strip() for c in root.find(["div"], cls="comment")]
        return {"Title": _one(root, "title"), "Comments": "\n\n".join(c for c in comments if c)}
    boxes = list(root.find(["main", "article", "div"], has=rules.CONTENT_CLASS_WORDS[:3]))
    holder = max(boxes, key=lambda b: len(b.text())) if boxes else root
    return {
        "Title": _one(root, "title"),
        "Content": "\n\n".join(p.text().strip() for p in holder.find(["p"])),
    }


# page role -> tags whose text is collected, and whether "about" sections and social links are
PAGE_ROLES = {
    "website": (["p", "h1", "h2", "h3", "h4", "h5", "h6"], True),
    "linkedin": (["p", "div", "section", "article"], False),
    "crunchbase": (["p", "div", "section", "h1", "h2", "h3"], False),
    "search": (["p", "h1", "h2", "h3", "h4", "h5", "h6"], False),
}


def page_sections(role: str, html: str) -> dict[str, str]:
    """Title, descriptions, sections, body text and social links of a page."""
    tags, with_sections = PAGE_ROLES[role]
    root = parse(html)
    metas = list(root.find(["meta"]))

    def meta(attribute: str, value: str) -> str:
        return next((m.attrs.get("content", "") for m in metas if m.attrs.get(attribute) == value), "")

    out = {
        "title": (root.first(["title"]) or Element("", {})).text(),
        "description": meta("name", "description"),
        "og_description": meta("property", "og:description") if with_sections else "",
        "sections": "",
        "body": "\n".join(t for t in (n.text().strip() for n in root.find(tags)) if t),
        "social": "",
    }
    if with_sections:
        boxes = root.find(["section", "div"], has=["about", "company", "team", "contact"])
        out["sections"] = "\n\n".join(b.text().strip() for b in boxes)
        hosts = ["twitter.com", "facebook.com", "linkedin.com", "instagram.com", "youtube.com"]
        links = [a.attrs.get("href", "") for a in root.find(["a"])]
        out["social"] = "\n".join(
            f"Social Media Link: {h}" for h in links if any(host in h for host in hosts)
        )
    return out


#: Rows that are Python objects at once; an Arrow batch may have many more.
PIECE = 256


def batches(fn, inputs: list[str], output: str, kind: pa.DataType):
    """A ``mapInArrow`` body that adds ``output = fn(*inputs)``, of type ``kind``, and drops the inputs."""

    def run(whole):
        for batch in whole:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                values = [fn(*row) for row in zip(*(piece.column(c).to_pylist() for c in inputs))]
                if pa.types.is_map(kind):
                    values = [v if v is None else list(v.items()) for v in values]
                rest = [n for n in piece.schema.names if n not in inputs]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in rest), pa.array(values, kind)], [*rest, output])

    return run
