"""Main text of web pages by equivalence-class template deduction.

A page is a stream of tokens: opening tags with their path, and blocks of text
with their path.  Tokens of a host whose occurrence vectors over its distinct
pages (how often on each page) are the same form an equivalence class (after
EXALG, Arasu and Garcia-Molina 2003).  A class is valid if it is large, lies on
most pages, and is ordered and nested: on most pages its occurrences repeat one
sequence, and the first of them stands in the same gap of the host's root class
(the one on most pages with most tokens).  Root class and nested classes are the
host's template.

What the template does not hold fills its slots; a slot is named by the nearest
template tag above.  The main text is what fills the slots, apart from

* text tokens of valid classes, wherever they stand: a notice on every page goes
  out of an article too, unless nothing would be left of the article;
* slots outside articles that hold links for the most part, over all pages;
* regions that a page marks as menu, header, footer, sidebar, notice, advert,
  form or comments: content that changes from page to page like the text itself,
  so that only its mark tells;
* what stands outside the article, on a page that has one.

Below ``least_pages`` distinct pages a host has no occurrence vectors that tell
template from text; there marks decide, and list items of links alone go.

Spark plan
----------
Three narrow passes over whole pages; html is never exchanged while the copies
of pages and the templates are within ``most_broadcast`` bytes as measured,
beyond that pages meet them by (host, salt) with salts by the host's bytes.
An occurrence vector is known by a fingerprint: the XOR over distinct pages of
hash(page, count).  Fingerprints, order counts and slot sizes are combined in
the task and then with map-side aggregation, so neither a host with a third of
all pages nor its tokens are gathered anywhere.  Only classes on most pages are
listed by host; their number is bounded by the tokens of a page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

# Element names of HTML, and common names of regions that are not main text.
_RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_DROPPED = set("head nav footer aside form button select textarea iframe object svg math template dialog menu canvas audio video datalist".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"table", "ul", "ol", "dl", "html", "body", "article", "main", "section", "div", "td", "th"}
#: Elements whose class can mark a region inside an article; a paragraph or heading there is text whatever its class.
_CONTAINER = {"div", "section", "ul", "ol", "dl", "table", "span"}
_REGION = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification notifications pager pagination popup promo promos promotion "
    "replies respond sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets contentinfo complementary share sharing".split()
)
#: Names of regions only where they are a whole class, id or role: as parts of other names they mean other things.
_REGION_ALONE = {"alert", "feedback", "hidden", "recommended", "recommendations", "related", "reply", "review", "reviews", "search", "side"}
#: First words of names that tell of the layout around a region.
_LAYOUT = {"no", "with", "without", "has", "is", "overflow"}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]++)*+)>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">]++)*+")
#: As deep as browsers nest elements; deeper ones count as part of the innermost.
_DEPTH = 512


def _mark(value: str, article: bool) -> int:
    """2 if a whole token of a class, id or role names a region, 1 if the first or last word of a compound token does, else 0.
    Inside an article a header is no region."""
    found = 0
    for token in value.lower().split():
        if token in _REGION or token in _REGION_ALONE:
            found = max(found, 0 if article and token == "header" else 2)
            continue
        words = [w for w in re.split("[_-]+", token) if w]
        if len(words) > 1 and words[0] not in _LAYOUT and any(w in _REGION and not (article and w == "header") for w in (words[0], words[-1])):
            found = max(found, 1)
    return found


@lru_cache(1 << 16)
def _opened(name: str, rest: str) -> tuple[str, bool, bool, int, int, bool]:
    """Of an opening tag: its label in a path, whether it is the main text's, hidden, the mark outside and inside an article, and whether it has no content."""
    attributes = {a.lower(): (v or "").strip("\"'") for a, v in _ATTRIBUTE.findall(rest)}
    label = name + ("." + attributes["class"] if attributes.get("class") else "") + ("#" + attributes["id"] if attributes.get("id") else "")
    main = name in ("article", "main") or attributes.get("role") == "main"
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
    marks = [max(_mark(attributes.get(a, ""), article) for a in ("class", "id", "role")) for article in (False, True)]
    return label, main, hidden, *marks, name in _VOID or rest.endswith("/") and name not in _BLOCK


@lru_cache(1 << 17)
def _path(parent: int, label: str) -> int:
    return _hash(parent, label)


def _hash(parent: int, token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


class Node:
    """An open element: its path as a hash, what encloses it, and the regions it lies in."""

    __slots__ = ("name", "path", "parent", "block", "article", "dropped", "link", "item")

    def __init__(self, name: str, parent: Node | None, path: int, article: bool, dropped: int):
        self.name, self.parent, self.path, self.article, self.dropped = name, parent, path, article, dropped
        self.block = self if name in _BLOCK or parent is None else parent.block
        self.link = name == "a" or parent is not None and parent.link
        self.item = name == "li" or parent is not None and parent.item


class Block:
    """A run of text between block tags: the innermost block element, and how many of its characters are links."""

    __slots__ = ("node", "text", "dropped", "links", "token")

    def __init__(self, node: Node, text: str, dropped: bool, links: int):
        self.node, self.text, self.dropped, self.links = node, text, dropped, links
        self.token = _hash(node.path, f"\0{text}")

    @property
    def article(self) -> bool:
        return self.node.article


class Page:
    """The text blocks of a page in order, and its tokens in order: paths of tags, and blocks."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.tokens: list[int] = []
        self.tags: set[int] = set()


def parse(page: str) -> Page:
    out, root = Page(), Node("", None, 0, False, 0)
    stack, names = [root], Counter()  # open elements, and how many of each name
    text: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined:
            block = Block(stack[-1].block, joined, bool(stack[-1].dropped), min(links, len(joined)))
            out.blocks.append(block)
            out.tokens.append(block.token)
        text.clear()
        links = 0

    def shut(k: int) -> None:
        for node in stack[k:]:
            names[node.name] -= 1
        del stack[k:]

    def close(some: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in some:
                flush()
                shut(k)
                return
            if stack[k].name in stop:
                return

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt != at:
            lt = end if lt < 0 else lt
            top = stack[-1]
            if not top.dropped:
                piece = page[at:lt]
                piece = entities.unescape(piece) if "&" in piece else piece
                text.append(piece)
                if top.link:
                    links += len(piece)
            at = lt
            continue
        m = _TAG.match(page, at)
        if m:
            closing, name, rest = m[1], m[2].lower(), m[3]
            at = m.end()
        elif page[at + 1 : at + 2] in ("!", "?"):
            opening, ending = next(((o, e) for o, e in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(o, at)), ("<!", ">"))
            shut_at = page.find(ending, at + (4 if ending == "-->" else 0))
            if ending == "]]>" and not stack[-1].dropped:
                text.append(page[at + 9 : end if shut_at < 0 else shut_at])
            at = end if shut_at < 0 else shut_at + len(ending)
            continue
        else:
            m = _NAME.match(page, at)
            if not m:
                if not stack[-1].dropped:
                    text.append("<")
                at += 1
                continue
            inside = page.find(">", _INSIDE.match(page, m.end()).end())  # beyond a quote without a partner
            if inside < 0:
                break  # the page ends within a tag
            closing, name, rest = page[at + 1] == "/", m[1].lower(), page[m.end() : inside]
            at = inside + 1
        if closing:
            if name == "p" and not names["p"]:
                flush()
            if not names[name]:
                continue
            if name in _BLOCK:
                close({name}, set())
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    if stack[k].dropped and not stack[k - 1].dropped:
                        text.append(" ")
                    names[name] -= 1
                    del stack[k]
                    break
                if stack[k].name in _BLOCK:
                    break
            continue
        if name in _BLOCK:
            flush()
            if names["p"]:
                close({"p"}, _SCOPE)
            if name in _CLOSES and any(names[n] for n in _CLOSES[name]):
                close(_CLOSES[name], {"table", "ul", "ol", "dl"} if name != "option" else {"select"})
        label, main, hidden, outside, within, empty = _opened(name, rest)
        top = stack[-1]
        path = _path(top.path, label)
        out.tokens.append(path)
        out.tags.add(path)
        if name in ("br", "hr"):
            text.append(" ")
        if empty:
            continue
        dropped = 0 if top.dropped == 1 and main else top.dropped  # a compound mark around an article tells of the layout
        if name in _DROPPED or name in _RAW or (name == "header" and not top.article):
            dropped = 2
        elif name not in ("html", "body", "article", "main"):
            if hidden:
                dropped = 2
            elif not top.article:
                dropped = max(dropped, outside)
            elif name in _CONTAINER:
                dropped = max(dropped, within)
        if name in _RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if len(stack) < _DEPTH:
            stack.append(Node(name, top, path, top.article or main, dropped))
            names[name] += 1
    flush()
    return out


_VECTOR = pa.schema([("host", pa.string()), ("token", pa.int64()), ("pages", pa.int64()), ("vector", pa.int64())])
_PAGE = _hash(0, "the page itself")


def _tokens(flush_at: int = 200_000):
    """Occurrence vectors of the tokens of distinct pages, as sums and XORs."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def rows() -> pa.RecordBatch:
            out = [(h, t, v[0], v[1] - (1 << 63)) for (h, t), v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _VECTOR, strict=True)], schema=_VECTOR)

        for table in tables:
            for host, digest, page in zip(table.column("host").to_pylist(), table.column("digest").to_pylist(), table.column("html"), strict=True):
                counts = Counter(parse(page.as_py() or "").tokens)
                counts[_PAGE] = 1  # on every page: how many distinct pages the host has
                marks = {n: xxhash.xxh64_intdigest(f"{digest}:{n}") for n in set(counts.values())}
                for token, n in counts.items():
                    cell = held.setdefault((host, token), [0, 0])
                    cell[0] += 1
                    cell[1] ^= marks[n]
                if len(held) >= flush_at:
                    yield rows()
        if held:
            yield rows()

    return run


def sequence_of(occurrences: list[int], gap: int) -> int:
    """One number for an ordered class on a page: the sequence that its occurrences repeat and the gap of the first; 0 if they repeat none."""
    size = len(set(occurrences))
    once = occurrences[:size]
    if len(set(once)) < size or any(t != once[k % size] for k, t in enumerate(occurrences)):
        return 0
    return _hash(gap, " ".join(map(str, once))) or 1


_SEEN = pa.schema([("host", pa.string()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])
_ORDER, _SLOT = 0, 1


def slot_of(node: Node, known: set[int]) -> int:
    """The path of the nearest template tag that holds the node."""
    while node.parent is not None and node.path not in known:
        node = node.parent
    return node.path


def _arrange(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Order of the classes of each host on its pages, and text and links by slot."""
    held: dict[tuple, list[int]] = {}
    for table in tables:
        for host, page, classes in zip(table.column("host").to_pylist(), table.column("html"), table.column("classes").to_pylist(), strict=True):
            if not classes:
                continue
            parsed = parse(page.as_py() or "")
            root = max(classes, key=lambda c: (c["pages"], len(c["members"]), c["class"]))["class"]
            of = {t: c["class"] for c in classes for t in c["members"]}
            found: dict[int, list[int]] = {}
            gaps: dict[int, int] = {}
            for token in parsed.tokens:
                name = of.get(token)
                if name is not None:
                    gaps.setdefault(name, len(found.get(root, ())))
                    found.setdefault(name, []).append(token)
            for name, occurrences in found.items():
                held.setdefault((host, _ORDER, name, sequence_of(occurrences, 0 if name == root else gaps[name])), [0, 0])[0] += 1
            for block in parsed.blocks:
                if not block.dropped and not block.article and block.token not in of:
                    cell = held.setdefault((host, _SLOT, slot_of(block.node, of.keys()), 0), [0, 0])
                    cell[0] += len(block.text)
                    cell[1] += block.links
    out = [(*k, *v) for k, v in held.items()]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SEEN, strict=True)], schema=_SEEN)


def main_text(page: Page, template: set[int] | None, linked: set[int]) -> list[str]:
    """The blocks that fill the main slots of a page."""
    known = template or set()
    slots = [b for b in page.blocks if not b.dropped]
    if any(b.article for b in slots):
        inside = [b for b in slots if b.article]
        slots = [b for b in inside if b.token not in known] or inside
    elif template is not None:
        slots = [b for b in slots if b.token not in known and slot_of(b.node, known) not in linked]
    else:
        slots = [b for b in slots if not (b.links == len(b.text) and b.node.item)]
    return [b.text for b in slots]


def _extract(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        texts, fixed = [], []
        for page, template, linked in zip(table.column("html"), table.column("template").to_pylist(), table.column("linked").to_pylist(), strict=True):
            parsed, known = parse(page.as_py() or ""), None if template is None else set(template)
            texts.append("\n".join(main_text(parsed, known, set(linked or ()))))
            fixed.append(sum(t in parsed.tags and t in (known or ()) for t in parsed.tokens))
        keep = [n for n in table.schema.names if n not in ("html", "template", "linked")]
        yield pa.RecordBatch.from_arrays([*(table.column(n) for n in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(fixed, pa.int64())], names=[*keep, "text", "n_chars", "template_tags"])


def _by_host(pages: DataFrame, lists: DataFrame, most_broadcast: int, how: str = "left") -> DataFrame:
    """``pages`` with the one row of ``lists`` for their host; lists are broadcast or met by (host, salt), as measured."""
    size = [F.size(c) for c, t in lists.dtypes if t.startswith("array<bigint")] + [F.aggregate(c, F.lit(0), lambda a, x: a + F.size(x["members"]) + 4) for c, t in lists.dtypes if t.startswith("array<struct")]
    if (lists.agg(F.sum(8 * sum(size, F.lit(8)))).first()[0] or 0) <= most_broadcast:
        return pages.join(F.broadcast(lists), "host", how)
    salts = pages.groupBy("host").agg((1 + F.sum(F.octet_length("html")) / (64 << 20)).cast("int").alias("salts"))
    many = Workspace(pages.sparkSession, "pages").table("salts", salts.filter("salts > 1"))  # hosts of 64 MB or more
    spread = lists.join(many, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    salted = pages.join(F.broadcast(many), "host", "left").withColumn("salt", F.pmod(F.xxhash64("html"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return salted.join(spread, ["host", "salt"], how).drop("salt")


def _distinct_pages(pages: DataFrame, work: Workspace, most_broadcast: int) -> DataFrame:
    """One of each (host, digest); only pages that have copies are exchanged while their digests are few."""
    copied = work.table("copied", pages.groupBy("host", "digest").count().filter("count > 1").select("host", "digest"))
    if copied.count() * 128 > most_broadcast:
        return pages.dropDuplicates(["host", "digest"])
    some = pages.join(F.broadcast(copied), ["host", "digest"], "left_semi").dropDuplicates(["host", "digest"])
    return pages.join(F.broadcast(copied), ["host", "digest"], "left_anti").unionByName(some)


def deduce_templates(pages: DataFrame, *, least_pages: int = 3, share: float = 0.8, least_class: int = 2, most_broadcast: int = 16 << 20) -> DataFrame:
    """(host, template, linked) for ``pages`` (host, html): the tokens of the host's valid classes, and the paths of
    slots that hold links for the most part.

    A class is the tokens with one occurrence vector over the host's distinct pages, ``least_pages`` or more.
    It is valid if it has ``least_class`` tokens or more, lies on ``share`` of the pages, and is ordered and
    nested alike on ``share`` of those.
    """
    work = Workspace(pages.sparkSession, "pages")
    read = pages.filter("html is not null").select("host", "html", F.md5("html").alias("digest"))
    found = _distinct_pages(read, work, most_broadcast).mapInArrow(_tokens(), "host string, token long, pages long, vector long")
    tokens = found.withColumn("vector", F.col("vector").bitwiseXOR(F.lit(-(1 << 63)))).groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.expr("bit_xor(vector)").alias("vector"))
    tokens = work.table("tokens", tokens.filter(F.col("pages") > 1))
    size = tokens.filter(F.col("token") == _PAGE).select("host", F.col("pages").alias("all_pages"))
    often = tokens.filter(F.col("token") != _PAGE).join(size, "host").filter((F.col("all_pages") >= least_pages) & (F.col("pages") >= share * F.col("all_pages")))
    classes = often.groupBy("host", F.col("vector").alias("class")).agg(F.max("pages").alias("pages"), F.collect_list("token").alias("members")).filter(F.size("members") >= least_class)
    classes = work.table("classes", classes)
    listed = work.table("listed", classes.groupBy("host").agg(F.collect_list(F.struct("class", "pages", "members")).alias("classes")))
    seen = _by_host(read.select("host", "html"), listed, most_broadcast, "inner").mapInArrow(_arrange, "host string, kind int, a long, b long, n long, m long")
    seen = work.table("seen", seen.groupBy("host", "kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    order = seen.filter(F.col("kind") == _ORDER).groupBy("host", F.col("a").alias("class")).agg(F.sum("n").alias("all"), F.max(F.when(F.col("b") != 0, F.col("n"))).alias("most"))
    valid = classes.join(order.filter(F.col("most") >= share * F.col("all")), ["host", "class"], "left_semi")
    linked = seen.filter((F.col("kind") == _SLOT) & (2 * F.col("m") >= F.col("n"))).groupBy("host").agg(F.collect_list("a").alias("linked"))
    template = valid.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("template"))
    return work.table("templates", template.join(linked, "host", "left").select("host", "template", F.coalesce("linked", F.array().cast("array<bigint>")).alias("linked")))


def extract_text(pages: DataFrame, *, most_broadcast: int = 16 << 20, **options) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html).

    Results: page_id, url, text (blocks in page order, joined by a line feed), n_chars, and
    template_tags (tags that the host's template holds).

    A null or empty html gives an empty text.  Broken markup is read as browsers do where it is
    common: unclosed paragraphs, list items and cells end where the next begins, an unclosed script,
    comment or tag runs to the end.  The host is that of the url, in lower case; a null or relative
    url belongs to the empty host.  Repeated pages count once for the template and are answered each.
    Other columns are ignored.  An empty table gives no rows.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    source = pages.select("page_id", "url", "html", host.alias("host"))
    templates = deduce_templates(source, most_broadcast=most_broadcast, **options)
    met = _by_host(source, templates, most_broadcast)
    return met.select("page_id", "url", "html", "template", "linked").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, template_tags long")
