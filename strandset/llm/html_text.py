"""Main text of web pages by template deduction over the pages of a host (operator 3).

1. Every page becomes tokens: its elements, told apart by the names, classes and ids above them, and its texts, told apart by their
   element and words; each with its number of occurrences on the page.
2. Tokens of a host that share one occurrence vector (how often they occur on each page) form an equivalence class.
   Vectors are compared by two order-free sums of hashes that Spark combines on the map side, so neither a host nor a vector
   is ever gathered in one task. A class is valid when two pages or more and a tenth of the host's pages carry it; so a
   host has at most ten times as many valid tokens as a page of it has on average, and only those are gathered by host.
3. Valid classes nest: a class lies in the one that holds the element above its first element. A text is fixed, which is part of
   the template, when it stands in a class with an element on most pages, or fills its element on more than half of the pages that have
   it; four pages at least must hold it, and they must not be copies of one page (their three longest texts differ).
   Elements whose other text is links for the most part are slots of menus, and elements of which nine tenths of the texts stand
   on four pages or more (no copies) are slots of rotating notices. What remains are the slots of content;
   the deepest element with nine tenths of their text bounds the article, but no heading is left outside.
4. A page is read with the template of its host: the article element (or main; without either, what bounds the
   article), less fixed texts, menus and notices. Of what remains, parts that declare themselves to be none of the article (element
   names, roles, hidden; class and id names that stand for comments, adverts and the like) go too, since slots that vary can be comments.

A host of fewer than four pages has no template, and a page of which a template leaves nothing is a copy of the others: such pages
are read by what their parts declare alone. Nothing else is dropped, and neither depth, classes nor length are capped.

Null html counts as empty and gives an empty text; null urls share one host; broken, unclosed or cut-off markup is
read as far as it goes; repeated rows count as pages of their own and give repeated rows; empty tables no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandset.llm.common import Scratch, lean

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "output", "meter", "progress",
}
#: An opening tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P = {"li", "td", "th", "dt", "dd", "div", "article", "section", "main", "body", "blockquote", "figure", "table"}
SKIPPED = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar"}
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|adbox|adslot|banners?|sponsor\w*|promo\w*|sidebars?|side|menus?|nav|navbar|navigation|breadcrumbs?|footers?|headers?|masthead|cookies?"
    r"|consent|gdpr|notices?|alerts?|popups?|modals?|newsletters?|subscri\w*|signup|share|sharing|social|related|recommend\w*|comments?|commentlist|reply|replies|responses?|disqus"
    r"|toolbar|widgets?|pagination|pager|copyright|login|search|skip|topbar|rail)(?:$|[-_\s])",
    re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]+)")


def attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PAGES, SHARE = 4, 10  # pages that a fixed text and a template need; the share of a host's pages that a valid class needs is one in SHARE


class Element:
    __slots__ = ("name", "key", "skip", "within", "inside", "inline")

    def __init__(self, name, key, skip, within, inside, inline=False):
        self.name, self.key, self.skip, self.within, self.inside, self.inline = name, key, skip, within, inside, inline


class Block:
    """A text: the element that it stands in, whether one above it declares itself to be none of the article, the innermost of article,
    main, body above it, its number of link characters, and whether the bounding element is above it."""

    __slots__ = ("key", "name", "skip", "within", "text", "linked", "inside")

    def __init__(self, top: Element, text: str, linked: int):
        self.key, self.name, self.skip, self.within, self.inside = top.key, top.name, top.skip, top.within, top.inside
        self.text, self.linked = text, min(linked, len(text))

    @property
    def digest(self) -> int:
        from xxhash import xxh3_64_intdigest

        return xxh3_64_intdigest(self.text, seed=self.key & (2**63 - 1)) >> 1


def parse(html: str, bound: int = 0) -> tuple[list[Block], dict[int, list]]:
    """The texts of a page in order, and its elements: [element above, occurrences] by key."""
    from collections import Counter
    from html import unescape

    from xxhash import xxh3_64_intdigest

    out, stack = [], [Element("body", 0, False, "body", not bound)]
    elements: dict[int, list] = {}
    opened: Counter = Counter()
    parts: list[str] = []
    link = linked = 0
    at, size = 0, len(html)

    def flush():
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(stack[-1], text, linked))
        parts.clear()
        linked = 0

    def push(name, mark, skip, within, inline=False):
        top = stack[-1]
        key = (xxh3_64_intdigest(mark, seed=top.key) >> 1) or 1
        elements.setdefault(key, [top.key, 0])[1] += 1
        stack.append(Element(name, key, skip, within, top.inside or key == bound, inline))
        opened[name] += 1

    def close(k):
        for e in stack[k:]:
            opened[e.name] -= 1
        del stack[k:]

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            piece = html[at:lt]
            if not stack[-1].skip or parts or piece.strip():
                parts.append(piece)
                if link:
                    linked += len(piece.strip())
        if lt == size:
            break
        m = TAG.match(html, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if name in ("br", "hr", "wbr", "img"):
            if name == "hr":
                flush()
            elif name != "wbr":
                parts.append(" ")
            continue
        if name in VOID:
            continue
        if name in INLINE:
            if name == "a":
                link = 0 if closing else 1
            if closing:
                while len(stack) > 1 and stack[-1].name == name and stack[-1].inline:
                    flush()
                    close(len(stack) - 1)
            elif rest and ("class" in rest or "id" in rest or "role" in rest or "hidden" in rest):
                own = attributes(rest)
                if _told(name, own):
                    flush()
                    push(name, f"{name}~", True, stack[-1].within, True)
            continue
        flush()
        if name in ("html", "body"):
            link = 0
            continue
        if closing:
            if opened[name] > 0:
                close(max(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name) if stack[-1].name != name else len(stack) - 1)
            continue
        link = 0
        if name in ENDS:
            if any(opened[x] > 0 for x in ENDS[name]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ENDS[name]:
                        close(k)
                        break
                    if stack[k].name in ("ul", "ol", "table", "dl", "select"):
                        break
        elif opened["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close(k)
                    break
                if stack[k].name in KEEPS_P:
                    break
        own = attributes(rest)
        top = stack[-1]
        skip = top.skip or name in SKIPPED or (name == "header" and top.within == "body") or (name not in ("article", "main") and _told(name, own)) or (
            name == "article" and bool(re.search(r"comment|reply|related|promo|teaser", own.get("class", ""), re.I))
        )
        within = name if name in ("article", "main") and not skip and top.within != "article" else "main" if own.get("role") == "main" and top.within == "body" else top.within
        marks = sorted({c for c in own.get("class", "").lower().split() if not re.search(r"\d", c)})
        push(name, ".".join([name, *marks]) + (f"#{own['id'].lower()}" if own.get("id") and not re.search(r"\d", own["id"]) else ""), skip, within)
    flush()
    return out, elements


def blocks(html: str) -> list[Block]:
    return parse(html)[0]


def _told(name: str, own: dict[str, str]) -> bool:
    """Whether the attributes tell an element to be none of the article."""
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role") in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return True
    return bool(NAMES.search(own.get("class", ""))) or bool(NAMES.search(own.get("id", "")))


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "").split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()


TOKEN = "host string, key long, above long, text long, a long, b long, chars long, linked long, heading boolean, blocks long, page long"


def _tokens(rows: DataFrame) -> DataFrame:
    """The tokens of each page (columns TOKEN). ``text`` is null for elements, with the characters that stand in them; ``a`` and ``b``:
    31-bit hashes of the page and the number of occurrences; ``page``: a hash of the page's three longest texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as digest

        kinds = [pa.string(), *[pa.int64()] * 7, pa.bool_(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in TOKEN.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                host, key = host_of(url), digest(f"{page}\0{url}")
                found, elements = parse(html or "")
                longest = digest("\0".join(sorted({b.text for b in found}, key=lambda t: (-len(t), t))[:3])) >> 1
                texts: dict[tuple, list] = {}
                inside: dict[int, list] = {}
                for b in found:
                    t = texts.setdefault((b.key, b.digest), [0, 0, 0])
                    e = inside.setdefault(b.key, [0, 0, False, 0])
                    e[3] += 1
                    t[0] += 1
                    t[1] += len(b.text)
                    t[2] += b.linked
                    e[0] += len(b.text)
                    e[1] += b.linked
                    e[2] |= b.name in HEADINGS
                mark = lambda n, key=key: ((h := digest(str(n), seed=key)) & 0x7FFFFFFF, h >> 33)
                out.append((host, 0, 0, None, *mark(1), *inside.get(0, (0, 0, False, 0)), longest))
                for k, (above, n) in elements.items():
                    out.append((host, k, above, None, *mark(n), *inside.get(k, (0, 0, False, 0)), longest))
                for (k, text), (n, chars, linked) in texts.items():
                    out.append((host, k, 0, text, *mark(n), chars, linked, False, n, longest))
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return rows.select("page", "url", "html").mapInArrow(lean(run), TOKEN)


def deduce(tokens: list[dict], pages: int) -> dict:
    """The template of a host from its valid tokens: its ``classes`` (pages, number of the class they lie in or -1, elements, texts),
    ``fixed`` texts, ``menus`` (elements whose text is links or recurs) and the element ``bound`` (0: the whole page)."""
    elements = {t["key"]: t for t in tokens if t["text"] is None}
    by: dict[tuple, list] = {}
    for t in tokens:
        by.setdefault((t["pages"], t["a"], t["b"]), []).append(t)
    classes = sorted(by.items(), key=lambda c: (-c[0][0], c[0]))
    number = {t["key"]: i for i, (_, members) in enumerate(classes) for t in members if t["text"] is None}
    fixed, of = set(), {}
    for (n, *_), members in classes:
        common = any(t["text"] is None and 2 * n > pages for t in members)
        for t in members:
            if t["text"] is not None and n >= PAGES and t["low"] != t["high"] and (common or t["key"] in elements and 2 * n > elements[t["key"]]["pages"]):
                fixed.add(t["text"])
                chars = of.setdefault(t["key"], [0, 0])
                chars[0] += t["chars"]
                chars[1] += t["linked"]
    left = {k: (t["chars"] - of.get(k, (0, 0))[0], t["linked"] - of.get(k, (0, 0))[1]) for k, t in elements.items()}
    menus = {k for k, (chars, linked) in left.items() if chars > 0 and (linked > 0.8 * chars or 10 * elements[k]["recurring"] > 9 * elements[k]["blocks"])}
    mass = {k: 0 if k in menus else chars for k, (chars, _) in left.items()}
    below: dict[int, list] = {}
    for k, t in elements.items():
        if k:
            below.setdefault(t["above"], []).append(k)
    whole, headed = dict(mass), {k: mass[k] > 0 and elements[k]["heading"] for k in mass}
    order, todo = [], [0] if 0 in elements else []
    while todo:
        order.append(todo.pop())
        todo.extend(below.get(order[-1], ()))
    for k in reversed(order):
        if k:
            above = elements[k]["above"]
            whole[above] += whole[k]
            headed[above] |= headed[k]
    bound = 0
    while whole.get(bound) and not mass[bound]:
        most = max(below.get(bound, ()), key=lambda k: (whole[k], k), default=None)
        if most is None or 10 * whole[most] < 9 * whole[bound] or any(headed[k] for k in below[bound] if k != most):
            break
        bound = most
    told = [
        {"pages": c[0], "above": next((number.get(t["above"], -1) for t in members if t["key"] and t["text"] is None), -1),
         "elements": sorted(t["key"] for t in members if t["text"] is None), "texts": sorted(t["text"] for t in members if t["text"] is not None)}
        for c, members in classes
    ]
    return {"classes": told, "fixed": sorted(fixed), "menus": sorted(menus), "bound": bound}


def templates(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(host, pages, classes, fixed, menus, bound): the template of each host of PAGES pages or more, as ``deduce`` has it."""
    rows = pages.select(F.col(id).cast("string").alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    tokens = _tokens(rows).groupBy("host", "key", "text").agg(
        F.min("above").alias("above"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.max("heading").alias("heading"), F.sum("blocks").alias("blocks"), F.min("page").alias("low"), F.max("page").alias("high"),
    )
    tokens = Scratch(pages.sparkSession, "html").keep(tokens.where("pages >= 2"), "tokens")
    hosts = tokens.where("key = 0 and text is null").select("host", F.col("pages").alias("all_pages")).where(F.col("all_pages") >= PAGES)
    recur = tokens.where(F.col("text").isNotNull() & (F.col("low") != F.col("high")) & (F.col("pages") >= PAGES)).groupBy("host", "key").agg(F.sum("blocks").alias("recurring"))
    valid = tokens.join(hosts, "host").where(F.col("pages") * SHARE >= F.col("all_pages")).join(recur, ["host", "key"], "left").withColumn("recurring", F.coalesce("recurring", F.lit(0)))
    names = ("key", "above", "text", "a", "b", "pages", "chars", "linked", "heading", "blocks", "recurring", "low", "high")
    valid = valid.groupBy("host", "all_pages").agg(F.collect_list(F.struct(*names)).alias("tokens"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("pages", pa.int64()), ("above", pa.int64()), ("elements", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64()))]))
        for batch in batches:
            made = [deduce(t.as_py(), n.as_py()) for n, t in zip(batch.column(1), batch.column(2))]
            arrays = [batch.column(0), batch.column(1), pa.array([x["classes"] for x in made], kind), *(pa.array([x[n] for x in made], pa.list_(pa.int64())) for n in ("fixed", "menus")), pa.array([x["bound"] for x in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "pages", "classes", "fixed", "menus", "bound"])

    return valid.mapInArrow(
        lean(run), "host string, pages long, classes array<struct<pages:long,above:long,elements:array<long>,texts:array<long>>>, fixed array<long>, menus array<long>, bound long"
    )


def read_page(html: str, template: tuple[frozenset, frozenset, int] | None = None) -> str:
    """The main text of one page, given the fixed texts, menus and bound of its host's template."""
    fixed, menus, bound = template or (frozenset(), frozenset(), 0)
    found, _ = parse(html, bound)
    left = [b for b in found if not b.skip]
    if template:
        left = [b for b in left if b.key not in menus and b.digest not in fixed]
        if found and not left:
            return read_page(html)
    within = {b.within for b in left}
    container = "article" if "article" in within else "main" if "main" in within else None
    if container:
        left = [b for b in left if b.within == container or (container == "main" and b.within == "article")]
    elif any(b.inside for b in left):
        left = [b for b in left if b.inside]
    return "\n".join(b.text for b in left)


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars), one for each row of ``pages``."""
    scratch = Scratch(pages.sparkSession, "html")
    made = scratch.keep(templates(pages, id, url, html).select("host", "fixed", "menus", "bound"), "templates")
    host = F.lower(F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", ""))
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(host, r"^([^/?#]*)", 1), r"^.*@", ""), r":.*$", "")
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), host.alias("host"))
    rows = rows.join(made, "host", "left")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            text, known = [], {}
            for page, host, fixed, menus, bound in zip(*(batch.column(k).to_pylist() for k in range(2, 7))):
                if host not in known:
                    known[host] = None if bound is None else (frozenset(fixed), frozenset(menus), bound)
                text.append(read_page(page or "", known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [id, url, "text", "n_chars"])

    schema = T.StructType([T.StructField(id, rows.schema["id"].dataType), T.StructField(url, rows.schema["url"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.select("id", "url", "html", "host", "fixed", "menus", "bound").mapInArrow(lean(run), schema)
