"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a stream of blocks, each with the path of its block-level elements and its text. Pages of a
host are aligned one after another: runs of the same blocks fold into repeated groups, blocks that one side
lacks become optional, texts that differ become slots. What comes out is the host's wrapper, a regular
expression without unions, with how much text, and how much of it in links, each place held.

The wrapper then tells which places hold the article. Places are of three levels: in article or main
elements, in elements named like one, and all others. A level's weight is the unlinked text in its slots, an
element (or, for others, a page), times LEVEL_WEIGHTS, so elements and names are a feature beside the text; a
page's text is what it has at the host's weightiest level. Fixed texts are left out, and link lists outside
marked elements; where a host shows no slot, its pages are copies and fixed texts count. Menus, headers, footers,
sidebars, notices, adverts, forms and comments are known by element, role, class or id and never taken.

Wrappers are merged per partition first, then per host in two levels, so no host's pages meet in one task.
A wrapper of more than MAX_ITEMS items is no longer aligned: it becomes the table of its distinct places, all
of them, whose sums go on. So what one task holds of a host grows with the host's distinct places.

Defined cases: null and empty html give an empty text; pages without a usable url share the host ''; markup
cut off in the middle is read as far as it goes; a very long page is read block by block, its wrapper a table
of places from MAX_ITEMS items on; of levels that weigh the same (ties) the more marked one is the article's;
repeated rows are answered alike; null ids pass through; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
#: Elements whose content is not markup, or no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title", "select", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a block; all others begin and end one.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BOILER_TAGS = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "input"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
BOILER_WORDS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "banner", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor",
    "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "subscribe", "subscription", "newsletter", "signup", "share", "sharing", "social",
    "related", "recommended", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "form", "search", "login", "pagination", "pager", "widget", "toolbar", "skip", "copyright", "paywall",
}
HEADER = {"header", "topbar", "masthead"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story"}
MAX_ITEMS, MAX_PERIOD = 300, 6
#: A partition's wrappers are handed on when they hold more hosts or items than this.
MAX_HOSTS, MAX_HELD = 20_000, 200_000
#: Excluded places of all hosts together are broadcast up to so many characters.
MAX_SENT = 32 << 20
#: By level: places outside marked elements, in elements named like an article, in article or main elements.
LEVEL_WEIGHTS = (1.0, 1.5, 2.0)


class Element:
    __slots__ = ("tag", "label", "boiler", "main", "block", "marked")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.block = tag, tag not in INLINE
        found = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        words = set(re.findall(r"[a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}"))
        role = found.get("role", "")
        inside = parent.main if parent else 0
        is_main = 2 if tag in ("article", "main") or role in ("article", "main") else 1 if self.block and tag in ("div", "section", "td") and words & MAIN_WORDS else 0
        self.main = max(inside, is_main)
        #: The outermost element that gives this level; the root for level 0.
        self.marked = self if parent is None or is_main > inside else parent.marked
        boiler = tag in BOILER_TAGS or role in BOILER_ROLES or bool(words & BOILER_WORDS and tag not in ("body", "html", "article", "main")) or "hidden" in found or found.get("aria-hidden") == "true"
        boiler = boiler or (inside < 2 and (tag == "header" or bool(words & HEADER) and tag not in ("body", "html", "article", "main")))
        self.boiler = boiler or bool(parent and parent.boiler)
        self.label = f"{tag}.{found['class'].replace(' ', '.')}" if found.get("class") else f"{tag}#{found['id']}" if found.get("id") else tag


def blocks(page: str | None) -> Iterator[tuple[str, str, int, bool, float, bool]]:
    """(path, text, main: 2 in an article, 1 in something named like one, boiler, share of the text in links, whether the first to be read in its marked element)."""
    stack: list[Element] = [Element("#", "", None)]
    parts: list[str] = []
    linked = 0
    links = 0
    begun: set[Element] = set()

    def path() -> tuple[str, Element]:
        own = [e for e in stack if e.block]
        return ">".join(e.label for e in own[1:]), stack[-1]

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        share = min(1.0, linked / max(1, len("".join(parts)))) if parts else 0.0
        parts.clear()
        linked = 0
        if text:
            where, last = path()
            first = not last.boiler and last.marked not in begun
            if first:
                begun.add(last.marked)
            return [(where, text, last.main, last.boiler, share, first)]
        return []

    at, page = 0, page or ""
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            if m[0][0] != "<" or m[0] == "<":
                text = entities.unescape(m[0])
                parts.append(text)
                linked += len(text) if links else 0
            continue
        tag = m[2].lower()
        if not m[0].endswith(">"):  # cut off inside a tag
            break
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("br", "hr"):
            yield from flush()
            continue
        if tag in VOID:
            continue
        inline = tag in INLINE
        if not inline:
            yield from flush()
        if m[1]:
            if any(e.tag == tag for e in stack[1:]):
                while stack[-1].tag != tag:
                    if stack[-1].block and inline:  # an inline end tag closes no block
                        break
                    stack.pop()
                if stack[-1].tag == tag:
                    stack.pop()
        else:
            if tag in CLOSES_P and any(e.tag == "p" for e in stack[1:]):
                while stack[-1].tag != "p":
                    stack.pop()
                stack.pop()
            elif tag in SIBLINGS:
                same, until = SIBLINGS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in until:
                        break
                    if stack[k].tag in same:
                        del stack[k:]
                        break
            if not m[0].endswith("/>") or not inline:
                stack.append(Element(tag, m[3], stack[-1]))
        links = sum(e.tag == "a" for e in stack)
    yield from flush()


# A wrapper is a list of items [path, text or None for a slot, optional, repeated, pages, chars, linked chars, marked elements begun, main, boiler, inner items].
PATH, TEXT, OPTIONAL, REPEATED, PAGES, CHARS, LINKED, BEGUN, MAIN, BOILER, INNER = range(11)


def signature(item: list) -> str:
    """Items of one signature can be the same place; a block and a run of it have the same."""
    return f"({' '.join(signature(x) for x in item[INNER])})" if len(item[INNER]) > 1 else item[PATH]


def merge_item(a: list, b: list) -> list:
    out = list(a)
    out[TEXT] = a[TEXT] if a[TEXT] == b[TEXT] else None
    for k in (OPTIONAL, REPEATED):
        out[k] = a[k] or b[k]
    for k in (PAGES, CHARS, LINKED, BEGUN):
        out[k] = a[k] + b[k]
    if a[INNER]:
        out[INNER] = [merge_item(x, y) for x, y in zip(a[INNER], b[INNER], strict=True)]
    return out


def group(items: list[list]) -> list:
    """A repeated group of several items."""
    return ["", None, False, True, max(x[PAGES] for x in items), sum(x[CHARS] for x in items), sum(x[LINKED] for x in items), sum(x[BEGUN] for x in items), max(x[MAIN] for x in items), False, items]


def fold(items: list[list]) -> list[list]:
    """Squares (a sequence followed by itself) become repeated items or groups."""
    for period in range(1, MAX_PERIOD + 1):
        names = [signature(x) for x in items]
        out, i = [], 0
        while i < len(items):
            n = 1
            while names[i : i + period] == names[i + n * period : i + (n + 1) * period] and i + (n + 1) * period <= len(items):
                n += 1
            if n == 1:
                out.append(items[i])
                i += 1
                continue
            parts = [items[i + k * period : i + (k + 1) * period] for k in range(n)]
            one = parts[0]
            for other in parts[1:]:
                one = [merge_item(x, y) for x, y in zip(one, other, strict=True)]
            for x in one:
                x[PAGES] = 1
            if period == 1:
                one[0][REPEATED] = True
                out.append(one[0])
            else:
                out.append(group(one))
            i += n * period
        items = out
    return items


def wrap_known(items: list[list], known: list[list]) -> list[list]:
    """What matches a repeated group of the other side once becomes that group."""
    for g in known:
        want = [signature(x) for x in g[INNER]]
        if len(want) < 2:
            continue
        out, i = [], 0
        while i < len(items):
            if [signature(x) for x in items[i : i + len(want)]] == want:
                out.append(group(items[i : i + len(want)]))
                i += len(want)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list[list] | dict[str, list], b: list[list] | dict[str, list]) -> list[list] | dict[str, list]:
    """The wrapper of both: mismatches become optional. Tables of places are added up (the first may be changed)."""
    if isinstance(a, dict) or isinstance(b, dict):
        a, b = (x if isinstance(x, dict) else distinct_places(x) for x in (a, b))
        for k, x in b.items():
            a[k] = merge_item(a[k], x) if k in a else x
        return a
    a = wrap_known(a, [x for x in b if x[INNER]])
    b = wrap_known(b, [x for x in a if x[INNER]])
    optional = lambda xs: [[*x[:OPTIONAL], True, *x[REPEATED:]] for x in xs]
    out: list[list] = []
    for what, i, j, k, m in SequenceMatcher(None, [signature(x) for x in a], [signature(x) for x in b], autojunk=False).get_opcodes():
        if what == "equal":
            out += [merge_item(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += optional(a[i:j]) + optional(b[k:m])
    return out if len(out) <= MAX_ITEMS else distinct_places(out)


def distinct_places(items: list[list]) -> dict[str, list]:
    """All places of a wrapper, each once, keyed by level, boilerplate and path."""
    found: dict[str, list] = {}
    for x in leaves(items):
        x = [*x[:OPTIONAL], True, True, *x[PAGES:]]
        key = f"{x[MAIN]}{int(x[BOILER])}{x[PATH]}"
        if key in found:
            pages = max(found[key][PAGES], x[PAGES])
            x = merge_item(found[key], x)
            x[PAGES] = pages
        found[key] = x
    return found


def leaves(items: list[list] | dict[str, list]) -> Iterator[list]:
    for x in items.values() if isinstance(items, dict) else items:
        if x[INNER]:
            yield from leaves(x[INNER])
        else:
            yield x


def whole(text: str) -> str:
    """What stands for a text: equal for equal texts only. Texts of blocks hold no line break, so no short one looks like a digest."""
    return text if len(text) <= 200 else f"{len(text)}\n{hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()}"


def page_wrapper(page: str | None) -> list[list]:
    return fold([[p, whole(t), False, False, 1, len(t), round(len(t) * share), int(first), main, boiler, []] for p, t, main, boiler, share, first in blocks(page)])


def article_places(wrapper: list[list] | dict[str, list]) -> tuple[list[int], dict[str, bool]]:
    """Levels by weight, the article's last; of each place outside boilerplate whether it can hold article text."""
    own = [x for x in leaves(wrapper) if not x[BOILER]]
    most = max((x[PAGES] for x in own), default=0)

    def fixed(x: list) -> bool:
        return x[TEXT] is not None and x[PAGES] >= 3 and (x[MAIN] == 0 or 2 * x[PAGES] >= most)

    def menu(x: list) -> bool:
        return x[MAIN] == 0 and x[LINKED] > 0.6 * x[CHARS]

    copies = all(fixed(x) or menu(x) for x in own)
    text, begun = [0.0] * 3, [0] * 3
    places: dict[str, bool] = {}
    for x in own:
        takes = not menu(x) and (copies or not fixed(x))
        places[x[PATH]] = places.get(x[PATH], False) or takes
        begun[x[MAIN]] += x[BEGUN]
        text[x[MAIN]] += (x[CHARS] - x[LINKED]) * takes
    weight = [LEVEL_WEIGHTS[k] * text[k] / max(1, begun[k]) for k in range(3)]
    return sorted(range(3), key=lambda k: (weight[k], k)), places


def extract(page: str | None, levels: list[int], places: dict[str, bool]) -> str:
    own = [(levels.index(main), t) for p, t, main, boiler, *_ in blocks(page) if not boiler and places.get(p, True)]
    best = max((k for k, _ in own), default=0)
    return " ".join(t for k, t in own if k == best)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, places (JSON: the levels, and the places outside boilerplate that hold no article text)."""

    def infer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[str, list | dict] = {}
        held = 0
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())], ["host", "wrapper"])
        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                own = page_wrapper(page.as_py())
                key = host.as_py()
                held -= len(found.get(key, ()))
                found[key] = align(found[key], own) if key in found else own
                held += len(found[key])
                if len(found) > MAX_HOSTS or held > MAX_HELD:
                    yield rows()
                    found.clear()
                    held = 0
        yield rows()

    def merged(found):
        out: list | dict | None = None
        for w in sorted(found):
            w = json.loads(w)
            out = w if out is None else align(out, w)
        return out

    def merge(key, rows):
        import pandas as pd

        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(merged(rows["wrapper"]))]})

    def decide(key, rows):
        import pandas as pd

        levels, places = article_places(merged(rows["wrapper"]))
        return pd.DataFrame({"host": [key[0]], "places": [json.dumps([levels, {p: takes for p, takes in places.items() if not takes}])]})

    parts = pages.select("host", "html").mapInArrow(infer, "host string, wrapper string").withColumn("salt", F.spark_partition_id() % 32)
    some = parts.groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(decide, "host string, places string")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    p = pages.select("page_id", "url", "html", host.alias("host"))
    known = materialize(wrappers(p), "wrappers")
    if (known.agg(F.sum(F.char_length("places"))).first()[0] or 0) <= MAX_SENT:
        known = maybe_broadcast(known, 5_000)
    both = p.join(known, "host", "left").select("page_id", "url", "html", "host", "places")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, host, decided in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if host not in places:
                    if len(places) > 5000:
                        places.clear()
                    places[host] = json.loads(decided.as_py() or "[[0, 1, 2], {}]")
                texts.append(extract(page.as_py(), *places[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
