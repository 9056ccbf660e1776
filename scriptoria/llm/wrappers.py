"""Main text of web pages by wrappers inferred per host (operator 2).

A wrapper is a union-free regular expression over a host's pages, kept as a tree: an element holds a sequence of items, each
once, optional (some page lacks it), repeated, or a repeated group of optional items (where pages disagree on the order),
and text that is either the same on all pages or a slot. Pages are aligned with it one after another: equal items match,
a mismatch of items becomes an optional or a repeated group, a mismatch of strings becomes a slot. What an alignment has
learned is a set of counts per item, so wrappers of parts of a host align with each other in the same way: every task
folds its own pages into one wrapper per host, and wrappers of a host meet in rounds of bounded groups.

The main region of a host is found in its wrapper: from the root down to the element that still holds most of the text
of slots, not counting elements whose name or role says that they are something else (menus, adverts, forms, comments);
a name is a whole class or id or the head of one, never that of html, body, main or article, and it does not count where
the element holds most of the page's text together with its title or article, or nearly all of it.
On a page the region's blocks are joined, without such elements and without texts that are the same on all pages of the
host (unless they sit in a repeated group, where they are content that happens to recur, or in an article or main element).

Contract: a null or empty page has an empty text; a page whose region is missing is aligned with itself alone; a null url is
a host of its own; malformed markup is closed as browsers do for the usual cases; nothing is cut or capped; repeated rows
come back each; extra columns are ignored.
"""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S)
CUT_TAG = re.compile(r"<[/!a-zA-Z][^<>]*\Z")  # a tag that the end of the page cuts
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "canvas"}
FOREIGN = {"svg", "math"}  # empty where they are closed in their own tag or never
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
OTHER_TAGS = {"nav", "aside", "footer", "form", "button", "input", "dialog", "menu", "head", "fieldset"} | RAW
OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
OTHER_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget",
    "footer", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "respond",
    "reply", "replies", "pagination", "pager", "skip", "toolbar", "search", "form", "copyright", "legal", "disclaimer", "hidden",
}
CONTAINERS = {"html", "body", "main", "article"}  # no name excludes them
STATES = {"has", "with", "no", "without", "not", "is", "show"}  # a name after these tells of a container, not of itself
PLAIN = {"area", "bar", "block", "box", "button", "buttons", "container", "holder", "inner", "item", "items", "link", "links", "list", "outer", "post", "posts", "section", "thread", "wrap", "wrapper"}  # heads that say nothing
SITE_HEADER = {"header", "pageheader", "siteheader"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table"}
MIN_PAGES = 3  # below, a text that is the same on all pages proves nothing
SHARE = 0.6
NEARLY_ALL = 0.9
GROUP = 64  # wrappers of a host that meet in one task of a round


class Element:
    __slots__ = ("key", "tag", "other", "kids")

    def __init__(self, key: str, tag: str, other: int):
        self.key, self.tag, self.other, self.kids = key, tag, other, []


def _excludes(name: str) -> bool:
    """Whether a class or id is one of OTHER_NAMES, or a compound of which that is the head (main-menu, not sidebar-right)."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
    while len(words) > 1 and words[-1] in PLAIN:
        words.pop()
    return bool(words) and words[-1] in OTHER_NAMES and not STATES & set(words[:-1])


def _named(tag: str, raw: str) -> tuple[str, int]:
    """Key of an element (tag, classes and id without digits) and what excludes it: 2 its tag, role or style, 1 only its name, 0 nothing."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if "=" in raw else {}
    names = [*sorted(found.get("class", "").split()), found.get("id", ""), found.get("role", "")]
    key = ".".join([tag, *[re.sub(r"\d+", "#", n) for n in names if n]])
    if tag in OTHER_TAGS or found.get("role", "").lower() in OTHER_ROLES or found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", raw) is not None or re.search(r"display\s*:\s*none", found.get("style", "")) is not None:
        return key, 2
    return key, int(tag not in CONTAINERS and any(_excludes(n) for n in names[:-1]))


_names: dict[tuple[str, str], tuple[str, int]] = {}


def named(tag: str, raw: str) -> tuple[str, int]:
    got = _names.get((tag, raw))
    if got is None:
        got = _named(tag, raw)
        if len(_names) < 20_000:
            _names[tag, raw] = got
    return got


def parse(page: str) -> Element:
    """Tree of elements and texts; comments are gone, the content of raw elements too."""
    root = Element("", "", 0)
    by_name = False
    path = [root]
    at, raw_until = 0, None
    for m in TOKEN.finditer(page):
        if raw_until is not None and m.start() < raw_until:
            continue
        if m.start() > at:
            path[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(path) - 1, 0, -1):
                if path[k].tag == tag:
                    del path[k:]
                    break
                if path[k].tag in ("article", "main", "body", "td", "th") and tag in INLINE:
                    break
            continue
        if tag not in INLINE and tag not in FOREIGN:
            while path[-1].tag in INLINE and any(e.tag == "p" for e in path) or path[-1].tag == "p":
                path.pop()
        shut = CLOSES.get(tag)
        if shut:
            for k in range(len(path) - 1, 0, -1):
                if path[k].tag in LISTS:
                    break
                if path[k].tag in shut:
                    del path[k:]
                    break
        key, other = named(tag, m[3])
        element = Element(key, tag, other)
        by_name |= other == 1
        path[-1].kids.append(element)
        if tag in FOREIGN and m[3].rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = raw_until = end.end() if end else (at if tag in ("title", "textarea") or tag in FOREIGN else len(page))
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            path.append(element)
    if at < len(page):
        path[-1].kids.append(CUT_TAG.sub("", page[at:]))
    if by_name:
        readmit(root)
    return root


def readmit(root: Element) -> None:
    """What only its name excludes is content if it holds most of the page's text: with the article or its title, or nearly all."""
    found = []

    def size(e: Element) -> tuple[int, bool]:
        chars, titled = 0, False
        for kid in e.kids:
            if isinstance(kid, str):
                chars += len(kid.strip())
            elif kid.other != 2:
                n, t = size(kid)
                chars, titled = chars + n, titled or t or kid.tag in ("h1", "main", "article")
        if e.other == 1:
            found.append((e, chars, titled))
        return chars, titled

    total = size(root)[0]
    for e, chars, titled in found:
        if 2 * chars > total and (titled or chars >= NEARLY_ALL * total):
            e.other = 0


def squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


# ---------------------------------------------------------------- wrappers

# An item of a wrapper is a list: [times its parent was seen with it, most often in one parent, constant text of its own
# or None (a slot), characters of its own texts, texts seen, how often it was excluded, items by key, pairs of keys in order].


def blank() -> list:
    return [0, 0, "", 0, 0, 0, {}, {}]


def fold(item: list, element: Element) -> None:
    """Align one element with its item."""
    own = []
    seen: dict[str, int] = {}
    before = None
    for kid in element.kids:
        if isinstance(kid, str):
            if not kid.isspace():
                own.append(squeeze(kid))
            continue
        below = item[6].get(kid.key)
        if below is None:
            below = item[6][kid.key] = blank()
        below[5] += kid.other > 0
        seen[kid.key] = seen.get(kid.key, 0) + 1
        if before is not None and before != kid.key:
            item[7][before + " " + kid.key] = 1
        before = kid.key
        fold(below, kid)
    for key, n in seen.items():
        below = item[6][key]
        below[0] += 1
        below[1] = max(below[1], n)
    text = " ".join(x for x in own if x)
    item[3] += len(text)
    if item[4] == 0:
        item[2] = text
    elif item[2] != text:
        item[2] = None
    item[4] += 1


def align(a: list, b: list) -> list:
    """Align two wrappers of one host."""
    a[2] = b[2] if not a[4] else a[2] if not b[4] or a[2] == b[2] else None
    a[0] += b[0]
    a[1] = max(a[1], b[1])
    a[3] += b[3]
    a[4] += b[4]
    a[5] += b[5]
    a[7].update(b[7])
    for key, item in b[6].items():
        a[6][key] = align(a[6][key], item) if key in a[6] else item
    return a


def expression(item: list, key: str = "") -> str:
    """The wrapper as an expression: ? optional, + repeated, ( )+ a repeated group, # a text slot."""
    order = _order(item)
    parts = []
    for group in order:
        inner = []
        for k in group:
            below = item[6][k]
            mark = ("+" if below[1] > 1 else "") + ("?" if below[0] < item[4] else "")
            inner.append(expression(below, k) + (mark if len(group) == 1 else "?"))
        parts.append("(" + " ".join(inner) + ")+" if len(group) > 1 else inner[0])
    text = "#" if item[2] is None else repr(item[2]) if item[2] else ""
    return f"<{key}>" + " ".join(x for x in [text, *parts] if x) + "</>"


def _order(item: list) -> list[list[str]]:
    """Items in order; those whose order differs between or within pages form one group."""
    after: dict[str, set[str]] = {k: set() for k in item[6]}
    for pair in item[7]:
        a, b = pair.split(" ")
        if a in after and b in after:
            after[a].add(b)
    reach = {}
    for k in after:
        todo, got = list(after[k]), set()
        while todo:
            x = todo.pop()
            if x not in got:
                got.add(x)
                todo.extend(after[x])
        reach[k] = got
    groups, used = [], set()
    for k in sorted(after, key=lambda k: -len(reach[k])):
        if k not in used:
            group = [k, *[x for x in after if x != k and x in reach[k] and k in reach[x]]]
            used.update(group)
            groups.append(group)
    return groups


def weight(item: list) -> int:
    """Characters of slots below an item, without excluded elements; texts of hosts with few pages all count."""
    if 2 * item[5] > item[4]:
        return 0
    own = item[3] if item[2] is None or item[4] < MIN_PAGES else 0
    return own + sum(weight(x) for x in item[6].values())


def region(item: list) -> list[str]:
    """Keys from the root to the main region: the last element that holds most slot text and is not repeated."""
    path: list[str] = []
    here = item
    total = weight(here)
    while total:
        best, key = max(((weight(x), k) for k, x in here[6].items()), default=(0, ""))
        tag = key.split(".")[0]
        if best < SHARE * total or tag in INLINE or here[6][key][1] > 1 and tag not in ("article", "main", "div", "section") or tag in ("p", "li", "pre", "blockquote", "h1", "h2", "h3"):
            break
        path.append(key)
        here, total = here[6][key], best
        if tag in ("article", "main"):
            break
    return path


def titled_alike(item: list) -> bool:
    """Whether all pages of a host have one main heading: then they are copies, and sameness proves nothing."""
    return any((k.split(".")[0] == "h1" and x[2] is not None and x[4] >= MIN_PAGES) or titled_alike(x) for k, x in item[6].items())


def fixed(item: list, repeated: bool = False, pages: int | None = None) -> dict:
    """Tree of the keys whose own text is the same on all pages (outside of repeated groups and of article and main); main headings never are."""
    pages = item[4] if pages is None else pages
    once = {k: x for k, x in item[6].items() if k.split(".")[0] not in ("article", "main")}
    groups = {k for g in _order(item) if len(g) > 1 for k in g}
    out = {}
    for key, below in once.items():
        again = repeated or below[1] > 1 or key in groups
        inner = fixed(below, again, pages)
        same = not again and key.split(".")[0] != "h1" and below[2] is not None and below[2] != "" and below[4] >= max(MIN_PAGES, pages)
        if inner or same:
            out[key] = [same, inner]
    return out


# ---------------------------------------------------------------- extraction


def blocks(element: Element, same: dict, inside: bool = True) -> list[str]:
    """Texts of the blocks of an element in page order."""
    out: list[str] = []
    parts: list[str] = []

    def flush():
        text = squeeze("".join(parts))
        parts.clear()
        if text:
            out.append(text)

    def walk(e: Element, mask: dict, skip_own: bool):
        for kid in e.kids:
            if isinstance(kid, str):
                if not skip_own:
                    parts.append(kid)
            elif kid.tag == "br":
                parts.append(" ")
            elif not kid.other:
                fixed_text, deeper = mask.get(kid.key, (False, {}))
                if kid.tag in INLINE:
                    walk(kid, deeper, fixed_text)
                else:
                    flush()
                    walk(kid, deeper, fixed_text)
                    flush()

    walk(element, same, False)
    flush()
    return out


def built(tree: list) -> tuple[list[str], dict]:
    """Main region and fixed texts of a wrapper."""
    return region(tree), {} if titled_alike(tree) else fixed(tree)


def locate(root: Element, path: list[str]) -> list[Element]:
    here = [root]
    for key in path:
        here = [k for e in here for k in e.kids if isinstance(k, Element) and k.key == key]
    return here


def main_text(page: str | None, wrapper: tuple[list[str], dict] | None) -> str:
    if not page:
        return ""
    root = parse(page)
    path, same = wrapper or ([], {})
    found = locate(root, path) if path else []
    if not found:
        alone = blank()
        fold(alone, root)
        path, same = region(alone), {}
        found = locate(root, path)
    for key in path:
        same = same.get(key, (False, {}))[1]
    return "\n\n".join(b for e in found for b in blocks(e, same))


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _fold_pages(batches):
    """One wrapper per host for the pages of a task."""
    found: dict[str, list] = {}
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if page:
                fold(found.setdefault(host, blank()), parse(page))
    for host in found:
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(found[host])])], ["host", "wrapper"])


def _align_all(key, table_):
    out = blank()
    for w in table_.column("wrapper").to_pylist():
        out = align(out, json.loads(w))
    return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(out)]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of every host of ``pages`` (url, html)."""
    one = materialize(pages.select(_host().alias("host"), F.col("html").cast("string")).mapInArrow(_fold_pages, "host string, wrapper string"), "wrappers")
    while (most := one.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        parts = -(-most // GROUP)  # of the host with most; each gets up to about GROUP wrappers
        dealt = one.withColumn("part", F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.lit(parts)))
        one = materialize(dealt.groupBy("host", "part").applyInArrow(_align_all, "host string, wrapper string"), "wrappers")
    return one


def _extract(batches):
    known: dict[str, tuple[list[str], dict]] = {}
    for batch in batches:
        texts = []
        for page, host, wrapper in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "wrapper"))):
            if wrapper is not None and host not in known:
                known[host] = built(json.loads(wrapper))
            texts.append(main_text(page, known.get(host)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), _host().alias("host"))
    return pages.join(wrappers(pages), "host", "left").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


@query("op2_wrappers")
def op2(spark, sf_dir):
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
