"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

1. *Stream.* Each page becomes a stream of text slots.  Slots of one section (the nearest div, section, article, ... above them)
   in a row are a unit, whose key is the path of the section; equal units in a row fold to a repeated group.  Units under the
   page's main or article, and units outside of any article (menus, headers, footers, sidebars, notices, adverts, forms, comments),
   are marked in their keys.  This is the page's own expression.
2. *Wrapper.* Expressions of one host are aligned pairwise by key, and by text where units of one key differ in it: units found in
   both stay, others become optional, a repeat in either stays a repeated group.  There are no alternatives, so the result is
   union-free.  Units of one key at different places stay different units.  Equal expressions are merged first, the
   rest in a tree of groups of at most ``GROUP`` expressions until one a host is left.
3. *Judgement.* A unit keeps the running text (without links and without constant texts) of all pages that have it.  Units under
   main or article are content.  For pages without these, content is the unit that holds most of the running text and all
   below it, or else the units under the deepest path with most of it.  A text in one unit on most of a host's distinct pages
   is constant; it is left out of pages without main or article.
4. *Matching.* Every page's expression is aligned with its host's wrapper, which names the unit of each of its slots; slots of
   content units are joined.  Main or article decide page by page, so other pages of a host may have none.

Which elements are main: those of main (or its role), else top-level articles.  Class and id words mark what is outside,
if a name consists of such words and of words for parts of a layout; html, body, main, the chosen articles and what is around them are
never outside by a word, nor is a heading by its id, or by its class inside main or article.

A slot's text has its character references decoded, runs of white space turned into one space, and no white space at its
ends; slots are joined by two line feeds.

Defined cases: null or empty html gives empty text; a null url, or one without a host, is judged by its own page alone;
cut-off pages end where they end; repeated rows are rows of their own and no further evidence; an empty table gives an empty result; other
columns are passed through, ``text`` is replaced.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import lean_batches, with_fields
from loadline.plans.staging import stage

TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][\w:-]*)((?>[^<>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?][^>]*>""")
ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
#: Elements without content.
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Elements inside a line of text.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("nav footer aside form head button select dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
#: Words in a class or id that mark what is not the article.
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation
menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended cookie cookies consent gdpr notice popup
modal newsletter subscribe subscription share sharing social comment comments commentlist respond disqus replies form search
login signup pagination pager toolbar skip hidden""".split())
#: Start tags that end an open element of the named kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words that go with a mark and change nothing ("post-comments", "ad-slot-3", "site-header").
LAYOUT = frozenset("""area bar block body bottom box btn button buttons column container content footer icon icons inner item items left link links
list main mobile outer page panel post posts primary right section secondary site slot small teaser teasers text title top unit widget widgets
wrap wrapper""".split())
#: Elements that make a unit of the slots in them.
SECTIONS = frozenset("html body div section article main td th aside header footer nav form center dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Expressions that are aligned in one task, and steps of a path; deeper elements share the path of the last step.
GROUP, MAX_DEPTH = 24, 64
ENDS = frozenset("ul ol dl table div section article body".split())


class Element:
    """An open or closed element; ``strong``: it or one around it is outside by tag, role or style; ``weak``: by a word."""

    __slots__ = ("tag", "parent", "depth", "path", "strong", "weak", "section", "main", "inside", "out")

    def __init__(self, tag: str, parent: "Element | None", step: str, strong: bool, weak: bool, main: bool) -> None:
        self.tag, self.parent, self.weak, self.main = tag, parent, weak, main
        self.depth = parent.depth + 1 if parent else 1
        self.path = step if parent is None else parent.path if self.depth > MAX_DEPTH else f"{parent.path}/{step}"
        self.strong = strong or (parent is not None and parent.strong)
        self.section = self if tag in SECTIONS or parent is None else parent.section
        self.inside = False
        self.out: bool | None = None

    def line(self) -> "Iterator[Element]":
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


class Slot:
    __slots__ = ("at", "text", "links", "outside", "inside")

    def __init__(self, at: Element | None, text: str, links: int) -> None:
        self.at, self.text, self.links = at, text, links
        self.outside = self.inside = False

    @property
    def key(self) -> str:
        """Key of the slot's unit: its section's path, marked if outside or under main or article."""
        return ("!" if self.outside else "*" if self.inside else "") + (self.at.section.path if self.at else "")


def marked(name: str) -> bool:
    """Whether a class or id name says that its element is not the article."""
    parts = [p.lower() for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p and not p.isdigit()]
    return any(p in MARKS for p in parts) and all(p in MARKS or p in LAYOUT for p in parts)


def _named(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(path step, strong, weak, main) of a start tag."""
    strong, weak, main = tag in OUTSIDE, False, tag == "main"
    names: list[str] = []
    if attributes.strip(" /"):
        given = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        names = given.get("class", "").split()
        ids = [] if tag in HEADINGS else given.get("id", "").split()
        role = given.get("role", "").lower()
        style = given.get("style", "").replace(" ", "").lower()
        bare = ATTRIBUTE.sub("", attributes).lower().split()
        strong = (strong or role in ROLES or "display:none" in style or "visibility:hidden" in style or "hidden" in bare or "hidden" in given
                  or given.get("aria-hidden") == "true")
        weak = tag not in ("html", "body") and any(map(marked, names + ids))
        main = main or role == "main"
        names += ids
    return ".".join([tag, *sorted(n for n in names if not any(c.isdigit() for c in n))]), strong, weak, main


def slots(page: str | None) -> list[Slot]:
    """Text slots of a page, in order."""
    found: list[Slot] = []
    if not page:
        return found
    stack: list[Element] = []
    wanted: list[Element] = []  # main elements and articles
    held: list[str] = []
    links = linked = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal links
        text = " ".join(html_lib.unescape("".join(held)).split())
        held.clear()
        if text:
            found.append(Slot(stack[-1] if stack else None, text, min(links, len(text))))
        links = 0

    while at < size:
        hit = TAG.search(page, at)
        text = page[at:hit.start() if hit else size]
        if text:
            held.append(text)
            links += len(text) if linked else 0
        if not hit:
            break
        at = hit.end()
        if hit.group() == "<!--":
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        close, tag, attributes = (hit[1], hit[2], hit[3]) if hit[2] else (hit[4], hit[5], hit[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not close and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "a":
                linked = 0 if close else 1
            strong, weak = _named(tag, attributes)[1:3] if attributes else (False, False)
            if not (strong or weak) and not any(e.tag == tag for e in stack):
                continue  # only an inline element that marks something outside becomes a step
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            flush() if tag == "hr" else None
            continue
        flush()
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        ends = CLOSES.get(tag, ())
        closes_p = tag not in INLINE
        for i in range(len(stack) - 1, -1, -1):
            open_ = stack[i].tag
            if open_ in ends or (closes_p and open_ == "p"):
                del stack[i:]
                break
            if open_ in ENDS:
                break
        step, strong, weak, main = _named(tag, attributes)
        if tag == "header" and not any(e.main or e.tag == "article" for e in stack):
            strong = True
        element = Element(tag, stack[-1] if stack else None, step, strong, weak, main)
        if main or tag == "article":
            wanted.append(element)
        stack.append(element)
    flush()
    _settle(found, wanted)
    return found


def _settle(found: list[Slot], wanted: list[Element]) -> None:
    """Choose main or articles, then set which slots are inside and which outside."""
    regions = [e for e in wanted if e.main and not e.strong]
    if not regions:
        articles = [e for e in wanted if not e.strong and not any(x.tag == "article" for x in e.line() if x is not e)]
        regions = [e for e in articles if not any(x.weak for x in e.line())]
        if not regions and articles:  # a word marks the article or what is around it: the largest that is not marked itself
            chars = {id(e): 0 for e in articles if not e.weak}
            for s in found:
                for e in s.at.line() if s.at else ():
                    if id(e) in chars:
                        chars[id(e)] += len(s.text)
            regions = sorted((e for e in articles if not e.weak), key=lambda e: -chars[id(e)])[:1]
    safe = {id(x) for e in regions for x in e.line()}
    chosen = {id(e) for e in regions}
    for s in found:
        new = []
        for e in s.at.line() if s.at else ():
            if e.out is not None:
                break
            new.append(e)
        for e in reversed(new):
            up = e.parent
            e.inside = id(e) in chosen or (up is not None and up.inside)
            word = e.weak and id(e) not in safe and not (e.inside and e.tag in HEADINGS)
            e.out = e.strong or word or (up is not None and up.out)
        if s.at:
            s.inside, s.outside = s.at.inside, s.at.out


# ---------------------------------------------------------------- expressions

class Unit:
    """A unit of an expression: key, repeated, optional, text if it is one on all its pages, running text and pages."""

    __slots__ = ("key", "repeated", "optional", "text", "worth", "pages")

    def __init__(self, key: str, repeated: bool, optional: bool, text: int | None, worth: int, pages: int) -> None:
        self.key, self.repeated, self.optional, self.text, self.worth, self.pages = key, repeated, optional, text, worth, pages

    def row(self) -> list:
        return [self.key, self.repeated, self.optional, self.text, self.worth, self.pages]


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def units(found: list[Slot]) -> tuple[list[Unit], list[int]]:
    """A page's expression, and the number of the unit that holds each slot.

    Equal keys in a row are one unit, a repeated group if they come from different sections.
    """
    out: list[Unit] = []
    of: list[int] = []
    last = None
    for s in found:
        key, section = s.key, s.at.section if s.at else None
        worth = max(0, len(s.text) - 2 * s.links)
        if out and out[-1].key == key:
            u = out[-1]
            u.repeated = u.repeated or section is not last
            u.text = None if u.text is None else text_hash(f"{u.text} {s.text}")
            u.worth += worth
        else:
            out.append(Unit(key, False, False, text_hash(s.text), worth, 1))
        last = section
        of.append(len(out) - 1)
    return out, of


def paired(a: list[Unit], b: list[Unit]) -> list[tuple[int | None, int | None]]:
    """Alignment of two expressions: (place in a, place in b), None where a unit has no partner.

    Equal keys may pair, the more so with equal texts, or both with changing ones.
    """
    if [x.key for x in a] == [y.key for y in b]:
        return [(i, i) for i in range(len(a))]
    n, m = len(a), len(b)

    def worth(x: Unit, y: Unit) -> int:
        return 0 if x.key != y.key else 3 if x.text is not None and x.text == y.text else 1 if x.text is not None and y.text is not None and min(x.pages, y.pages) > 1 else 2

    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            w = worth(a[i], b[j])
            row[j] = max(below[j], row[j + 1], below[j + 1] + w if w else 0)
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < n or j < m:
        w = worth(a[i], b[j]) if i < n and j < m else 0
        if w and best[i][j] == best[i + 1][j + 1] + w:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i][j] == best[i + 1][j]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def align(a: list[Unit], b: list[Unit]) -> list[Unit]:
    """One expression that matches what either matches: common units in order, others optional."""
    out = []
    for i, j in paired(a, b):
        if i is not None and j is not None:
            x, y = a[i], b[j]
            out.append(Unit(x.key, x.repeated or y.repeated, x.optional or y.optional, x.text if x.text == y.text else None, x.worth + y.worth, x.pages + y.pages))
        else:
            x = a[i] if i is not None else b[j]
            out.append(Unit(x.key, x.repeated, True, x.text, x.worth, x.pages))
    return out


def content_units(wrapper: list[Unit]) -> set[int]:
    """Units of the wrapper whose slots are the text of a page without main or article."""
    inside = [i for i, u in enumerate(wrapper) if u.key[:1] not in "!*" or not u.key]
    # a unit with one text on several pages is part of the template
    worth = {i: 0 if wrapper[i].text is not None and wrapper[i].pages >= 3 else wrapper[i].worth for i in inside}
    total = sum(worth.values())
    if not total:
        return set(inside)
    most = max(inside, key=lambda i: (worth[i], -i))
    top = wrapper[most].key
    below = {i for i in inside if i == most or wrapper[i].key.startswith(f"{top}/")}
    if 4 * sum(worth[i] for i in below) >= 3 * total:
        return below
    mass: dict[str, int] = {}
    for i in inside:
        steps = wrapper[i].key.split("/")
        for d in range(len(steps)):
            path = "/".join(steps[:d + 1])
            mass[path] = mass.get(path, 0) + worth[i]
    deep = max((p for p, v in mass.items() if 4 * v >= 3 * total), key=lambda p: (p.count("/"), mass[p], p), default="")
    return {i for i in inside if not deep or wrapper[i].key == deep or wrapper[i].key.startswith(f"{deep}/")}


def packed(expression: list[Unit]) -> str:
    return json.dumps([u.row() for u in expression])


def unpacked(text: str) -> list[Unit]:
    return [Unit(*row) for row in json.loads(text)]


# ---------------------------------------------------------------- jobs

def host():
    """Lower-cased host of the url; null if there is none."""
    found = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, constant): the wrapper as JSON, and hashes of (unit key, text) that most of the host's pages have."""

    def read(batches):
        for batch in batches:
            exprs, texts, whole = [], [], []
            for page in batch.column("html"):
                found = slots(page.as_py())
                expression, _ = units(found)
                exprs.append(packed(expression))
                own = [text_hash(f"{s.key}\0{s.text}") for s in found if not s.outside and not s.inside]
                texts.append(sorted(set(own)))
                whole.append(xxhash.xxh3_128_digest("\0".join(f"{s.key}\0{s.text}\0{s.links}" for s in found).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(exprs), pa.array(texts, pa.list_(pa.int64())), pa.array(whole, pa.binary())],
                ["host", "expr", "texts", "page"])

    parsed = stage(pages.select(host().alias("host"), "html").filter("host IS NOT NULL").mapInArrow(
        read, "host string, expr string, texts array<long>, page binary"), "pages")
    parsed = parsed.dropDuplicates(["host", "page"])  # copies are no evidence
    size = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    often = parsed.select("host", F.explode("texts").alias("t")).groupBy("host", "t").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3")
    # of the texts of a page on average at most two are on more than half of a host's pages
    constant = often.join(size, "host").filter("2 * c > n").groupBy("host").agg(F.collect_list("t").alias("constant"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "expr"], ascending=[False, True])
        whole = None
        for text in rows["expr"]:
            whole = unpacked(text) if whole is None else align(whole, unpacked(text))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "expr": [packed(whole)], "n": [int(rows["n"].sum())]})

    kind = "host string, expr string, n long"
    now = parsed.select("host", "expr", F.lit(1).cast("long").alias("n"))
    while True:
        sized = now.groupBy(F.col("host").alias("_h")).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("_groups"))
        dealt = now.join(sized, F.col("host") == F.col("_h")).withColumn("_g", F.pmod(F.xxhash64("expr", "n"), F.col("_groups")))
        # dealt by both columns, or the groups of a hot host would share its task
        now = stage(dealt.select("host", "expr", "n", "_g").repartition("host", "_g").groupBy("host", "_g").applyInPandas(merge, kind), "wrappers")
        if (now.groupBy("host").count().agg(F.max("count")).first()[0] or 1) == 1:
            break
    wrappers = now.select(F.col("host").alias("_host"), F.col("expr").alias("wrapper"))
    return stage(wrappers.join(constant, F.col("_host") == F.col("host"), "left").select(F.col("_host").alias("host"), "wrapper", "constant"), "host-wrappers")


def page_text(found: list[Slot], wrapper: list[Unit] | None, constant: set[int], known: dict[str, set[int]]) -> str:
    """Text of a page by its host's wrapper; without one by its own expression.

    ``known`` keeps which units are content, by expression.
    """
    expression, of = units(found)
    main = any(u.key.startswith("*") for u in expression)
    if main:
        kept = [s.text for s, u in zip(found, of) if expression[u].key.startswith("*")]
        return "\n\n".join(kept)
    name = "\0".join(u.key for u in expression)
    if wrapper is None:
        allowed = content_units(expression)
    elif name in known:
        allowed = known[name]
    else:
        good = content_units(wrapper)
        allowed = known[name] = {i for i, j in paired(expression, wrapper) if i is not None and j in good}
    own = [s for s, u in zip(found, of) if u in allowed and not s.outside]
    changing = [s for s in own if text_hash(f"{s.key}\0{s.text}") not in constant]
    # where nothing but constant texts is there, they are the page
    return "\n\n".join(s.text for s in (changing or own))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with the main text of their html as ``text``, html dropped."""
    lean_batches(pages.sparkSession)
    pages = pages.drop("text")
    found = infer_wrappers(pages).select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"), F.col("constant").alias("_constant"))
    # a wrapper goes with each of its pages: send it by number of the host, once a batch
    joined = pages.withColumn("_key", host()).join(found, F.col("_key") == F.col("_host"), "left").drop("_key")
    shape = with_fields(pages.drop("html"), text="string")

    def run(batches):
        wrappers: dict[str, tuple] = {}
        for batch in batches:
            out = []
            names, htmls = batch.column("_host").to_pylist(), batch.column("html")
            for i, name in enumerate(names):
                if name is not None and name not in wrappers:
                    if len(wrappers) > 1000:
                        wrappers.clear()
                    wrappers[name] = unpacked(batch.column("_wrapper")[i].as_py()), set(batch.column("_constant")[i].as_py() or ()), {}
                wrapper, constant, known = wrappers[name] if name is not None else (None, set(), {})
                out.append(page_text(slots(htmls[i].as_py()), wrapper, constant, known))
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in shape.names]
            yield pa.RecordBatch.from_arrays(columns, shape.names)

    return joined.mapInArrow(run, shape)
