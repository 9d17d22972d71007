"""Main text of web pages by the maximum-scoring run of words and tags.

A page is read as a stream of tags and blocks of text. Every word has a positive score where
text like it is usually content and a negative one where it is not (in links, in boilerplate
elements); every tag has a negative score, the larger the more it stands outside content. The run of
the stream with the highest sum, found by one linear scan, is the content region; its
blocks outside boilerplate elements are the text. Where that run meets content marks (``article``, ``main``;
the outermost), their edges bound the region: all of them it meets, whole, and nothing beside them.

The scores come from labelled pages: those that mark their content with ``article`` or ``main``. All of
them are counted (words by kind, tags by name, inside and outside the mark), with prior
counts for what they rarely show, so a page without marks is read by what marked pages teach.

Boilerplate elements: by name (menus, headers and footers, asides, forms, scripts, ...) and blocks, but not
headings, by a word of class or role or a whole id or label; inside the content mark by a whole class or role only. A page header inside the content mark that holds the title is content.
Scripts, pictures and controls amid a paragraph are left out and do not end it. A page whose text all stands in a form is read as if the form
were no boilerplate.

Defined results: null or empty html and pages without content give an empty text; malformed or cut-off
markup is read as far as it goes (a raw-text element without end takes the rest); an empty table gives
no rows; repeated rows are read each; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survlake.llm.tables import ship

# Names of HTML elements by their part in a page.
RAW = {"script", "style", "iframe", "textarea", "title"}
NESTED = {"noscript", "template", "svg", "object", "canvas"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BOILER = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "label", "fieldset"} | RAW | NESTED
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s",
          "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "big", "strike", "acronym", "nobr"}
MARKS = {"article", "main"}
NAMES = INLINE | BOILER | MARKS | VOID | {"p", "div", "section", "header", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt",
                                          "dd", "table", "tr", "td", "th", "tbody", "thead", "blockquote", "pre", "figure", "figcaption", "body", "html"}
HINTS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|"
                   r"sidebar|side-bar|aside|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|disqus|replies|respond|"
                   r"share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|signup|login|search|pagination|pager|"
                   r"widget|toolbar|copyright|legal|disclaimer|skip|contentinfo|complementary|alert)(?=$|[\s_-])", re.I)
# Boilerplate that may stand amid a line of text
AMID = {"script", "style", "svg", "canvas", "object", "iframe", "button", "select", "label", "textarea", "noscript", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Prior counts of (inside, outside) that stand for about 20 observations.
PRIOR = {"word": (18, 2), "word in a link": (3, 17), "word in boilerplate": (0, 20), "p": (18, 2), "li": (8, 12), "a": (4, 16)}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_UNQUOTED = re.compile(r"""=[^\s"'>]+/>\Z""")  # the / belongs to a value
_ATTR = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def hinted(name: str, attrs: str, marked: bool) -> bool:
    """Whether attributes make a block boilerplate: inside a content mark only by a whole class or role, outside also by part of one or a whole id or label."""
    if name in INLINE | HEADINGS | MARKS | {"body", "html", "p"}:
        return False
    for key, *values in _ATTR.findall(attrs):
        value = "".join(values).strip()
        if key.lower() in ("class", "role"):
            if any(HINTS.fullmatch(t) for t in value.split()) or not marked and HINTS.search(value):
                return True
        elif not marked and HINTS.fullmatch(value):
            return True
    return False


def stream(page: str, forms: bool = True) -> Iterator[tuple[str, str, bool, bool, int]]:
    """(tag name or "", text, in a link, in boilerplate, number of the outermost content mark it is in or 0) in page order.

    Names of end tags begin with /. ``forms`` says whether forms are boilerplate.
    """
    at, stack = 0, []  # open elements: (name, boilerplate)
    links = boiler = marks = seen = 0
    opened: Counter = Counter()  # how many elements of a name are open
    while at < len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            yield "", page[at:end], links > 0, boiler > 0, seen if marks else 0
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if not closing and name in (RAW | NESTED) - {"script", "style"} and m[0].endswith("/>") and not _UNQUOTED.search(m[0]):
            yield name, "", links > 0, True, seen if marks else 0
            continue
        if not closing and name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            yield name, "", links > 0, True, seen if marks else 0
            continue
        if closing:
            if opened[name]:
                while True:
                    top, bad = stack.pop()
                    opened[top] -= 1
                    links -= top == "a"
                    marks -= top in MARKS
                    boiler -= bad
                    if top == name:
                        break
            yield "/" + name, "", links > 0, boiler > 0, seen if marks else 0
            continue
        if name in MARKS | {"body"} and boiler:  # an element left open before the content does not swallow it
            while stack:
                top, bad = stack.pop()
                opened[top] -= 1
                links -= top == "a"
                boiler -= bad
                marks -= top in MARKS
        if name not in VOID:
            bad = name in BOILER and (forms or name != "form") or name == "header" and not marks or hinted(name, m[3] or m[6] or "", marks > 0)
            stack.append((name, bad))
            opened[name] += 1
            links += name == "a"
            seen += name in MARKS and not marks
            marks += name in MARKS
            boiler += bad
        yield name, "", links > 0, boiler > 0, seen if marks else 0


def kind(link: bool, boiler: bool) -> str:
    return "word in boilerplate" if boiler else "word in a link" if link else "word"


def observe(page: str) -> Counter:
    """Counts of (feature, inside the mark and no boilerplate) of one labelled page."""
    seen: Counter = Counter()
    parts = list(stream(page))
    if not any(p[0] in MARKS for p in parts):
        return seen
    for name, text, link, boiler, mark in parts:
        inside = mark > 0 and not boiler
        if name:
            seen[name if name.lstrip("/") in NAMES else "other", inside] += 1
        elif n := len(text.split()):
            seen[kind(link, boiler), inside] += n
    return seen


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Score of each feature: words from -0.3 to 1 by their share inside, tags from -1.5 to -0.1.

    Negative scores are small against words: a region reaches across a link or an advert in its
    middle (whose own block is left out) but not across a menu to the next few words.
    """
    out = {}
    for f in {k for k, _ in counts} | set(PRIOR) | {"other"}:
        a, b = PRIOR.get(f, (10, 10))
        share = (counts.get((f, True), 0) + a) / (counts.get((f, True), 0) + counts.get((f, False), 0) + a + b)
        word = 2 * share - 1
        out[f] = (word if word > 0 else 0.3 * word) if f.startswith("word") else -0.1 - 1.4 * (1 - share)
    out["word"] = max(out["word"], 0.2)
    return out


def main_text(page: str, score: dict[str, float]) -> str:
    """The blocks of the maximum-scoring run, or of the content marks it meets, one a line."""
    return _main_text(page, score, True) or _main_text(page, score, False)


def _main_text(page: str, score: dict[str, float], forms: bool) -> str:
    blocks: list[list] = []  # pieces of text, boilerplate, words' score, tags' score before, content mark
    current: dict[bool, list | None] = {False: None, True: None}  # the block that further text of content, of boilerplate, goes to
    tags, names = 0.0, set()
    for name, text, link, boiler, mark in stream(page, forms):
        if name:
            bare = name.lstrip("/")
            names.add(bare)
            tags += score.get(name if bare in NAMES else "other", score["other"])
            if bare not in INLINE and bare not in AMID:
                current[True] = None
                if not boiler:
                    current[False] = None
            continue
        block = current[boiler]
        if not text.strip():
            if block:
                block[0].append(" ")
            continue
        worth = len(text.split()) * score[kind(link, boiler)]
        if block and block[4] == mark:
            block[0].append(text)
            block[2] += worth + tags
        else:
            current[boiler] = block = [[text], boiler, worth, tags, mark]
            blocks.append(block)
        tags = 0.0
    if not forms and not ("form" in names and names & (MARKS | {"p"})):  # a form of controls only holds no article
        return ""
    best, run, start, region = 0.0, 0.0, 0, (0, 0)
    for i, (_, _, worth, before, _) in enumerate(blocks):
        run = run + before if run > 0 else 0.0
        if run <= 0:
            run, start = 0.0, i
        run += worth
        if run > best:
            best, region = run, (start, i + 1)
    met = {b[4] for b in blocks[region[0]:region[1]] if b[4] and not b[1]}
    inside = [b for b in blocks if b[4] in met] if met else blocks[region[0]:region[1]]
    lines = (" ".join(html.unescape("".join(t)).split()) for t, boiler, _, _, _ in inside if not boiler)
    return "\n".join(x for x in lines if x)


def fit(pages: DataFrame) -> dict[str, float]:
    """Scores from all labelled pages: a count per feature comes to the driver, and features are a fixed list."""
    ship(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                seen.update(observe(x or ""))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.bool_()),
                                          pa.array([seen[k] for k in keys], pa.int64())], names=["feature", "inside", "n"])

    rows = (pages.select("html").mapInArrow(run, "feature string, inside boolean, n long")
            .groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect())
    return weights({(r["feature"], r["inside"]): r["n"] for r in rows})


def extract(pages: DataFrame, score: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    cols = pages.select("page_id", "url", "html")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in cols.schema][:2]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x or "", score) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return cols.mapInArrow(run, ", ".join(kinds) + ", text string, n_chars long")
