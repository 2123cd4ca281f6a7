"""Main text of web pages by tag-path ratios.

Every block of a page has the path of tags from the root to it. Text length and punctuation are summed over the blocks of a path,
the two ratios per block are smoothed over neighbouring paths and fused; what the tags, roles and names of a path say against it is one
more factor. Paths above a threshold hold content. The article is the outermost <article> or <main> around nearly all of that content; in
pages without one, the smallest element with all of it, widened to its ancestors up to the menus, headers and footers of the page. Other
blocks of the article, such as headings and lists, are its text unless tags or names mark them, however short they are beside its longest
paragraphs. A name in doubt is decided by the paths below it. A form around the article is no form of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import text_batches

# Names of HTML elements, and of the parts of pages that aren't their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title xmp object canvas audio video annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mfenced".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"div", "td", "th", "li", "article", "section", "body", "main", "blockquote", "aside", "footer", "header", "nav", "form", "figure", "button"}}
NOT_TEXT = frozenset("head nav footer aside form button select dialog menu option datalist".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NOT_NAMES = frozenset("nav navbar navigation menu footer foot sidebar sidenav aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond discussion feedback share sharing social breadcrumb breadcrumbs related recommended recommendations pagination pager toolbar widget widgets copyright legal disclaimer form search skip hidden masthead topbar".split())
IS_NAMES = frozenset("content article main post body entry story text page".split())
#: Names that say by themselves that an element isn't article text; the second set only as a class, the third only outside an article.
SURE_NAMES = frozenset("navbar sidenav sidebar footer ad ads advert adverts advertisement sponsored comment comments commentlist disqus share sharing breadcrumb breadcrumbs newsletter subscribe signup pager pagination toolbar widget widgets popup modal masthead topbar".split())
SURE_CLASSES = SURE_NAMES | frozenset("nav notice notices alert promo banner hidden overlay login related recommended copyright disclaimer".split())
SURE_OUTSIDE = SURE_CLASSES | frozenset("navigation menu foot advertising sponsor promotion cookie cookies consent gdpr notification subscription reply replies respond recommendations aside".split())
#: Words that may stand beside a sure name in a class or id and change nothing.
NEUTRAL = frozenset("box bar wrap wrapper container inner outer list item items block area section panel group row column col site page main post posts entry article story content body text top bottom left right primary secondary global button buttons link links slot unit form js sticky fixed mobile desktop".split())
#: Elements whose id is an anchor of the text, never the name of a part of the page.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre li dt dd td th tr figcaption caption".split())
#: Tags, roles and parts of names of what surrounds the article of a page.
FURNITURE = frozenset("nav navbar sidenav navigation menu menubar header footer foot banner contentinfo masthead topbar sidebar".split())
#: Whether an element is article text: it may be, it may only if the paths of its text hold content, it isn't.
NO, PERHAPS, YES = 0, 1, 2
WHOLE = frozenset("html body article main".split())
#: Elements that hold running text.
RUNNING = frozenset("p li dd dt td th blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A class that shows an element again on some screens.
SHOWN = re.compile(r":(block|flex|grid|table|contents|inline\b)")
#: A button without markup that its sentence goes on after.
IN_SENTENCE = re.compile(r"[^<]*+</button\s*+>\s*+[^<\s]", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Smoothing over neighbouring paths, share of the best path that content has at least, and content outside the article; share of content
#: that the article holds; factor of paths that their tags or names mark as something else.
KERNEL, THRESHOLD, OUTSIDE, HELD, MARKED = np.array([0.1, 0.8, 0.1]), 0.15, 0.5, 0.8, 1e-6


@dataclass
class Element:
    tag: str
    label: str
    parent: int
    other: int
    inner: bool
    attributes: str = ""
    furniture: bool = False


@dataclass
class Block:
    element: int
    linked: int = 0
    parts: list[str] = field(default_factory=list)


def names_other(tag: str, attributes: str, inner: bool) -> int:
    """Whether a tag, its role, class or id say that this isn't part of the article: NO, PERHAPS or YES.

    A header within an article is its title. A class or id counts there only as a whole and if it means nothing else; outside, a name
    that has a part of NOT_NAMES beside other words, or an ambiguous one, makes it PERHAPS.
    """
    if tag in NOT_TEXT or (tag == "header" and not inner):
        return YES
    if not attributes or tag in WHOLE:
        return NO
    known = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    bare = ATTRIBUTE.sub("", attributes).lower().split()
    if "hidden" in bare or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", "").lower():
        return YES
    if known.get("role", "").lower() in NOT_ROLES:
        return YES
    anchored, other = tag in ANCHORED, NO
    for kind in ("class",) if anchored else ("class", "id"):
        sure = SURE_OUTSIDE if not inner and not anchored else SURE_CLASSES if kind == "class" else SURE_NAMES
        for name in known.get(kind, "").split():
            parts = {p.lower() for p in NAME_PARTS.findall(name)}
            if kind == "class" and parts == {"hidden"} and SHOWN.search(known["class"]):
                continue
            if parts & sure and parts <= NOT_NAMES | NEUTRAL:
                return YES
            if inner or anchored or parts & {"with", "has", "no"}:
                continue
            if "header" in parts and parts <= {"header", "site", "top", "global", "masthead", "nav"}:
                return YES
            if parts & NOT_NAMES and not parts & IS_NAMES:
                other = PERHAPS
    return other


def names_furniture(tag: str, attributes: str) -> bool:
    """Whether an element that isn't article text is a menu, header or footer of the page."""
    known = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = " ".join(known.get(k, "") for k in ("class", "id", "role"))
    return tag in FURNITURE or any(p.lower() in FURNITURE for p in NAME_PARTS.findall(names))


def tag_end(page: str, at: int) -> int:
    """Where the tag ends whose attributes begin at `at`, quoted values aside; -1 if a quote or the tag is never closed."""
    while m := QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements and text blocks of a page in order; unclosed and stray tags are taken as browsers take them, roughly."""
    elements, blocks = [Element("", "", -1, NO, False)], []
    stack, at, n = [0], 0, len(page)
    block: Block | None = None
    last_end, open_, unclosed, failed = page.rfind(">"), Counter(), set(), 0

    def text(raw: str) -> None:
        nonlocal block
        if block is None:
            if not raw.strip():
                return
            k = len(stack) - 1
            while k and elements[stack[k]].tag in INLINE:
                k -= 1
            block = Block(stack[k])
            blocks.append(block)
        block.parts.append(raw)
        if any(elements[k].tag == "a" for k in stack[-3:]):
            block.linked += len(raw.strip())

    while at < n:
        less = page.find("<", at)
        if less < 0:
            text(page[at:])
            break
        if less > at:
            text(page[at:less])
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = n if end < 0 else end + 3
            continue
        if page[less + 1 : less + 2] in ("!", "?"):
            end = page.find(">", less)
            at = n if end < 0 else end + 1
            continue
        if less > last_end:
            text(page[less:])
            break
        m = NAME.match(page, less)
        if not m:
            text("<")
            at = less + 1
            continue
        # Tags with quotes that are never closed end at the next >; after many of them all tags do, so time stays linear.
        end = tag_end(page, m.end()) if failed <= 4 * n else -1
        if end < 0:
            failed += n - less
            end = page.find(">", m.end())
        at, closing, tag, attributes = end + 1, m[1], m[2].lower(), page[m.end() : end]
        if tag == "br" or (tag in VOID and tag in INLINE):
            text(" ")
            continue
        if tag in VOID:
            block = None
            continue
        if tag == "button" and block is not None and not closing and elements[block.element].tag in RUNNING and IN_SENTENCE.match(page, at):
            continue
        if tag == "button" and closing and not open_["button"]:
            continue
        if tag not in INLINE and (tag not in RAW or tag == "xmp"):
            block = None
        if closing:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if elements[stack[k]].tag == tag:
                    cut(stack, k, elements, open_)
                    break
                if tag in INLINE and elements[stack[k]].tag not in INLINE:
                    break
            continue
        if tag in RAW:
            end = None if tag in unclosed else re.compile(f"</{re.escape(tag)}\\s*>", re.IGNORECASE).search(page, at)
            if end is None:
                unclosed.add(tag)
            at = end.end() if end else n if tag in ("script", "style") else at
            continue
        if tag in CLOSES_P:
            close_open(stack, elements, open_, {"p"}, SCOPES["p"])
        if tag in SIBLINGS and tag != "p":
            close_open(stack, elements, open_, SIBLINGS[tag], SCOPES[tag])
        if tag in ("body", "html") and open_[tag]:
            continue
        if tag == "body" and open_["head"]:
            cut(stack, next(k for k, e in enumerate(stack) if elements[e].tag == "head"), elements, open_)
        parent = elements[stack[-1]]
        inner = parent.inner or tag in ("article", "main")
        elements.append(Element(tag, tag, stack[-1], names_other(tag, attributes, parent.inner), inner, attributes))
        if not attributes.endswith("/") or tag not in INLINE:
            stack.append(len(elements) - 1)
            open_[tag] += 1
    settle(elements, blocks)
    return elements, blocks


def settle(elements: list[Element], blocks: list[Block]) -> None:
    """What each element is by itself becomes what it is within its page: parts of what isn't the article aren't either.

    A form that holds an article or main element, or else most running text of the page, stands around the page; its names alone count.
    """
    if any(e.tag == "form" for e in elements):
        running, articles = np.zeros(len(elements)), np.zeros(len(elements))
        marked = inherited(elements, lambda k, above: int(above or (elements[k].tag != "form" and elements[k].other == YES)))
        for b in blocks:
            if elements[b.element].tag in RUNNING and not marked[b.element]:
                running[b.element] += sum(len(x.strip()) for x in b.parts)
        for k, e in enumerate(elements):
            articles[k] = e.tag in ("article", "main")
        running, articles = gathered(elements, running), gathered(elements, articles)
        for k, e in enumerate(elements):
            if e.tag == "form" and (articles[k] or (not articles[0] and 2 * running[k] > running[0])):
                e.other = names_other("div", e.attributes, e.inner)
    for e in elements[1:]:
        above = elements[e.parent].other
        own, e.other = e.other, YES if above == YES else max(above, e.other)
        e.furniture = own > above and names_furniture(e.tag, e.attributes)


def cut(stack: list[int], k: int, elements: list[Element], open_: Counter) -> None:
    """Closes the open elements from the k-th on."""
    for e in stack[k:]:
        open_[elements[e].tag] -= 1
    del stack[k:]


def close_open(stack: list[int], elements: list[Element], open_: Counter, tags: set[str], scope: set[str]) -> None:
    """Closes the innermost open element of these tags, unless one of `scope` stands between."""
    if not any(open_[t] for t in tags):
        return
    for k in range(len(stack) - 1, 0, -1):
        tag = elements[stack[k]].tag
        if tag in tags:
            cut(stack, k, elements, open_)
            return
        if tag in scope:
            return


def path_scores(paths: list[int], lengths: list[int], marks: list[int], factors: list[float]) -> np.ndarray:
    """The fused score of the path of each block: mean text length and mean punctuation a block, each smoothed over neighbouring paths,
    times the path's factor."""
    _, first, place = np.unique(np.array(paths), return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    place = rank[place]
    sums = np.array([np.bincount(place, w, len(first)) for w in (lengths, marks, np.ones(len(paths)))])
    ratios = sums[:2] / sums[2]
    smooth = np.array([np.convolve(np.pad(r, 1, "edge"), KERNEL, "valid") for r in ratios])
    fused = smooth[0] * (1 + smooth[1])
    factor = np.ones(len(first))
    factor[place] = factors
    return (fused * factor)[place]


def scored(elements: list[Element], paths: list[int], found: list[tuple[int, str]]) -> np.ndarray:
    """Scores of blocks as shares of the highest one."""
    factors = [MARKED if elements[e].other == YES else 1.0 for e, _ in found]
    scores = path_scores(paths, [len(t) for _, t in found], [len(PUNCTUATION.findall(t)) for _, t in found], factors)
    return scores / scores.max()


def inherited(elements: list[Element], own: Callable[[int, int], int]) -> list[int]:
    """A value of each element from its own index and its parent's value, parents first."""
    out: list[int] = []
    for k, e in enumerate(elements):
        out.append(own(k, out[e.parent] if e.parent >= 0 else 0))
    return out


def gathered(elements: list[Element], values: np.ndarray) -> np.ndarray:
    """Sums over each element and all below it."""
    out = values.copy()
    for k in range(len(elements) - 1, 0, -1):
        out[elements[k].parent] += out[k]
    return out


def widened(elements: list[Element], blocks: list[Block], around: int) -> tuple[int, list[int]]:
    """(article, whether each element lies in a menu): the element around all content, widened to its ancestors until one would add
    furniture of the page.

    Adverts, comments and the like beside the text are left out by their scores and don't end it; nor do menus, which are elements
    outside that element with several blocks of nothing but links.
    """
    chain = [around]
    while elements[chain[-1]].parent >= 0:
        chain.append(elements[chain[-1]].parent)
    on = set(chain)
    nearest = inherited(elements, lambda k, above: k if k in on else above)
    ends = {nearest[k] for k, e in enumerate(elements) if e.furniture}
    values = np.zeros((len(elements), 3))
    for b in blocks:
        if elements[b.element].other != YES:
            n = sum(len(x.strip()) for x in b.parts)
            values[b.element] += n, b.linked, n > 0
    n, linked, count = gathered(elements, values).T
    inside = inherited(elements, lambda k, above: int(above or k == around))
    menus = inherited(elements, lambda k, above: int(above or (count[k] > 1 and linked[k] >= 0.9 * n[k] and not inside[k] and k not in on)))
    top = 0
    while top + 1 < len(chain) and chain[top + 1] not in ends:
        top += 1
    return chain[top], menus


def main_text(page: str | None) -> tuple[str, int]:
    """(text, number of tag paths) of a page."""
    if not page:
        return "", 0
    elements, blocks = parse(page)
    found = []
    for b in blocks:
        text = " ".join(html.unescape("".join(b.parts)).split())
        if text:
            found.append((b.element, text))
    if not any(elements[e].other != YES for e, _ in found):
        return "", 0
    # A path is numbered by its parent's number, its tag, and what its names say.
    numbers: dict[tuple[int, str, bool], int] = {}
    path = inherited(elements, lambda k, above: numbers.setdefault((above, elements[k].tag, elements[k].other == YES), len(numbers) + 1))
    doubt = inherited(elements, lambda k, above: above or (k if elements[k].other == PERHAPS else 0))
    paths, count = [path[e] for e, _ in found], len({path[e] for e, _ in found})
    score = scored(elements, paths, found)
    # What may be no article text stays whole if the paths of at least half of its text hold content, and goes whole otherwise; a page
    # of nothing else stays.
    doubted: dict[int, int] = {}
    for (e, t), x in zip(found, score, strict=True):
        if elements[e].other != YES:
            doubted[doubt[e]] = doubted.get(doubt[e], 0) + (len(t) if x >= THRESHOLD else -len(t))
    stays = [elements[e].other == YES or not doubt[e] or doubted[doubt[e]] >= 0 for e, _ in found]
    if not all(stays) and any(s and elements[e].other != YES for (e, _), s in zip(found, stays, strict=True)):
        found, paths = ([x for x, s in zip(xs, stays, strict=True) if s] for xs in (found, paths))
        score = scored(elements, paths, found)
    content, total = np.zeros(len(elements)), 0
    for (e, t), x in zip(found, score, strict=True):
        if x >= THRESHOLD:
            content[e] += len(t)
            total += len(t)
    weight, depth = gathered(elements, content), inherited(elements, lambda k, above: above + 1)
    # The deepest element that holds enough lies in an article element, or the blocks themselves say how far the article reaches.
    article = max((k for k in np.nonzero(weight >= HELD * total)[0].tolist()), key=lambda k: (depth[k], k))
    held, menus, k = None, [0] * len(elements), article
    while k >= 0:
        held, k = (k if elements[k].tag in ("article", "main") else held), elements[k].parent
    if held is None:
        around = max((k for k in np.nonzero(weight >= total)[0].tolist()), key=lambda k: (depth[k], k))
        held, menus = widened(elements, blocks, around)
    inside = inherited(elements, lambda k, above: int(above or k == held))
    return "\n".join(t for (e, t), x in zip(found, score, strict=True) if x >= OUTSIDE or (inside[e] and (x >= THRESHOLD if menus[e] else elements[e].other != YES))), count


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_paths) of every row of pages (page_id, url, html).

    Null and empty pages, and pages without text, give an empty text; null ids and urls stay null; repeated rows stay; other columns
    are ignored. White space inside a block becomes one space, blocks are joined by a line feed in page order.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for part in text_batches(texts):
                got = [main_text(t) for t in texts[part]]
                here = b.slice(part.start, len(got))
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([k for _, k in got], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_paths"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long, n_paths long")
