"""Main text of web pages by tag-path ratios.

Text is gathered per root-to-leaf tag path: its length, its punctuation and its share inside links. Paths of much
running text per node are content, paths of short or linked text are not. The fused ratio is smoothed along the page, so
that short blocks between long ones stay, and paths above a share of the page's strongest are kept.

Where a page names its article (``article`` or ``main``), the same ratio chooses among these elements, and all text blocks of the
chosen ones stay, short, linked or tabular ones too; only what is named as something else inside of them is left out.
"""

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A path is kept from this share of the strongest smoothed ratio of the page on.
THRESHOLD = 0.02
#: Paths and articles with this share of their text inside links are menus or teasers.
LINKED = 0.75
#: Weights of a node's neighbours, by distance, when ratios are smoothed.
KERNEL = (0.25, 0.5, 1.0, 0.5, 0.25)

# Names that HTML gives to elements.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head", "object",
               "canvas", "audio", "video"}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4",
                  "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure", "menu"}
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
# Words in class, id or role that name something else than the article.
OTHER_WORDS = set(
    "ad ads advert adverts advertisement advertising adbox banner sponsored sponsor promo promotion comment comments disqus "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog sidebar side aside rail widget "
    "menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot bottom copyright legal share sharing "
    "social related recommended recommendations subscribe subscription newsletter signup login search searchbox toolbar "
    "pagination pager replies reply respond discussion feedback complementary contentinfo skip disclaimer hidden".split())
# Of these, the words that say so inside an article too, where headers, tops and searches may be the article's own.
STRONG_WORDS = set(
    "ad ads advert adverts advertisement advertising adbox sponsored sponsor promo promotion comment comments disqus cookie "
    "cookies consent gdpr popup modal overlay dialog sidebar nav navbar navigation breadcrumb breadcrumbs related recommended "
    "recommendations subscribe subscription newsletter signup login pagination pager replies respond complementary contentinfo "
    "hidden".split())
WEAK_WORDS = set("banner notice notices notification alert share sharing social copyright disclaimer toolbar menu aside footer".split())
# Words that go with those and change nothing about them.
COMPANIONS = set(
    "list section box block container wrapper wrap area slot unit button buttons bar link links item items icon icons form count "
    "thread posts articles stories text content body left right top bottom inline site page main media message row col".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/?$)|aria-hidden\s*=\s*[\"']?true)", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


def _named(attributes):
    """The values of class, id and role, each as a list of names, each name as the set of its words."""
    values = ("".join(filter(None, m.groups())).lower().split() for m in _NAMED.finditer(attributes))
    return [[set(re.split(r"[^a-z]+", name)) - {""} for name in value] for value in values]


def _strong(names):
    """Whether one name says that this isn't the article even inside an article: a strong word and nothing but companions."""
    return any(n & STRONG_WORDS and n <= STRONG_WORDS | WEAK_WORDS | COMPANIONS for n in names)


def _other(name, attributes, within_article):
    """Whether an element is something else than the article by its name or what it is called.

    Outside of ``article`` and ``main`` one word is enough. Inside, a name has to consist of such words (``ad-slot``, but not
    ``share-price``), and weak words count only if all names of the element are like that.
    """
    if name in BOILERPLATE:
        return not (name == "header" and within_article)
    if not attributes or name in ("html", "body", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    values = _named(attributes)
    if within_article or name == "article" or name in INLINE:
        weak = name not in INLINE and any(
            v and all(n & (STRONG_WORDS | WEAK_WORDS) and n <= STRONG_WORDS | WEAK_WORDS | COMPANIONS for n in v) for v in values)
        return weak or any(_strong(v) for v in values)
    return any(n & OTHER_WORDS for v in values for n in v)


def blocks(page):
    """Text blocks of a page in order: (path, text, characters inside links, number of the outermost ``article`` or 0, whether in
    ``main``). Text of elements that are something else is left out.
    """
    found, stack, parts, linked = [], [], [], 0
    at, raw, links, others = 0, None, 0, 0
    # Open elements of these names, articles seen, and an open inline element that is something else: name, depth, stack below it.
    inside, seen, inline = {"article": 0, "main": 0}, 0, None

    def close_block():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                found.append((".".join(n for n, _ in stack), text, linked, seen if inside["article"] else 0, inside["main"] > 0))
        parts, linked = [], 0

    def pop():
        nonlocal others, inline
        name, other = stack.pop()
        others -= other
        if name in inside:
            inside[name] -= 1
        if inline and len(stack) < inline[2]:
            others, inline = others - 1, None

    def add(text):
        nonlocal linked
        if not others and text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        add(page[at:token.start()])
        at = token.end()
        name = token.group(2)
        if name is None:
            continue
        name, closing, attributes = name.lower(), token.group(1), token.group(3)
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                raw = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = raw.end() if raw else len(page)
        elif name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            if name == "br":
                add(" ")
            elif inline and name == inline[0]:
                inline[1] += -1 if closing else 1
                if not inline[1]:
                    others, inline = others - 1, None
            elif not inline and not closing and attributes and name not in VOID and _other(name, attributes, True):
                others, inline = others + 1, [name, 1, len(stack)]
        elif closing:
            close_block()
            if any(n == name for n, _ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
                links = 0
        else:
            close_block()
            if name in ENDS_PARAGRAPH and stack and stack[-1][0] == "p":
                pop()
            ends = ENDS_LIKE.get(name, ())
            while stack and stack[-1][0] in ends:
                pop()
            if name not in VOID and not attributes.endswith("/"):
                other = _other(name, attributes, any(inside.values()))
                stack.append((name, other))
                others += other
                if name in inside:
                    seen += name == "article" and not inside["article"]
                    inside[name] += 1
    if at < len(page):
        add(page[at:])
    close_block()
    return found


def content(page, threshold=THRESHOLD):
    """Main text of one page: kept blocks joined by a line break; empty if there is none."""
    found = blocks(page) if page else []
    if not found:
        return ""
    paths, ids = np.unique([p for p, *_ in found], return_inverse=True)
    length = np.array([len(t) for _, t, *_ in found], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, t, *_ in found], float)
    linked = np.minimum([x for _, _, x, *_ in found], length)
    article, main = np.array([a for *_, a, _ in found]), np.array([m for *_, m in found])

    def ratios(groups, n):
        """Per group of blocks: length and punctuation per block, fused (linked text doesn't count), and the share of linked text."""
        total = lambda x: np.bincount(groups, x, n)
        blocks_of = np.maximum(np.bincount(groups, minlength=n), 1)
        fused = (total(length) - total(linked)) / blocks_of * (1 + total(marks) / blocks_of)
        return fused, total(linked) / np.maximum(total(length), 1)

    fused, share = ratios(ids, len(paths))
    reach = len(KERNEL) // 2
    smooth = np.convolve(fused[ids], KERNEL)[reach:reach + len(ids)] / np.convolve(np.ones(len(ids)), KERNEL)[reach:reach + len(ids)]
    # A path is kept or left as a whole, by the best place it has.
    best = np.zeros(len(paths))
    np.maximum.at(best, ids, smooth)
    kept = ((best >= threshold * best.max()) & (share < LINKED))[ids]
    # Named articles are kept or left as a whole too, so that teasers of other pages go and no part of the article does.
    strength, share = ratios(article, article.max() + 1)
    chosen = (strength >= threshold * strength[1:].max(initial=0)) & (strength > 0) & (share < LINKED)
    chosen[0] = False
    if chosen.any():
        title = np.array([p.endswith(".h1") for p, *_ in found])
        kept = chosen[article] | (main & (article == 0) & (kept | title))
    elif (length - linked)[main].sum() > 0:
        kept = main
    return "\n".join(t for (_, t, *_), stays in zip(found, kept) if stays)


def extract(pages: DataFrame, html="html", into="text") -> DataFrame:
    """``pages`` without the markup column, with the main text in ``into`` (a column of that name is replaced).

    A null or empty page, and one without any text of its own, give the empty text. Equal rows stay separate rows. Each page is
    read whole; pages don't depend on each other, so nothing is shuffled.
    """
    kept = [c for c in pages.columns if c not in (html, into)]
    carried = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").alias("__html"))

    def read(batches):
        for batch in batches:
            texts = [content(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, into])

    return small_batches(carried).mapInArrow(read, carried.drop("__html").withColumn(into, F.lit("")).schema)
