"""Main text of web pages: the contiguous region whose words outweigh its tags, with weights learned from labelled pages."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import in_small_batches

# Elements of the HTML standard by the part they play, and the words by which sites name their furniture.
RAW = "script style textarea title"
#: Elements whose content is no text of the page. An unclosed or self-closed one is a tag alone; of RAW, an unclosed one is all of the rest.
UNREAD = frozenset("noscript template svg math iframe object select datalist option button canvas audio video".split())
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul"
)
INLINE = "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label link mark meta q s samp small span strike strong sub sup time tt u var wbr"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup sidebar comment comments commentlist disqus reply replies "
    "respond menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related "
    "recommended recommendations widget popup modal toolbar pagination pager login search".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
CONTENT = frozenset(("article", "main"))

_BLOCKS = frozenset(BLOCKS.split())
_KNOWN = _BLOCKS | frozenset(INLINE.split())
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW.split()) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_NAMES = re.compile(r"[a-z]+")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$|^[^=]*/$")

#: Weights where no labelled page tells: a word, a tag, and a tag of running text.
WORD, TAG, TEXT_TAG = 1.0, -2.0, 0.0
#: The least weight of a tag, and how many occurrences on labelled pages tell as much as the weight it has without them.
LEAST, SUPPORT = -4.0, 50
TEXT_TAGS = frozenset("p br h1 h2 h3 h4 h5 h6 b i em strong span blockquote pre code sub sup q cite abbr u s small".split())


#: Words that a class or id weighs against an element's own if all of its names are names of furniture, else in proportion.
NAMED = 20


#: Names that make a small element an advert whatever stands beside them in its class or id.
ADVERT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())


def marks_of(page: str) -> tuple[list[re.Match], int]:
    """The page's tags, comments and raw elements, and where its text ends: an unclosed comment or raw element takes the rest.

    No tag ends behind the last ">", and none is sought there: a page of tags without an end would be read once for each.
    """
    last = page.rfind(">") + 1
    marks = list(_MARKUP.finditer(page, 0, last))
    whole = len(page)
    if marks and marks[-1].end() == last:
        text = marks[-1].group().lower()
        if (text.startswith("<!--") and not text.endswith("-->")) or (marks[-1]["raw"] and not re.search(rf"</{marks[-1]['raw']}(?=[\s/>])[^>]*>$", text, re.IGNORECASE)):
            return marks, last
    comment = page.find("<!--", last)
    return marks, comment if comment >= 0 else whole


def furniture_share(tag: str, attrs: str, inside: bool) -> float:
    """How far an element is a menu, header, footer, sidebar, notice, advert, form or comment section by its name: 2 by its
    tag, role or hiding, else the largest share of furniture among the names in its class and its id."""
    if tag in FURNITURE or (tag == "header" and not inside):
        return 2.0
    share = 0.0
    if not attrs or tag in ("html", "body") or tag in CONTENT:
        return share
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in FURNITURE_ROLES):
            return 2.0
        if name in ("class", "id"):
            names = _NAMES.findall(value)
            share = max(share, sum(n in FURNITURE_NAMES for n in names) / max(1, len(names)))
    return share


def _elements(marks: list[re.Match]) -> dict[int, int]:
    """The tag that closes an element, by the tag that opens it; elements without an end tag of their own are left out."""
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    out = {}
    for n, m in enumerate(marks):
        tag = (m["tag"] or "").lower()
        if m["close"]:
            if opened[tag]:
                while True:
                    name, first = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        out[first] = n
                        break
        elif tag and tag not in VOID and not (tag in UNREAD and _SELF_CLOSED.search(m["attrs"] or "")):
            if tag in ("p", "option") and stack and stack[-1][0] == tag:
                out[stack.pop()[1]] = n - 1  # ends before the next of its kind
                opened[tag] -= 1
            stack.append((tag, n))
            opened[tag] += 1
    return out


def _left_out(page: str, marks: list[re.Match], ends: dict[int, int]) -> list[bool]:
    """For each tag, whether its class or id makes its element furniture.

    Names weigh against what the element holds: words for it, tags of other than running text against it. An advert's name is
    enough for an element that doesn't hold most of the page's words. All names of
    furniture are enough, unless the element holds most of the page's words or an article or main element; only a comment
    section goes even then, unless it is such a wrapper.
    """
    words, score, articles = [0], [0.0], [0]
    for n, m in enumerate(marks):
        tag = (m["tag"] or "").lower()
        following = page[m.end() : marks[n + 1].start() if n + 1 < len(marks) else len(page)]
        count = len(following.split())
        words.append(words[-1] + count)
        score.append(score[-1] + WORD * count + (TAG if tag and tag not in TEXT_TAGS else 0.0))
        articles.append(articles[-1] + (tag in CONTENT and not m["close"]))
    out = [False] * len(marks)
    for n, m in enumerate(marks):
        attrs = m["attrs"] if m["tag"] and not m["close"] else ""
        share = furniture_share("", attrs, False) if attrs else 0.0
        if not 0 < share <= 1:
            continue
        # an element without an end tag ends with the one around it, which isn't known here: it is weighed by its next tag
        end = ends.get(n, min(n + 1, len(marks)))
        own = words[end] - words[n]
        if articles[end] > articles[n]:
            continue
        if not ADVERT_NAMES.isdisjoint(_names(attrs)) and 2 * own <= words[-1]:
            out[n] = True
        elif share == 1:
            comments = not _COMMENTS.isdisjoint(_NAMES.findall(attrs.lower()))
            out[n] = comments or 2 * own <= words[-1]
        elif m["tag"].lower() not in TEXT_TAGS:  # a heading or paragraph is no wrapper: words beside others in its class say little
            out[n] = score[end] - score[n] - NAMED * share <= 0
    return out


def _names(attrs: str) -> list[str]:
    """The names in an element's class and id."""
    return [x for name, a, b, c in _ATTRIBUTE.findall(attrs) if name.lower() in ("class", "id") for x in _NAMES.findall((a or b or c).lower())]


_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())


def read(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, value, content, skipped) in page order: kind is text or a tag's name, with / before it if it closes.

    ``content``: within an article or main element. ``skipped``: a piece of furniture or within one. An element that is
    never closed ends with the one around it.
    """
    at, until = 0, -1
    stack: list[tuple[str, bool, bool]] = []
    content = skipped = False
    opened: Counter = Counter()  # of the stack, so that an end tag without a start is not sought in it
    marks, whole = marks_of(page)
    ends = _elements(marks)
    named = _left_out(page, marks, ends)
    for n, m in enumerate(marks):
        if n <= until:  # within an element that isn't read
            at = m.end()
            continue
        if m.start() > at:
            yield "text", page[at : m.start()], content, skipped
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["raw"]:
                yield "text", " ", content, skipped
            continue
        tag = tag.lower()
        if tag in UNREAD:
            yield "text", " ", content, skipped
            until = n if m["close"] else ends.get(n, n)
            if n in ends and not marks[until]["close"] and not m["close"]:
                at = marks[until + 1].start()
            continue
        if m["close"]:
            within = skipped
            while opened[tag]:
                name, content, skipped = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
            yield "/" + tag, "", content, within
        else:
            if tag not in VOID:
                if tag == "p" and stack and stack[-1][0] == "p":
                    _, content, skipped = stack.pop()
                    opened["p"] -= 1
                stack.append((tag, content, skipped))
                opened[tag] += 1
                skipped = skipped or named[n] or furniture_share(tag, m["attrs"] or "", content) > 1
                yield tag, "", content, skipped
                content = content or tag in CONTENT
            else:
                yield tag, "", content, skipped
    if at < whole:
        yield "text", page[at:whole], content, skipped


def _named(tag: str) -> str:
    return tag if tag.lstrip("/") in _KNOWN else "other"


def count_tokens(page: str) -> Counter:
    """Words and tags of a labelled page by (name, inside the region); empty if the page is not labelled.

    A page is labelled if its markup has one article or main element with words: that element is the region.
    """
    tokens = list(read(page))
    opened = sum(1 for kind, _, content, skipped in tokens if kind in CONTENT and not content and not skipped)
    if opened != 1:
        return Counter()
    out: Counter = Counter()
    for kind, value, content, skipped in tokens:
        inside = content and not skipped
        if kind == "text":
            out["word", inside] += len(value.split())
        else:
            out[_named(kind), inside] += 1
    return out if out["word", True] else Counter()


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Log-likelihood ratio of each token within and outside the labelled regions, over all labelled pages.

    Words score at least a little above zero and tags from LEAST to zero. A rare tag keeps most of the weight it has without
    labelled pages: its ratio counts as its occurrences do against SUPPORT. Names are of the
    standard's elements, so the counts that reach the driver are bounded. Without labelled pages there are no weights.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column("html").to_pylist():
                if page:
                    total += count_tokens(page)
        rows = [(name, inside, n) for (name, inside), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.bool_(), pa.int64()))], names=["name", "inside", "n"])

    counts = in_small_batches(pages).select(F.col(html_col).alias("html")).mapInArrow(count, "name string, inside boolean, n long")
    got = {(r["name"], r["inside"]): r["n"] for r in counts.groupBy("name", "inside").agg(F.sum("n").alias("n")).collect()}
    all_in, all_out = (sum(n for (_, i), n in got.items() if i == inside) for inside in (True, False))
    if not all_in or not all_out:
        return {}
    out = {}
    for name in {n for n, _ in got}:
        inside, outside = got.get((name, True), 0), got.get((name, False), 0)
        ratio = log((inside + 0.5) / all_in) - log((outside + 0.5) / all_out)
        if name == "word":
            out[name] = max(ratio, 0.1)
            continue
        bare = name.lstrip("/")
        known = (inside + outside) / (inside + outside + SUPPORT)
        usual = TEXT_TAG if bare in TEXT_TAGS else TAG
        out[name] = min(0.0, max(LEAST, usual + known * (ratio - usual)))
    return out


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best-scoring contiguous region, joined by a line feed each."""
    if not page:
        return ""
    word = weights.get("word", WORD)
    blocks: list[tuple[float, str]] = []  # (score of the tags before it and of its words, text)
    text: list[str] = []
    before = 0.0

    def close() -> None:
        nonlocal before
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            blocks.append((before, joined))
            before = 0.0
        text.clear()

    for kind, value, content, skipped in read(page):
        if kind == "text":
            if not skipped:
                text.append(value)
            continue
        name = kind.lstrip("/")
        if name in _BLOCKS:
            close()
        elif name == "br":
            text.append(" ")
        # the tags of furniture, which is left out, and those within an article or main element don't part a region
        if not skipped and not content:
            before += weights.get(_named(kind), TEXT_TAG if name in TEXT_TAGS else TAG)
    close()
    # linear scan: the running sum starts anew where it has fallen below zero
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, (tags, content) in enumerate(blocks):
        if total + tags <= 0:
            total, start = 0.0, i
        else:
            total += tags
        total += word * len(content.split())
        if total > best:
            best, region = total, (start, i + 1)
    return "\n".join(content for _, content in blocks[slice(*region)])


def extract_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add ``text_col``, the main text of the whole page, and n_chars, its code points; columns of these names are replaced.

    Script, style, form controls and furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) are left
    out, character references are decoded, white space within a block is one space. Null and empty pages give an empty text.
    """

    @F.pandas_udf("string")
    def extracted(pages):
        import pandas as pd

        return pd.Series([main_text(p, weights) for p in pages], dtype=object)

    extract = extracted.asNondeterministic()  # else the count of characters runs it again
    names = [c for c in pages.columns if c not in (text_col, "n_chars")]
    out = in_small_batches(pages).select(*names, extract(F.col(html_col)).alias(text_col))
    return out.withColumn("n_chars", F.length(text_col).cast("long"))
