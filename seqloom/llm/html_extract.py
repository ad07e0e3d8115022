"""Main text of web pages as the maximum-scoring run of tokens.

A page becomes a sequence of tokens: words and tags.  Words score positive and tags negative;
how much is learned from labelled pages, those that mark their article themselves: the weight of
a kind of token is the log-odds of meeting it inside rather than outside the article.
Words in links are a kind of their own, and words in side content (elements, or whole class, id and role marks, of menus, adverts, comments, ...)
count nothing: they are left out in any case, so only the tags around them matter.  A linear scan (Kadane's) finds the contiguous region of the highest total. Where it starts or ends inside an article
element it is widened to what that article still has there (``widened``), whatever that scores. Its
words, without those of marked side content, are the text.

Training reads ``TRAIN_PAGES`` labelled pages, or all if there are fewer, drawn by a hash of their rows
over the whole table (equal rows are drawn together); their counts are added up in Spark and only the counts of
distinct tag kinds reach the driver.  Without labelled pages the default weights hold.
Extraction is one pass without a shuffle; a page is handled alone, whatever its length.

Defined cases: a null html is empty and gives an empty text; null ids and urls stay; repeated rows
give equal rows; text outside any block still counts; broken or missing end tags
never hide an article that starts later; scripts, styles, form values and page titles are no text, nor
is what buttons, drawings, frames and the like hold, up to their end tag; formulas and the
content of media elements are text; of several articles on a page the region takes those that score best
together, which may be one; a ``<`` that no ``>`` follows is text; other columns are ignored.  All scans are linear in the page.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import ship

TRAIN_PAGES = 2_000
ARTICLE = ("article", "main")
#: Elements whose content is no markup, elements whose content is no text, and tags around text that weigh nothing.
RAW = ("script", "style", "title", "textarea")
HIDDEN = {"noscript", "template", "svg", "select", "button", "iframe"}
WEIGHTLESS = {
    *"object param audio video source track canvas math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot".split(),
    *"mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose mmultiscripts mprescripts merror".split(),
    *"semantics annotation annotation-xml".split(),
}
#: Elements of side content, and words in class, id or role that mark it.
SIDE = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
SIDE_WORDS = {
    *"ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion".split(),
    *"sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead banner header footer".split(),
    *"cookie cookies consent notice notices gdpr popup modal alert newsletter subscribe signup login".split(),
    *"comment comments disqus replies respond related recommended share sharing social widget widgets pagination".split(),
}
BLOCKS = {
    *"p div section article main aside header footer nav form ul ol li dl dt dd table thead tbody tfoot tr td th".split(),
    *"h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption hr address fieldset details summary body html head".split(),
}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "col", "area", "base", "embed", "track", "param"}
#: Elements that are followed on a stack; others never open side content.
NESTED = BLOCKS - {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "hr", "html", "head", "body"}
NESTED |= {"span", "dialog", "menu"} | HIDDEN
HIDDEN_END = re.compile(rf"</({'|'.join(sorted(HIDDEN))})(?=[\s/>])", re.I)


@functools.cache
def token_pattern(unclosed: frozenset[str] = frozenset()) -> re.Pattern:
    """Tokens of a page in which the raw elements ``unclosed`` have no end tag; these reach to the next article."""
    closed = "|".join(x for x in RAW if x not in unclosed) or "(?!)"
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<(?P<raw>{closed})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|(?P<open>\Z))"
        + rf"|<(?:{'|'.join(sorted(unclosed)) or '(?!)'})(?=[\s/>])[^>]*>.*?(?:\Z|(?=<(?:{'|'.join(ARTICLE)})[\s/>]))"
        + r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\s(?:\"[^\"<]*\"|'[^'<]*'|[^'\">])*|[^>]*))>"
        + r"|<[!?][^>]*>|(?P<text>[^<]+|<)",
        re.S | re.I,
    )


MARKS = re.compile(r"""(?<![\w:-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[a-z]{2,}")
#: Parts that a side mark may have besides its side word, as in ``site-footer`` or ``ad-slot``.
PLACES = set("site global top bottom left right primary secondary list area container wrapper box block bar unit slot".split())
#: The reading without class marks is taken if its region scores so many times higher.
FAR = 10

WORD, LINK_WORD, SIDE_WORD = "word", "link word", "side word"
#: Weights of kinds that no labelled page has; tags that occur in running text hardly count.
DEFAULT = {WORD: 1.0, LINK_WORD: -0.5, SIDE_WORD: 0.0}
TEXT_TAGS = {
    *"p br b i u em strong span h1 h2 h3 h4 h5 h6 blockquote pre code ul ol li dl dt dd q cite small sub sup mark s del ins".split(),
    *"abbr time kbd samp var figure figcaption img picture table thead tbody tfoot tr td th caption hr wbr font center".split(),
}
DEFAULT_TEXT_TAG, DEFAULT_TAG, LEAST = -0.2, -6.0, 0.05
#: No word weighs more, so that words outside the article don't outweigh the tags between, nor side words an article.
MOST = 1.0


def _marks_side(name: str, rest: str) -> bool:
    if name in SIDE:
        return True
    if "=" not in rest:
        return False
    for m in MARKS.finditer(rest):
        for mark in (m[1] or m[2] or m[3] or "").lower().split():
            parts = PART.findall(mark)
            if not SIDE_WORDS.isdisjoint(parts) and all(x in SIDE_WORDS or x in PLACES for x in parts):
                return True
    return False


#: A start of a tag or declaration, though not of a comment.
OPENING = re.compile(r"<(?!!--)")


def _matches(page: str) -> Iterator[re.Match]:
    """The tokens of a page; a raw element without an end tag ends where an article starts."""
    # Nothing that starts after the last ``>`` is a tag, and looking for its end would read the rest each time.
    end = page.rfind(">") + 1
    page = page[:end] + OPENING.sub("&lt;", page[end:])
    at, unclosed = 0, frozenset()
    while at is not None:
        start, at = at, None
        for m in token_pattern(unclosed).finditer(page, start):
            if m["open"] is not None:
                at, unclosed = m.start(), unclosed | {m["raw"].lower()}
                break
            yield m


def tokens(page: str, marks: bool = True) -> Iterator[tuple[str, str, bool]]:
    """``(kind, text, inside)``: a kind of token, its text if it is words, whether it is in an article.

    White space is text of no words. Side content inside an article is part of its run of tokens, though not of its text.  Without
    ``marks`` only elements mark side content, not classes, ids and roles.
    """
    # (name, opens side content, number of articles before).  What an article finds open counts no more for side content
    # and for what is hidden, but still ends with its end tag.
    stack: list[tuple[str, bool, int]] = []
    is_open: Counter = Counter()
    side = link = articles = hidden = since = 0
    last_end: dict[str, int] | None = None  # of hidden elements
    for m in _matches(page):
        text = m["text"]
        if text is not None:
            if not hidden:
                yield (SIDE_WORD if side else LINK_WORD if link else WORD), text, articles > 0
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            closes = False
            if name == "a":
                link = 0
            if is_open[name]:
                while stack:
                    n, s, before = stack.pop()
                    if n in HIDDEN:
                        if before < since:
                            continue
                        hidden -= 1
                    is_open[n] -= 1
                    side -= s and before == since
                    articles -= n in ARTICLE
                    if n == name:
                        closes = s and before == since
                        break
            if not (hidden or name in HIDDEN or name in WEIGHTLESS):
                yield ("side /" if closes else "/") + name, "", articles > 0 and name not in ARTICLE
            continue
        if name == "a":
            link = 1
        opens = False
        if name in ARTICLE:
            side = hidden = 0
            since += 1
            for n in HIDDEN:
                is_open[n] = 0
            articles += 1
            stack.append((name, False, since))
            is_open[name] += 1
        elif name in HIDDEN:
            if last_end is None:
                last_end = {e[1].lower(): e.start() for e in HIDDEN_END.finditer(page)}
            # Without an end tag it holds nothing; those that can't nest end at the next one.
            if not m["rest"].endswith("/") and last_end.get(name, -1) >= m.end():
                if name in ("svg", "template") or not is_open[name]:
                    stack.append((name, False, since))
                    is_open[name] += 1
                    hidden += 1
            continue
        elif name in NESTED and name not in VOID and not m["rest"].endswith("/"):
            opens = (_marks_side(name, m["rest"]) if marks else name in SIDE) and not (name == "header" and articles)
            stack.append((name, opens, since))
            is_open[name] += 1
            side += opens
        if not (hidden or name in WEIGHTLESS):
            yield ("side " + name if opens else name), "", articles > 0 and name not in ARTICLE


def count_kinds(page: str) -> Counter:
    """How often each kind occurs inside and outside the marked article; words by number."""
    seen: Counter = Counter()
    for kind, text, inside in tokens(page):
        seen[kind, inside] += len(text.split()) if text else 1
    return seen


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds weights; words at least a little positive, tags at least a little negative."""
    inside = sum(n for (_, i), n in counts.items() if i) or 1
    outside = sum(n for (_, i), n in counts.items() if not i) or 1
    weights = {}
    for kind in {k for k, _ in counts}:
        odds = math.log((counts.get((kind, True), 0) + 0.5) / inside) - math.log((counts.get((kind, False), 0) + 0.5) / outside)
        if kind == WORD:
            weights[kind] = min(max(odds, LEAST), MOST)
        elif kind == LINK_WORD:
            weights[kind] = max(min(odds, -LEAST), -MOST)
        else:
            weights[kind] = 0.0 if kind == SIDE_WORD else min(odds, -LEAST)
    return weights


def weight_of(kind: str, weights: dict[str, float]) -> float:
    if kind in weights:
        return weights[kind]
    if kind in DEFAULT:
        return DEFAULT[kind]
    return DEFAULT_TEXT_TAG if kind.lstrip("/") in TEXT_TAGS else DEFAULT_TAG


def train(pages: DataFrame, bound: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from ``bound`` pages that have an article element, all if there are fewer; {} if there are none."""
    ship(pages.sparkSession)
    labelled = pages.select("page_id", "html").where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    # The ``bound`` smallest hashes of the labelled pages; equal rows share a hash and are drawn together.
    drawn = F.xxhash64("page_id", "html")
    last = labelled.select(drawn.alias("h")).orderBy("h").limit(bound).agg(F.count("*").alias("n"), F.max("h").alias("h")).first()
    if last["n"] == bound:
        labelled = labelled.where(drawn <= last["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                seen.update(count_kinds(page.as_py()))
        if seen:
            kinds, sides = zip(*seen, strict=True)
            yield pa.record_batch([pa.array(kinds), pa.array(sides), pa.array(seen.values(), pa.int64())], names=["kind", "inside", "n"])

    counted = labelled.select("html").mapInArrow(run, "kind string, inside boolean, n long")
    totals = counted.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_from({(r["kind"], r["inside"]): r["n"] for r in totals}) if totals else {}


def best_region(page: str, weights: dict[str, float], marks: bool) -> tuple[float, tuple[int, int], list[tuple[str, str, bool]]]:
    """The highest total of a run of tokens, its first token and the one after it, and all tokens."""
    total = best = 0.0
    start = 0
    region = (0, 0)
    found = []
    for i, (kind, text, inside) in enumerate(tokens(page, marks)):
        found.append((kind, text, inside))
        if text:
            total += weight_of(kind, weights) * len(text.split())
        else:
            total += weight_of(kind, weights)
        if total > best:
            best, region = total, (start, i + 1)
        elif total <= 0:
            total, start = 0.0, i + 1
    return best, region, found


def widened(found: list[tuple[str, str, bool]], start: int, end: int) -> list[tuple[str, str, bool]]:
    """``found[start:end]`` and what the article it starts or ends in still has on either side.

    So a list, a link or an advert does not cut off the few words behind it. Each side ends with the block of its
    outermost word that is no link: a list of links at the edge of an article is no part of it.
    """

    def edge(at: int, step: int) -> int:
        """The last token to take, going from ``at``, which is taken."""
        last, open_block = at, False
        while 0 <= at < len(found) and found[at][2]:
            kind, text, _ = found[at]
            if kind == WORD and text.strip():
                open_block = True
            elif not text and kind.rpartition(" ")[2].lstrip("/") in BLOCKS:
                open_block = False
            if open_block:
                last = at
            at += step
        return last

    if start == end:
        return []
    return found[edge(start, -1) : edge(end - 1, 1) + 1]


def joined(region: list[tuple[str, str, bool]]) -> str:
    blocks, parts = [], []
    for kind, text, _ in region:
        if text:
            if kind != SIDE_WORD:
                parts.append(entities.unescape(text))
        elif (name := kind.rpartition(" ")[2].lstrip("/")) in BLOCKS:
            blocks.append(parts)
            parts = []
        elif name == "br":
            parts.append(" ")
    blocks.append(parts)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract_text(page: str, weights: dict[str, float]) -> str:
    """The main text: blocks in page order, joined by newlines.

    A wrapper around the page or an article may carry a class of side content.  So classes are not heeded if that
    gives a region that scores ``FAR`` times higher, in an article if the page has one, or if there is no text else.
    """
    best, region, found = best_region(page, weights, True)
    text = joined(widened(found, *region))
    n_side = sum(len(t.split()) for kind, t, _ in found if kind == SIDE_WORD)
    # Without side words the totals differ by tags only; no reading scores more than all its words do.
    if n_side and (not text or max(weight_of(WORD, weights), 0.0) * (n_side + sum(len(t.split()) for k, t, _ in found if k == WORD)) > FAR * best):
        labelled = any(inside for _, _, inside in found)
        other, (start, end), found = best_region(page, weights, False)
        if not text or other > FAR * best and (not labelled or all(inside for _, t, inside in found[start:end] if t)):
            return joined(widened(found, start, end))
    return text


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text`` of each page; ``weights`` are trained on ``pages`` if not given."""
    ship(pages.sparkSession)
    if weights is None:
        weights = train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(p.as_py() or "", weights) for p in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
