r"""Main text of HTML pages by a maximum-scoring subsequence (op5).

A page is read as a sequence of tokens: words, tags. Words score positive and tags negative; the contiguous run with the highest total is
the content region, found in one linear scan. The weights are log-odds learned from labelled pages: on pages that mark their content
(an `article` or `main` element that holds most of the page's words), each kind of token - a word by the block it stands in, a tag by its
name - is counted inside and outside. Words are clipped to WORD_RANGE, tags to TAG_RANGE, and kinds not seen get the defaults; no tag weighs
less than tag_floor says, so that a kind the labelled articles happen to lack outweighs no paragraph. Left-out elements are neither
counted nor scored, words and tags alike. At most
SAMPLE labelled pages (those with the least hashes of page_id) are counted; where none is labelled, the defaults stand.

Inside the region, elements that are no content are left out: scripts, styles, menus, headers and footers, asides, controls; and, unless
they hold over half of the other words and no article stands apart from them (a form or a layout around the whole page), forms and elements whose class, id or role is the name
of an advert, notice, sidebar, menu, share box or comment list. A name counts as a whole: `sidebar` does, `with-sidebar` does not.

Text: character references decoded, white space inside a block made one space, trimmed, blocks joined in page order by two newlines. `br`
and inline tags don't end a block.

Edge cases: null or empty html, or html without words: empty text; text outside of any tag is a block of its own; of equal runs
the first counts; unclosed elements end with the element around them, a left-out one where an article begins, a script where a block
begins, and they are kept if they hold over half of the words; repeated rows and null ids give a row each; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

SAMPLE = 1000
WORD_RANGE, TAG_RANGE = (0.25, 2.0), (-2.0, -0.05)
DEFAULT_WORD, DEFAULT_TAG, TEXT_TAG = 1.0, -2.0, -0.5
#: Element names of HTML.
RAW = {"script", "style", "textarea", "title"}
LEFT_OUT = set("nav header footer aside form button menu dialog fieldset label noscript template iframe svg select object datalist noframes".split())
CONTENT = {"article", "main"}
#: Inline elements, those of formulas among them.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math q s samp small span strike strong sub sup time tt u var wbr input mi mn mo ms mrow mfrac msqrt mroot msup msub msubsup mover munder mtext mspace mstyle semantics annotation".split())
#: Blocks that hold running text.
TEXT = set("p li ul ol dl dt dd blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption table caption tbody thead tfoot tr td th".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be missing -> the tags that end them when they open.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ENDS_P = TEXT | CONTENT | LEFT_OUT - {"button", "label", "svg", "select", "object", "iframe"} | {"div", "section", "hr", "address", "details"}
#: A whole class or id that names what is no content, on its own, before a further part, or after the part of a page it stands for.
NOT_CONTENT = regex.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|post|global|primary|secondary|user|reader|article|entry|sticky|mobile)[_-])?"
    r"(?:(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice\w*|notification\w*|alert|popup|modal|newsletter|subscribe|subscription|paywall|sidebar|menu|nav\w*|breadcrumbs?|footer|header|masthead|sharing|share|comments?|replies|disqus|widget|toolbar|pagination|pager|login|signup)(?:[_-].*)?"
    r"|side|social(?:[_-](?:share|links|media|icons|buttons|bar))?|related(?:[_-](?:posts|articles|links|stories|content|items))?|recommend(?:ed|ations?)(?:[_-].*)?|search(?:[_-]?(?:form|box|bar|field|input))?)",
    regex.I,
)
TOKEN = regex.compile(r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""", regex.S)
BLOCK_START = regex.compile(r"<(?:p|div|section|article|main|h[1-6]|ul|ol|table|blockquote)(?=[\s>])", regex.I)
MARKS = regex.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
HIDDEN = regex.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", regex.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog"}


def hinted(name: str, attrs: str) -> bool:
    """Whether an element's class, id or role says that it is no content."""
    if not attrs or name in CONTENT or name in ("body", "html"):
        return False
    if HIDDEN.search(attrs):
        return True
    for m in MARKS.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.lower() in ROLES:
                return True
        elif name not in HEADINGS and any(map(NOT_CONTENT.fullmatch, value.split())):
            return True
    return False


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, text, breaks, out): kind "w:<block>" for a run of text in a block, "t:<name>" for a tag.

    breaks: a block border; out: in a left-out element. Those are told by their names; or by a class, id or role, or by being a form or an
    element without an end tag, unless they hold over half of the words that those of the first kind leave and no article stands apart
    from them."""
    seq: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, int, int]] = []  # open elements: name, place, 2: left out by name, 1: hinted
    spans: list[tuple[int, int, bool]] = []  # of left-out candidates; whether that is certain
    articles: list[tuple[int, int]] = []
    pos, block, end = 0, "", len(page)

    def close(depth: int, tagged: bool) -> None:
        """The elements of the stack from `depth` on end here; only the first of them by its own tag."""
        for k, (name, at, mark) in enumerate(stack[depth:]):
            if mark:
                spans.append((at, len(seq), mark == 2 and tagged and not k and name != "form"))
            elif name in CONTENT:
                articles.append((at, len(seq)))
        del stack[depth:]

    while pos < end:
        m = TOKEN.match(page, pos)
        pos = m.end()
        if m["text"] is not None:
            seq.append(("w:" + block, m["text"], False))
            continue
        if m["name"] is None:
            continue
        name, attrs, closing = m["name"].lower(), m["attrs"] or "", bool(m["close"])
        inline = name in INLINE
        if closing:
            seq.append(("t:" + name, "", not inline))
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                close(depth, True)
            if not inline:
                block = ""
            continue
        if name in RAW:
            stop = regex.compile(rf"</{name}(?![\w-])[^>]*>", regex.I).search(page, pos) or BLOCK_START.search(page, pos)
            pos = (stop.end() if page[stop.start() + 1] == "/" else stop.start()) if stop else end
            spans.append((len(seq), len(seq) + 1, True))
            seq.append(("t:" + name, "", True))
            continue
        if stack and (name in ENDED_BY.get(stack[-1][0], ()) or stack[-1][0] == "p" and name in ENDS_P):
            close(len(stack) - 1, False)
        mark = 0
        if name not in VOID and not (name in ("svg", "math") and attrs.endswith("/")):
            mark = 2 if name in LEFT_OUT else int(hinted(name, attrs))
            stack.append((name, len(seq), mark))
        if not inline:
            block = name
        seq.append(("t:" + name, "", not inline or mark > 0))
    starts = [i for i, x in enumerate(seq) if x[0][2:] in CONTENT]
    for k, (name, at, mark) in enumerate(stack):
        if mark:  # never closed: it ends where an article begins
            spans.append((at, next((i for i in starts if i > at), len(seq)), False))
        elif name in CONTENT:
            articles.append((at, len(seq)))
    if not spans:
        return [(*x, False) for x in seq]
    gone = np.zeros(len(seq) + 1, np.int64)
    words = np.array([len(x[1].split()) for x in seq], np.int64)
    for a, b, certain in spans:
        if certain:
            gone[a] += 1
            gone[b] -= 1
    held = np.concatenate(([0], np.cumsum(np.where(np.cumsum(gone[:-1]) > 0, 0, words))))
    for a, b, certain in spans:
        if not certain and (2 * (held[b] - held[a]) <= held[-1] or any(y <= a or x >= b for x, y in articles)):
            gone[a] += 1
            gone[b] -= 1
    return [(*x, out) for x, out in zip(seq, (np.cumsum(gone[:-1]) > 0).tolist())]


def tag_floor(name: str) -> float:
    """The least weight of a tag, which it has where no labelled page shows it."""
    return TAG_RANGE[1] if name in INLINE else TEXT_TAG if name in TEXT else DEFAULT_TAG


def count_kinds(page: str) -> tuple[Counter, Counter] | None:
    """Token kinds inside and outside the marked content of a labelled page; None if it marks none that holds most words."""
    counts, words, depth, name = (Counter(), Counter()), [0, 0], 0, None
    for kind, text, _, out in tokens(page):
        tag = kind[2:]
        if kind[0] == "t" and tag in CONTENT and (name is None or name == tag):
            depth, name = (depth + 1, tag) if depth == 0 else (0, None)
            continue
        side, n = 0 if depth else 1, len(text.split()) if kind[0] == "w" else 1
        words[side] += n if kind[0] == "w" else 0
        if not out:
            counts[side][kind] += n
    return counts if words[0] > words[1] else None


def learn(inside: Counter, outside: Counter) -> dict[str, float]:
    """Log-odds of each kind, words and tags apart, clipped to be positive and negative."""
    weights = {}
    a, b = sum(inside.values()) + 1, sum(outside.values()) + 1
    for kind in inside.keys() | outside.keys():
        lo, hi = WORD_RANGE if kind[0] == "w" else (tag_floor(kind[2:]), TAG_RANGE[1])
        odds = math.log((inside[kind] + 0.5) / a) - math.log((outside[kind] + 0.5) / b)
        weights[kind] = min(hi, max(lo, odds if kind[0] == "w" else 4 * (odds - 1)))
    return weights


def learned_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most `sample` labelled pages; what comes to the driver is the kinds of tokens that those have."""
    marked = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].cast("string").alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    # ids first: what one task merges is a few bytes a page, and the pages are fetched where they are
    ids = marked.select("page_id").filter("page_id IS NOT NULL").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()
    some = marked.join(F.broadcast(ids), "page_id", "left_semi").select("page_id", "html")  # `sample` longs at most
    schema = pa.schema([("kind", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])

    def run(batches):
        a, b = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                if c := count_kinds(page):
                    a.update(c[0])
                    b.update(c[1])
        kinds = sorted(a.keys() | b.keys())
        yield pa.RecordBatch.from_pydict({"kind": kinds, "inside": [a[k] for k in kinds], "outside": [b[k] for k in kinds]}, schema=schema)

    rows = some.mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    return learn(Counter({r.kind: r.i for r in rows}), Counter({r.kind: r.o for r in rows})) if rows else {}


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the content region of a page."""
    seq = tokens(page or "")
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, text, _, out) in enumerate(seq):
        if kind[0] == "w":
            n = len(text.split())
            score = n * weights.get(kind, DEFAULT_WORD)
        else:
            score = weights.get(kind, tag_floor(kind[2:]))
        # what is left out can't be content: it neither pulls the region over it nor parts what lies around it
        total += 0.0 if out else score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_range = total, (start, i + 1)
    blocks, parts = [], []
    for kind, text, breaks, out in seq[best_range[0] : best_range[1]]:
        if breaks:
            blocks.append("".join(parts))
            parts = []
        elif kind == "t:br":
            parts.append(" ")
        elif text and not out:
            parts.append(text)
    blocks.append("".join(parts))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = learned_weights(pages, sample)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))

    def make():
        def f(x):
            out = [main_text(h, weights) for h in x["html"]]
            return {"page_id": x["page_id"], "url": x["url"], "text": out, "n_chars": [len(t) for t in out]}

        return f

    return map_rows(rows, make, "page_id long, url string, text string, n_chars long")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_extract": op5_extract}
ORACLE: dict[str, str] = {}
