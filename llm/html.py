"""Main text of web pages by the maximum-scoring subsequence of their words and tags (operator 1).

A page becomes a sequence of tokens. A word scores the probability that it belongs to the article (positive), a tag
scores minus the probability that it stands outside (negative); one linear scan finds the contiguous run with the
largest sum. The blocks in that run are the text, without those whose features speak strongly against them.

The probabilities are learnt by logistic regression from labelled pages: pages whose author marked the article. The mark
itself is no feature. The features of a word are the elements it stands in, the words in their class, id and
role names, whether they are hidden, and whether its block is mostly links. PRIOR holds what is assumed of features before any
page is seen; labelled pages pull it either way. Only markup that is never text (scripts, styles and the like, comments) is
left out by rule.

Cases: a null or empty page, and one without words, has an empty text; markup that is never closed ends
with the page; equal runs: the first one; repeated rows give repeated results; a table without labelled
pages uses PRIOR alone; an empty table gives an empty result. Pages are read in linear time.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded_sample, map_arrow

NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile("[>\"']")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.IGNORECASE)
#: Elements that hold no text of a page.
RAW = frozenset("script style textarea noscript template iframe xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: The author's mark, which is the label and therefore no feature.
MARK = ("article", "main")
#: Elements that say nothing of their own: the mark, the page, and containers.
SILENT = INLINE | {"article", "main", "html", "body", "div", "section", "center", "table", "tbody", "tr", "td"}
#: Words that make a name tell the state of a page or a layout and not what an element is.
STATES = frozenset("has no with without is not fixed sticky open closed enabled disabled active".split())
#: What is assumed of elements (t) and of words in names (n) before any labelled page is seen.
PRIOR = {("t", x): -3.0 for x in "head title nav header footer aside form button select menu dialog svg canvas audio video object".split()}
PRIOR |= {("n", x): -3.0 for x in "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead".split()}
PRIOR |= {("n", x): -3.0 for x in "comment comments cookie cookies consent gdpr notice notices alert newsletter subscribe subscription share sharing social related recommended popup modal dialog login search".split()}
PRIOR |= {("n", x): -3.0 for x in "contentinfo complementary disqus discussion replies widget toolbar pagination pager".split()}
PRIOR |= {("hidden", ""): -3.0, ("bias", ""): 1.0, ("links", ""): -0.5}
#: A block in the run is left out where the odds that it belongs there are less than this.
DROP = math.log(0.15 / 0.85)
Feature = tuple[str, str]


@dataclass
class Token:
    words: list[str] = field(default_factory=list)  # of a text, else empty
    raw: str = ""  # that text, its character references decoded
    tag: str = ""
    block: int = 0
    marked: bool = False  # within the author's mark
    linked: bool = False  # within a link
    features: frozenset[Feature] = frozenset()  # of the elements that are open


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag; one in quotes does not, unless the quote is never closed."""
    i = at
    while m := STOP.search(page, i):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        if close < 0:
            return page.find(">", m.end())
        i = close + 1
    return page.find(">", at)


def _features(tag: str, attributes: str) -> list[Feature]:
    """What an element says of the text in it."""
    out = [] if tag in SILENT else [("t", tag)]
    if tag in ("html", "body") or not attributes:
        return out
    for m in NAMES.findall(attributes):
        for name in m.strip("\"'").lower().split():
            words = [x for x in re.split(r"[^a-z0-9]+", name) if x]
            if not STATES.intersection(words):
                out += [("n", x) for x in words]
    if HIDDEN.search(attributes):
        out.append(("hidden", ""))
    return out


def tokens(page: str, known: dict[Feature, float] | None = None) -> Iterator[Token]:
    """The words and tags of a page; with known, only the features in it."""
    at, block, size = 0, 0, len(page)
    stack: list[tuple[str, frozenset[Feature]]] = []
    opened: Counter[str] = Counter()
    now: frozenset[Feature] = frozenset()

    def token(tag: str = "", raw: str = "") -> Token:
        return Token(raw.split(), raw, tag, block, opened["article"] + opened["main"] > 0, opened["a"] > 0, now)

    text = ""
    while at < size:
        m = page.find("<", at)
        text += page[at : m if m >= 0 else size]
        if m < 0:
            break
        at = m
        name = NAME.match(page, at + 1)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            end = size if end < 0 else end + 3
        elif name or page.startswith(("<!", "<?"), at):
            end = _tag_end(page, name.end()) if name else page.find(">", at)
            if end < 0:  # no tag ends any more: the rest is text
                text += page[at:]
                break
            end += 1
        else:
            text += "<"
            at += 1
            continue
        if text:
            yield token(raw=entities.unescape(text))
            text = ""
        at = end
        if not name:
            continue
        tag, closing, attributes = name[1].lower(), page[m + 1] == "/", page[name.end() : end - 1]
        if tag in RAW and not closing:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else size
            yield token(tag)
            continue
        if tag not in INLINE:
            block += 1
        if closing:
            if opened[tag]:
                yield token(tag)
                while True:
                    last, before = stack.pop()
                    opened[last] -= 1
                    now = before
                    if last == tag:
                        break
            else:
                yield token(tag)
            continue
        if tag not in VOID and not attributes.endswith("/"):
            if tag in ("body", "main") or tag in MARK and not opened["article"]:
                # the page or its article begins: parts before it that were never closed end, but for containers
                while stack and stack[-1][0] in ("head", "nav", "header", "footer", "ul", "ol", "li", "p") and (tag != "article" or not any(t in SILENT - INLINE for t, _ in stack)):
                    last, now = stack.pop()
                    opened[last] -= 1
            stack.append((tag, now))
            opened[tag] += 1
            new = frozenset(f for f in _features(tag, attributes) if known is None or f in known)
            if not new <= now:
                now = now | new
        yield token(tag)
    if text:
        yield token(raw=entities.unescape(text))


@dataclass
class Weights:
    """Log odds of features, and the probability of a tag to stand outside."""

    odds: dict[Feature, float]
    outside: dict[str, float]
    other: float

    def value(self, features: frozenset[Feature], links: bool = False) -> float:
        """Log odds of a word with these features to be in the article."""
        return self.odds.get(("bias", ""), 0.0) + sum(self.odds.get(f, 0.0) for f in features) + (self.odds.get(("links", ""), 0.0) if links else 0.0)


def _chance(odds: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, odds))))


def link_blocks(seq: list[Token]) -> set[int]:
    """Blocks of which more than half of the words are links."""
    words, linked = Counter(), Counter()
    for t in seq:
        words[t.block] += len(t.words)
        linked[t.block] += len(t.words) * t.linked
    return {b for b, n in linked.items() if 2 * n > words[b]}


def fit(pages: list[str], rounds: int = 30, rate: float = 0.5, pull: float = 0.002, prior: dict[Feature, float] | None = None) -> Weights:
    """Logistic regression over the blocks of the pages whose author marked the article, pulled towards the prior.

    Text outside the mark is outside the article; text in it is in the article, unless the prior alone speaks against it: such
    text (an aside in an article) is not labelled.
    """
    prior = PRIOR if prior is None else prior
    start = Weights(prior, {}, 0.5)
    cases: Counter[tuple[frozenset[Feature], bool, bool]] = Counter()
    tags: dict[str, list[int]] = defaultdict(lambda: [1, 1])  # inside, outside
    for page in pages:
        seq = list(tokens(page))
        if not any(t.marked and t.words for t in seq):
            continue
        links = link_blocks(seq)
        for t in seq:
            against = t.marked and start.value(t.features) < 0
            if t.words and not against:
                cases[t.features, t.block in links, t.marked] += 1
            elif t.tag and t.tag not in MARK:
                tags[t.tag][not t.marked or against] += 1
    odds = dict(prior)
    total = sum(cases.values())
    squares: dict[Feature, float] = defaultdict(lambda: 1e-8)
    for _ in range(rounds if total else 0):
        steps: dict[Feature, float] = defaultdict(float)
        for (features, links, inside), n in cases.items():
            own = [("bias", ""), *features, *([("links", "")] if links else [])]
            error = n * (inside - _chance(sum(odds.get(f, 0.0) for f in own))) / total
            for f in own:
                steps[f] += error
        for f, g in sorted(steps.items()):
            g -= pull * (odds.get(f, 0.0) - prior.get(f, 0.0))
            squares[f] += g * g
            odds[f] = odds.get(f, 0.0) + rate * g / math.sqrt(squares[f])
    outside = {t: b / (a + b) for t, (a, b) in tags.items()}
    return Weights({f: x for f, x in odds.items() if abs(x) > 0.01}, outside, 0.5)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the first contiguous run with the largest positive sum; (0, 0) if there is none."""
    best = total = 0.0
    found, start = (0, 0), 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def scored(page: str, weights: Weights) -> tuple[list[Token], list[float], list[bool]]:
    """The tokens of a page, their scores, and which of them a run leaves out."""
    seq = list(tokens(page, weights.odds))
    links = link_blocks(seq)
    odds: dict[tuple[frozenset[Feature], bool], float] = {}
    scores, out = [], []
    shut = False  # within a part that is left out
    for t in seq:
        key = t.features, t.block in links
        if key not in odds:
            odds[key] = weights.value(*key)
        value = odds[key]
        if t.tag:
            away = weights.value(t.features) < DROP if t.features else False
            # the tags within such a part count little, as its first one has been counted
            scores.append(-0.05 if shut and away else -weights.outside.get(t.tag, weights.other) if away or value < 2 else -weights.outside.get(t.tag, weights.other) * (1 - _chance(value)))
            shut = away
            out.append(False)
        else:
            scores.append(len(t.words) * _chance(value))
            out.append(value < DROP)
    return seq, scores, out


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    seq, scores, left_out = scored(page, weights)
    start, end = best_run(scores)
    out: list[str] = []
    block, line = -1, ""
    gap = False
    for t, drop in zip(seq[start:end], left_out[start:end], strict=True):
        if drop:
            continue
        if t.block != block:
            if line:
                out.append(line)
            block, line, gap = t.block, "", False
        if t.tag == "br":
            gap = True
        if t.tag:
            continue
        own = " ".join(t.words)
        if line and own and (gap or t.raw[0].isspace()):
            line += " "
        line += own
        gap = t.raw[-1].isspace() if own else True
    if line:
        out.append(line)
    return "\n".join(out)


def labelled(pages: DataFrame, most: int, longest: int) -> list[str]:
    """At most `most` pages of at most `longest` characters whose author marked the article: a bounded sample by a hash of the page."""
    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    marked = F.lower("html").rlike("<(article|main)[ >]") & (F.length("html") <= longest)
    return [r["html"] for r in bounded_sample(some, most, marked, "page_id", "html").collect()]


def extract(pages: DataFrame, weights: Weights | None = None, labelled_pages: int = 300, longest: int = 50_000) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    w = weights or fit(labelled(pages, labelled_pages, longest))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, w) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), each, "page_id long, url string, text string, n_chars long")
