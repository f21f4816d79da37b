"""Main-text extraction by a maximum-scoring subsequence.

A page is read as a sequence of words and tags.  A word scores the log-odds that a word of its container's kind stands in an
article (positive in paragraphs and headings, negative in lists of links), plus the weights of the elements around it: what
their class and id names are worth, and a fixed penalty for elements such as nav, aside, footer or form.  Tags score negative.
Weights of kinds, names and tags are fitted on labelled pages, those that mark their article themselves (``<article>``, ``<main>``),
``max_labelled`` of them at most, over prior counts.

Where a page marks its article, words elsewhere pay a penalty.

An element that its names or its tag make negative, and whose words sum to less than zero, is furniture: its words score next to
nothing and are no part of the text, so that furniture inside an article neither tears it apart nor stays in it.  Names are not believed
where they would take the page's own text away: of an element around the marked article or, without a mark, of one beside which
the rest of the page has too few words.  The same holds of a form or fieldset, which may stand around a whole page, and of any element
that is never ended.  Of a compound name its last telling word decides.  One linear scan then finds the contiguous region of the highest sum; its words outside furniture are the text.

Blocks end at block-level tags; ``br`` is white space.  All steps are linear in the page's length.

Edge cases: null and empty pages have an empty text; broken markup is read as far as it goes (unmatched end tags are ignored,
a tag with a broken quote ends at the first ``>``, a tag that never ends at the next ``<``, an unclosed comment, script or style
runs to the end); null ids and urls pass through; repeated rows get equal results; an empty table gives an empty table; without
labelled pages the prior weights hold; other input columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe canvas audio video title textarea".split())
FURNITURE = frozenset("nav aside footer form menu button select dialog fieldset head".split())
KIND_OF = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "blockquote": "paragraph", "pre": "paragraph", "li": "item", "dd": "item", "dt": "item", "td": "cell", "th": "cell"}
CLOSED_BY_ITSELF = frozenset("li tr td th dt dd".split())
#: What class names and ids of furniture hold, as whole words, before any page has been seen.
FURNITURE_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising advertorial banner breadcrumb breadcrumbs cmt cmts comment commentary comments consent cookie cookies copyright discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "overlay pager pagination paywall popup promo promotion recommended related replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Furniture by its tag that a whole page may stand in: believed only beside the page's text, like names.
WRAPPERS = frozenset("form fieldset".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Last words of compound names that say nothing of their own: ``comment-list`` is about comments, ``share-price`` about a price.
STRUCTURAL = frozenset(
    "area article articles bar block body bottom box button buttons col column container content count div entries entry field fields form grid group head heading icon icons inner item items label left link links list module news outer "
    "panel placeholder post posts region right row section slot stories story text title top unit widget wrap wrapper".split()
)
#: After one of these a name says what isn't there, or what something else has.
MODIFIERS = frozenset("has is js no non not with without".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/<>]*+)(?:((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|([^<>]*+)(?:>|(?=<)|\Z))",
    re.S,
)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: What words are worth before any page has been seen; a textlink is a link in a paragraph or heading, other text stands in no block of text.
PRIOR = {"link": -2.0, "textlink": 0.2, "heading": 0.8, "paragraph": 2.0, "item": 0.3, "cell": 0.2, "other": 0.3}
KINDS = tuple(PRIOR)
#: Tags that text is made of; they cost least.
TEXT_TAGS = frozenset("a abbr b blockquote br cite code dd dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img kbd li mark math ol p pre q s samp small span strong sub sup table tbody td th thead time tr u ul var".split())
TEXT_TAG, OTHER_TAG = -0.05, -0.3
#: Words that such a prior counts for.
PRIOR_WORDS = 200
#: Bounds of a kind's weight; weights of a listed name, of a furniture element, of a word outside the marked article; bounds of a learned name's weight; a furniture word's score.
MOST, LISTED, ELEMENT, OUTSIDE, LEARNED, NOTHING = 2.5, -4.0, -6.0, -3.0, (-3.0, 1.0), -0.02
#: Marks and names are believed as long as what they leave is this share of the words.
BESIDE = 0.25


@dataclass(frozen=True)
class Weights:
    words: dict[str, float]
    tags: dict[str, float]
    names: dict[str, float] = field(default_factory=dict)

    def tag(self, name: str) -> float:
        known = self.tags.get(name)
        return known if known is not None else TEXT_TAG if name in TEXT_TAGS else OTHER_TAG

    def name(self, part: str) -> float:
        return LISTED if part in FURNITURE_NAMES else self.names.get(part, 0.0)


def names_of(attrs: str) -> list[str]:
    """The words of an element's class, id and role, without those that a modifier turns around.

    A word of the list that is not what its name is about, as the first of ``share-price``, gets a ``~`` before it: it is a word of its own.
    """
    out: list[str] = []
    if "=" in attrs:
        for m in NAMES.finditer(attrs):
            for name in (m[2] or m[3] or m[4] or "").split():
                parts = [x.lower() for x in PART.findall(name)]
                about = len(parts)
                while about and (parts[about - 1] in STRUCTURAL or parts[about - 1].isdigit()) and parts[about - 1] not in FURNITURE_NAMES:
                    about -= 1
                if not about or parts[about - 1] not in FURNITURE_NAMES:
                    parts = ["~" + x if x in FURNITURE_NAMES else x for x in parts]
                out += [x for x, before in zip(parts, ["", *parts]) if before not in MODIFIERS]
    return out


@dataclass
class Page:
    """Events in page order, (kind, text, element) for text and (None, tag, element) for the tags of an element, and the elements: tag, parent, names, article, first and last event."""

    events: list[tuple]
    tag: list[str]
    up: list[int]
    names: list[list[str]]
    article: list[int]
    first: list[int]
    last: list[int]
    ended: list[bool]


def read(page: str) -> Page:
    events: list[tuple] = []
    tags, up, names, article, first, last, kinds = [""], [-1], [[]], [0], [0], [0], ["other"]
    ended = [True]  # an end tag of its own
    stack, blocks, open_ = [0], [0], {}  # open elements, those of them that are blocks, and how many are open by tag

    def close(upto: int) -> None:
        while True:
            e = stack.pop()
            last[e] = len(events)
            open_[tags[e]] -= 1
            if blocks[-1] == e:
                blocks.pop()
            if e == upto:
                return

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            events.append((kinds[stack[-1]], page[at:], stack[-1]))
            break
        if m.start() > at:
            if tags[stack[-1]] == "head" and not page[at : m.start()].isspace():
                close(stack[-1])
            events.append((kinds[stack[-1]], page[at : m.start()], stack[-1]))
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                events.append((kinds[stack[-1]], m[1], stack[-1]))
            continue
        tag = tag.lower()
        if m[2]:
            if open_.get(tag):
                k = len(stack) - 1
                while tags[stack[k]] != tag:
                    k -= 1
                e = stack[k]
                ended[e] = True
                close(e)
                events.append((None, "/" + tag, e))
            else:
                events.append((None, "/" + tag, stack[-1]))
            continue
        attrs = m[4] if m[4] is not None else m[5] or ""
        alone = attrs[-1:] == "/" and attrs[-2:-1] in ("", " ", "\t", "\n", '"', "'")
        if tags[stack[-1]] == "head" and tag not in IN_HEAD:
            close(stack[-1])
        if tag in RAW:
            events.append((None, tag, stack[-1]))
            end = None if alone else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = at if alone else end.end() if end else n
            continue
        if tag in BLOCKS:  # a block ends an open paragraph, an item an open item
            near = tags[blocks[-1]]
            if near == "p" or (near == tag and tag in CLOSED_BY_ITSELF):
                close(blocks[-1])
        elif tag == "a" and tags[stack[-1]] == "a":
            close(stack[-1])
        if tag in VOID or alone:
            events.append((None, tag, stack[-1]))
            continue
        e, above = len(tags), stack[-1]
        events.append((None, tag, e))
        tags.append(tag)
        up.append(above)
        names.append(names_of(attrs))
        article.append(article[above] + (tag in ("article", "main")))
        first.append(len(events))
        last.append(-1)
        ended.append(False)
        kinds.append("textlink" if tag == "a" and kinds[above] in ("paragraph", "heading", "textlink") else "link" if tag == "a" else KIND_OF.get(tag) or ("other" if tag in BLOCKS else kinds[above]))
        stack.append(e)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in BLOCKS:
            blocks.append(e)
    for e in stack:
        last[e] = len(events)
    return Page(events, tags, up, names, article, first, last, ended)


def listed(p: Page, e: int) -> bool:
    """The element's names say furniture, by the list alone; an article's header belongs to it."""
    return any(x in FURNITURE_NAMES and not (x == "header" and p.article[e]) for x in p.names[e])


def is_element(p: Page, e: int) -> bool:
    """Furniture by its tag; a header outside an article too."""
    return p.tag[e] in FURNITURE or (p.tag[e] == "header" and not p.article[e])


def marked(p: Page, held: list[int]) -> list[bool]:
    """For each element whether the page's own mark is around it: its articles or else its mains, where these have enough of the words outside furniture."""
    k = len(p.tag)
    plain, own = [True] * k, [0] * k
    for e in range(1, k):
        plain[e] = plain[p.up[e]] and not is_element(p, e) and not (p.tag[e] not in ("html", "body") and listed(p, e))
    for kind, t, e in p.events:
        if kind is not None and plain[e]:
            own[e] += len(t.split())
    for mark in ("article", "main"):
        under = [False] * k
        for e in range(1, k):
            under[e] = under[p.up[e]] or (p.tag[e] == mark and plain[e] and held[e] > 0)
        if any(under) and sum(n for n, u in zip(own, under) if u) >= BESIDE * sum(own):
            return under
    return [False] * k


def judged(p: Page, weights: Weights) -> tuple[list[bool], list[float], list[bool]]:
    """For each element whether it is furniture or stands in some, what the elements around a word of it add to its score, and whether it stands in the marked article."""
    k = len(p.tag)
    count, score = [0], [0.0]  # running sums over events: words, and what their kinds are worth
    inside = [0] * k
    for kind, t, e in p.events:
        n = 0 if kind is None else len(t.split())
        inside[e] += n
        count.append(count[-1] + n)
        score.append(score[-1] + (n * weights.words[kind] if n else 0.0))
    held = [count[b] - count[a] for a, b in zip(p.first, p.last)]
    under = marked(p, held)
    mark = any(under)
    by_tag, by_name, around = [False] * k, [0.0] * k, [False] * k
    for e in range(k - 1, 0, -1):
        around[p.up[e]] |= around[e] or (under[e] and not under[p.up[e]])
    for e in range(1, k):
        by_tag[e] = is_element(p, e) and not around[e]
        if p.names[e] and not around[e] and p.tag[e] not in ("html", "body") and (under[p.up[e]] or not under[e]):
            by_name[e] = sum(weights.name(x) for x in set(p.names[e]) if not (x == "header" and p.article[e]))
    # believed from the largest element down; inside: words that stand under no lower element in question
    low = [by_tag[e] or by_name[e] < 0 for e in range(k)]
    for e in range(k - 1, 0, -1):
        if not low[e]:
            inside[p.up[e]] += inside[e]
    rest = sum(inside[e] for e in range(1, k) if under[e] and not under[p.up[e]]) if mark else inside[0]
    wrapper = [by_tag[e] and (p.tag[e] in WRAPPERS or not p.ended[e]) for e in range(k)]
    doubted = [e for e in range(1, k) if (under[e] and wrapper[e] if mark else low[e] and (wrapper[e] or not by_tag[e]))]
    for e in sorted(doubted, key=lambda e: (-held[e], e)):
        if rest < BESIDE * held[e]:
            by_tag[e], by_name[e] = False, max(0.0, by_name[e])
            rest += inside[e]
    out, extra = [False] * k, [0.0] * k
    for e in range(1, k):
        extra[e] = extra[p.up[e]] + (ELEMENT if by_tag[e] else 0.0) + by_name[e]
        worth = score[p.last[e]] - score[p.first[e]] + extra[e] * held[e]
        out[e] = out[p.up[e]] or by_tag[e] or (by_name[e] < 0 and worth < 0)
    return out, [x + (OUTSIDE if mark and not u else 0.0) for x, u in zip(extra, under)], under


def scored(p: Page, weights: Weights, out: list[bool], extra: list[float], under: list[bool]) -> list[float]:
    """The score of each event; in the marked article a link is one in its text, wherever it stands there, and all tags cost least."""
    w = weights.words

    def word(kind: str, e: int) -> float:
        return NOTHING if out[e] else w["textlink" if kind == "link" and under[e] else kind] + extra[e]

    return [(0.0 if out[e] else TEXT_TAG if under[e] else weights.tag(t.lstrip("/"))) if kind is None else word(kind, e) * len(t.split()) for kind, t, e in p.events]


def best_region(scores: list[float]) -> tuple[int, int]:
    """The places from and up to which the sum is highest; the first of equal ones."""
    best = sum_ = 0.0
    lo = hi = start = 0
    for i, x in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += x
        if sum_ > best:
            best, lo, hi = sum_, start, i + 1
    return lo, hi


def region_text(p: Page, out: list[bool], lo: int, hi: int) -> str:
    blocks: list[str] = []
    now: list[str] = []
    for kind, t, e in p.events[lo:hi]:
        if kind is None:
            tag = t.lstrip("/")
            if tag == "br":
                now.append(" ")
            elif tag in BLOCKS:
                blocks.append("".join(now))
                now = []
        elif not out[e]:
            now.append(t)
    blocks.append("".join(now))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract(page: str | None, weights: Weights) -> str:
    """The text of the best region."""
    if not page:
        return ""
    p = read(page)
    out, extra, under = judged(p, weights)
    return region_text(p, out, *best_region(scored(p, weights, out, extra, under)))


def counted(page: str, sums: dict[tuple[str, str], list[int]]) -> None:
    """Adds a labelled page's counts inside and outside its articles: words by kind and by the names around them, and tags.

    Furniture by list or tag explains its own words and tags; what it holds counts for the other names around it alone, as outside.
    """
    p = read(page)
    k = len(p.tag)
    plain = [True] * k
    around: list[frozenset[str]] = [frozenset()] * k
    for e in range(1, k):
        a = p.up[e]
        plain[e] = plain[a] and not is_element(p, e) and not (p.tag[e] not in ("html", "body", "main", "article") and listed(p, e))
        around[e] = around[a].union(p.names[e]) if p.names[e] and len(around[a]) < 64 else around[a]

    def add(what: str, name: str, n: int, inside: bool) -> None:
        row = sums.setdefault((what, name), [0, 0])
        row[0 if inside else 1] += n

    for kind, t, e in p.events:
        inside, n = bool(p.article[e]) and plain[e], 1 if kind is None else len(t.split())
        if kind is None:
            if plain[e]:
                add("tag", t.lstrip("/")[:40], n, inside)
        elif n:
            if plain[e]:
                add("word", kind, n, inside)
            for name in around[e]:
                add("name", name[:40], n, inside)


def weights_from(counts: dict[tuple[str, str], tuple[float, float]]) -> Weights:
    """counts: ('word', 'tag' or 'name', which one) to how many stand inside and outside articles."""
    totals = [1 + sum(v[i] for (k, _), v in counts.items() if k == "word") for i in (0, 1)]
    share = [t / sum(totals) for t in totals]

    def odds(what: str, name: str, prior: float) -> float:
        """Log-odds, of ``PRIOR_WORDS`` words as the prior has them and those counted."""
        inside, outside = counts.get((what, name), (0, 0))
        return math.log((inside + PRIOR_WORDS * share[0] * math.exp(prior)) / totals[0]) - math.log((outside + PRIOR_WORDS * share[1]) / totals[1])

    words = {kind: max(-MOST, min(MOST, odds("word", kind, w))) for kind, w in PRIOR.items()}
    tags = {name: min(TEXT_TAG, max(-2.0, odds(k, name, TEXT_TAG if name in TEXT_TAGS else OTHER_TAG))) for k, name in counts if k == "tag"}
    names = {name: max(LEARNED[0], min(LEARNED[1], odds(k, name, 0.0))) for k, name in counts if k == "name"}
    return Weights(words, tags, names)


def fit(pages: DataFrame, max_labelled: int = 2000, max_names: int = 5000) -> Weights:
    """Weights from at most ``max_labelled`` labelled pages, those of the smallest id hash, and their ``max_names`` most frequent tags and names."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for page in batch.column("html").to_pylist():
                counted(page, sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], names=["what", "name", "inside", "outside"])

    labelled = pages.where(F.col("html").contains("<article") | F.col("html").contains("<main"))
    ids = labelled.where(F.col("page_id").isNotNull()).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_labelled)
    # at most max_labelled ids: a proven bound for the broadcast
    some = labelled.join(F.broadcast(ids), "page_id", "left_semi").select("html").mapInArrow(work, "what string, name string, inside long, outside long")
    # what is rarer than max_names others keeps its prior weight
    rows = some.groupBy("what", "name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).orderBy(F.desc(F.col("inside") + F.col("outside")), "what", "name").limit(max_names).collect()
    return weights_from({(r.what, r.name): (r.inside, r.outside) for r in rows})


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    weights = weights or fit(pages)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [extract(p, weights) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
