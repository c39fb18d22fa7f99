"""The main text of web pages as a maximum-scoring subsequence.

A page is a row of words and tags. A word's kind says where it stands: in the page's main elements,
outside them, in a part such as a menu or footer, or in a page without main elements; what encloses
most of the text is no such part, whatever its name. Main elements are article and main, or an
element named as the content that holds more of the text than articles do. What a word's block is
(heading, paragraph, list item or cell; links; a notice of rights) is seen in every page. Labelled pages, those with an article or main element, tell what such blocks are worth,
as log-odds of standing in the text, and these decide on words where no element does; a tag's weight
is at most slightly negative. One linear scan finds the contiguous region of the greatest sum, and
its blocks, without the parts that are never text, are the page's text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.tables import named

LABELLED_PAGES = 2000

# Fixed lists of HTML: elements whose content is not text, that part blocks, and that are empty.
UNSEEN = frozenset("script style noscript template svg math iframe object canvas audio video title select textarea button".split())
# Of those, the ones whose content runs to the end of a page that does not close them, and that cannot hold their like.
SCRIPTS = frozenset(["script", "style"])
ONCE = frozenset("title select textarea button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
ASIDE = frozenset("nav aside footer form menu dialog".split())
PARTS = ASIDE - {"form"} | {"header"}  # these wrap a page only if they enclose its article or main element
# Words of class and id attributes and roles that mark parts other than the text.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar nav navigation navbar menu menubar breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices banner alert popup modal newsletter subscribe signup login comment comments disqus respond replies "
    "share sharing social related recommended widget masthead copyright pagination pager contentinfo complementary search".split()
)

# Words of class and id attributes that name the content.
CONTENT_NAMES = frozenset("content main article post entry story maincontent".split())
# Headings above what readers say.
_COMMENTS = re.compile(r"[\W\d]*(?:(?:reader|user)s?\W+)?(?:comments?|responses|replies)[\W\d]*", re.I)
_RIGHTS = re.compile(r"©|&copy;|&#169;|\bcopyright\b|\ball rights reserved\b", re.I)

# A quote opens a value only behind "=". Attributes are never tried a second way, so a tag is scanned once.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>|<[!?][^>]*+(?:>|\Z)|([^<]++|<)", re.S
)
# After a tag that runs to the end of the page, tags end at the next < or >.
_BROKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?][^<>]*+>?|([^<]++|<)", re.S)
_TAG = re.compile(r"</?[a-zA-Z]")
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:\shidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true)", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in UNSEEN}
_AGAIN = {name: re.compile(rf"<{name}(?=[\s/>])", re.I) for name in ONCE}
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
_SPACE = re.compile(r"[\s\xa0]+")


def _marked(name: str, attributes: str, in_main: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_main):
        return True
    if name in ("html", "body", *MAIN) or not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    words = _named(attributes)
    if words & {"no", "has", "with", "without"}:  # such as "no-sidebar", of a page that has or lacks such parts
        return False
    return bool(words & ASIDE_NAMES) or ("header" in words and not in_main)


def _markup(page: str) -> Iterator[tuple[str, str, str, str | None]]:
    """(closing, name, attributes, text) of tags, and of words as text; what unseen elements hold is passed over.

    An unseen element ends at its own end tag, whatever stands before that. Without one (or if another
    of a kind that cannot hold its like begins first) it ends before the next block tag.
    """
    at, pattern, endless, found = 0, _TOKEN, set(), {}
    while m := pattern.match(page, at):
        if m[4] == "<" and pattern is _TOKEN and _TAG.match(page, at):
            pattern = _BROKEN
            continue
        at = m.end()
        closing, name, attributes, text = m[1] or "", (m[2] or "").lower(), m[3] or "", m[4]
        if text is not None or name:
            yield closing, name, attributes, text
        if name in UNSEEN and not closing and not attributes.endswith("/"):
            end = found.get(name)
            if name not in endless and (not end or end.start() < at):
                end = found[name] = _ENDS[name].search(page, at)
            if not end:
                endless.add(name)
            elif name not in ONCE or not _AGAIN[name].search(page, at, end.start()):
                at = end.end()
                continue
            block = None if name in SCRIPTS else _BLOCK.search(page, at)
            at = block.start() if block else len(page)


def _named(attributes: str) -> set[str]:
    """The words of classes, ids and roles."""
    return {w for m in _MARKS.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}


def _spans(row: list[tuple[str, str, str, str | None]]) -> dict[int, int]:
    """Of the opening tags the places of their end tags, or of the end of the page."""
    open_: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, (closing, name, attributes, text) in enumerate(row):
        if text is not None or name in UNSEEN or name in VOID:
            continue
        if closing:
            if open_.get(name):
                ends[open_[name].pop()] = i
        elif not attributes.endswith("/"):
            open_.setdefault(name, []).append(i)
            ends[i] = len(row)
    return ends


def _mains(row: list[tuple[str, str, str, str | None]], spans: dict[int, int]) -> set[int]:
    """Places of the opening tags of the main elements.

    Without a main element, one named as the content that holds more than half of the plain words,
    no article, and stands in none, comes before the articles, which then are cards beside it.
    """
    marked = sorted(i for i in spans if row[i][1] in MAIN)
    if any(row[i][1] == "main" for i in marked):
        return set(marked)
    words, links, cover, covered = [0], 0, -1, []  # plain words before each place; does an article stand around it?
    for i, (closing, name, _, text) in enumerate(row):
        words.append(words[-1] + (len(text.split()) if text is not None and not links else 0))
        if text is None and name == "a":
            links = 0 if closing else 1
        if name in MAIN and i in spans:
            cover = max(cover, spans[i])
        covered.append(i < cover)
    content = {
        i
        for i, end in spans.items()
        if row[i][2] and not covered[i] and 2 * (words[end] - words[i]) > words[-1] and _named(row[i][2]) & CONTENT_NAMES
        and row[i][1] not in ("html", "body") and not _marked(row[i][1], row[i][2], False) and not any(i < m < end for m in marked)
    }
    return content or set(marked)


def _wrappers(row: list[tuple[str, str, str, str | None]], spans: dict[int, int], mains: set[int]) -> set[int]:
    """Places of the opening tags that look like those of parts but enclose the page's text.

    They hold more than half of the plain words (those outside links) of the main elements, or
    of the page if it has none. A menu, footer or the like, and what is hidden, must enclose these elements.
    """
    links, until, words, within = 0, -1, [0], [0]  # words before each place, and those of them in main elements
    found: dict[int, str] = {}  # and what it may enclose
    for i, (closing, name, attributes, text) in enumerate(row):
        n = len(text.split()) if text is not None and not links else 0
        words.append(words[-1] + n)
        within.append(within[-1] + (n if i < until else 0))
        if text is not None or name in UNSEEN:
            continue
        if name == "a":
            links = 0 if closing else 1
        if i in spans and _marked(name, attributes, i < until):
            part = name in PARTS or _HIDDEN.search(attributes) is not None
            found[i] = "main" if part and i >= until else "" if part else "any"
        if i in mains:
            until = max(until, spans[i])
    counts, enclosed = (within, ("any", "main")) if within[-1] else (words, ("any",))
    return {at for at, what in found.items() if what in enclosed and 2 * (counts[spans[at]] - counts[at]) > counts[-1]}


def _comments(row: list[tuple[str, str, str, str | None]], spans: dict[int, int]) -> dict[int, int]:
    """Of headings above readers' comments the place where the element that holds them ends."""
    found, open_ = {}, []
    for i, (closing, name, _, text) in enumerate(row):
        if text is None and not closing and i in spans:
            while open_ and open_[-1] <= i:
                open_.pop()
            if len(name) == 2 and name[0] == "h" and name[1] in "123456" and spans[i] - i < 20:
                if _COMMENTS.fullmatch("".join(t or "" for *_, t in row[i : spans[i]])):
                    found[i] = open_[-1] if open_ else len(row)
            open_.append(min(spans[i], open_[-1]) if open_ else spans[i])
    return found


def _described(block: str, texts: list[tuple[str, bool]]) -> tuple[str, ...]:
    """What can be said of a block in any page: its tag, whether it is links, whether it tells of rights. Not its length: short paragraphs are text."""
    words = sum(len(t.split()) for t, _ in texts)
    linked = sum(len(t.split()) for t, link in texts if link)
    tag = "heading" if block[:1] == "h" and block[1:].isdigit() else block if block in ("p", "li", "td", "th", "dd", "dt") else ""
    rights = ("rights",) if words <= 60 and any(_RIGHTS.search(t) for t, _ in texts) else ()
    return (*((f"in:{tag}",) if tag else ()), "links" if 2 * linked > words else "no links", *rights)


def tokens(page: str) -> list[tuple[str, str, bool, tuple[str, ...]]]:
    """(kind, text, parts, description): words with their text, kind and their block's description, tags with their kind; ``parts`` if a block ends there."""
    row = list(_markup(page))
    spans = _spans(row)
    mains = _mains(row, spans)
    wrappers = _wrappers(row, spans, mains)
    comments = {} if mains else _comments(row, spans)
    aside, aside_depth, links, main_until, silent = "", 0, 0, -1, -1
    found: list[tuple[str, str, bool, tuple[str, ...]]] = []
    block, texts, at = "", [], []  # the open block: its tag, its texts and their places in ``found``

    def describe() -> None:
        said = _described(block, texts)
        for i in at:
            found[i] = (*found[i][:3], said)
        texts.clear()
        at.clear()

    for i, (closing, name, attributes, text) in enumerate(row):
        main = i < main_until
        if text is not None:
            kind = "word:aside" if aside or i < silent else "word:main" if main else "word:outside" if mains else "word:plain"
            texts.append((text, links > 0))
            at.append(len(found))
            found.append((kind, text, False, ()))
            continue
        if name in UNSEEN and not closing and not attributes.endswith("/"):
            found.append((f"tag:{name}" if not aside else "tag:aside", "", False, ()))
            continue
        silent = max(silent, comments.get(i, -1))
        if aside:
            aside_depth += (name == aside) * (-1 if closing else 1)
            if not aside_depth:
                aside = ""
        elif i in spans and i not in wrappers and _marked(name, attributes, main):
            aside, aside_depth = name, 1
        if i in mains:
            main_until = max(main_until, spans[i])
        elif i == main_until:  # what was left open in the main element ends with it
            aside, aside_depth = "", 0
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            found.append(("tag:br", " ", False, ()))
        else:
            if name in BLOCKS:
                describe()
                block = "" if closing else name
            found.append(("tag:aside" if aside else f"tag:{closing}{name}", "", name in BLOCKS, ()))
    describe()
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tag, kind of word and description of a block how often it occurs inside and outside the main elements of pages that have some."""
    for batch in batches:
        found: Counter = Counter()
        for page in batch.column(0).to_pylist():
            row = tokens(page)
            if not any(kind == "word:main" for kind, *_ in row):
                continue
            inside = 0
            for kind, text, _, said in row:
                if kind.startswith("word"):
                    n = len(text.split())
                    found[kind, inside > 0] += n
                    for feature in (*said, "words") if n else ():
                        found[feature, kind == "word:main"] += n
                    continue
                if kind[4:] in MAIN:
                    inside += 1
                elif kind[5:] in MAIN and kind[4] == "/":
                    inside = max(0, inside - 1)
                found[kind, inside > 0] += 1
        rows = [(k, i, n) for (k, i), n in found.items() if n and (not k.startswith("tag") or k[4:].lstrip("/") in BLOCKS | VOID | UNSEEN)]
        kinds, insides, ns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(insides, pa.bool_()), pa.array(ns, pa.int64())], names=["kind", "inside", "n"])


def learn_weights(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", labelled_pages: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most about ``labelled_pages`` labelled pages, which ids' hashes choose.

    The driver gets two numbers for each kind of word, each description and each tag of the fixed lists.
    """
    labelled = pages.select(named(pages, html_column).alias("html"), F.xxhash64(named(pages, id_column), F.lit("labelled")).alias("h")).filter(
        F.col("html").rlike(r"(?i)<(article|main)[\s>]")
    )
    bound = int(min(1.0, labelled_pages / max(1, labelled.count())) * (1 << 40))
    sample = labelled.filter(F.pmod("h", F.lit(1 << 40)) < bound).select("html")
    told = sample.mapInArrow(_counts, "kind string, inside boolean, n long").groupBy("kind").pivot("inside", [True, False]).sum("n").collect()
    return weights_of({r["kind"]: (r["true"] or 0, r["false"] or 0) for r in told})


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights from numbers (inside, outside): log-odds of tags and kinds, log-likelihood ratios of descriptions, by word.

    Words of main elements score positive and tags negative, whatever was learned or not met.
    """
    odds = {k: math.log((i + 0.5) / (o + 0.5)) for k, (i, o) in counts.items()}
    weights = {k: max(-0.1, min(-0.01, w / 100)) for k, w in odds.items() if k.startswith("tag")}
    weights["word:main"] = max(1.0, odds.get("word:main", 1.0))
    # What stands outside or in marked parts is left out wherever it is, so it need not end a region.
    weights["word:outside"] = weights["word:aside"] = weights["tag:aside"] = -0.001
    inside, outside = counts.get("words", (0, 0))
    if inside and outside:
        for k, (i, o) in counts.items():
            if k != "words" and not k.startswith(("tag", "word:")):
                ratio = math.log((i + 1) / (inside + 2)) - math.log((o + 1) / (outside + 2))
                weights[k] = max(-2.0, min(2.0, ratio))
    return weights


def _plain(said: tuple[str, ...], weights: dict[str, float]) -> float:
    """The weight of a word where no element tells: what its block's description was learned to be worth."""
    if "no links" not in weights:  # nothing learned
        return -0.5 if "links" in said else 1.0
    return sum(weights.get(f, 0.0) for f in said)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region of the greatest positive sum, the first of such; (0, 0) if there is none."""
    best, total, start = (0.0, 0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best[0]:
            best = (total, start, i + 1)
    return best[1:]


def extract(page: str, weights: dict[str, float]) -> str:
    """The text of one page.

    Where what was learned gives no region a positive sum, plain words count one each, links less;
    without a positive sum by that either, the text is empty.
    """
    row = tokens(page)

    def region(learned: dict[str, float]) -> tuple[int, int]:
        scores = []
        for kind, text, _, said in row:
            weight = _plain(said, learned) if kind == "word:plain" else weights.get(kind, -0.05)
            scores.append(weight * (len(text.split()) if kind.startswith("word") else 1))
        return best_region(scores)

    first, end = region(weights)
    if not end:
        first, end = region({})
    blocks, open_ = [], []
    for kind, text, parts, _ in row[first:end]:
        if parts:
            blocks.append("".join(open_))
            open_ = []
        elif kind == "tag:br" or kind in ("word:main", "word:plain"):
            open_.append(text)
    blocks.append("".join(open_))
    cleaned = (_SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in cleaned if b)


def _extract(batches: Iterator[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page or "", weights) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, weights: dict[str, float], id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The id, url and ``text`` of every page, from its whole html, without a shuffle.

    A null or empty html, and a page without words, has the empty text. Repeated rows get equal
    results; other columns are neither read nor returned.
    """
    id_, url = named(pages, id_column), named(pages, url_column)
    narrow = pages.select(id_.alias("page_id"), url.cast("string").alias("url"), named(pages, html_column).alias("html"))
    kind = narrow.schema[0].dataType.simpleString()
    told = narrow.mapInArrow(partial(_extract, weights=weights), f"page_id {kind}, url string, text string")
    return told.withColumnsRenamed({"page_id": id_column, "url": url_column})
