"""Main text of pages by two passes over blocks: decide clear blocks, then let short and doubtful ones follow their neighbours."""
from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

from .registry import query, table
from .stop_words import STOP_LISTS

# Fixed values of the method: lengths in characters, densities as shares of words and of characters.
SHORT, LONG = 70, 200
# Shares of stop words as the lists held give them: ordinary prose of their languages has 0.18 to 0.4, lists of names and data under 0.1.
STOP_LOW, STOP_HIGH = 0.12, 0.18
LINK_HIGH = 0.2
LINK_HIGH_IN_ARTICLE = 0.5
#: Share of a page's prose with which a wrapper holds its main text.
MOST = 0.75

_SHORT_WORDS = {
    "english": "a about after all also an and are as at be been but by can could did do for from had has have he her his if in into is it its "
    "may more no not of on or our out she so some such than that the their them then there these they this to up was we were what "
    "when which who will with would you your",
    "german": "als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich im in ist "
    "mit nach nicht noch nur oder sich sie sind so über um und von vor war was wie wird zu zum zur",
    "french": "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour qu que "
    "qui sa se ses son sont sur un une vous",
    "spanish": "al como con de del el ella ellos en era es esta este fue ha la las lo los más me no o para pero por que se ser si sin sobre su "
    "sus también un una y ya",
}
#: For each stop word, the languages that have it.
STOP_WORDS: dict[str, tuple[str, ...]] = {}
for _name, _words in STOP_LISTS.items():
    for _word in _words | frozenset(_SHORT_WORDS.get(_name, "").split()):
        STOP_WORDS[_word] = STOP_WORDS.get(_word, ()) + (_name,)

WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts without a stop list: neither Latin nor Cyrillic.
OTHER_SCRIPT = re.compile(r"[^\W\d_A-Za-z\u00aa-\u024f\u0400-\u052f\u1e00-\u1eff]")
#: Letters of scripts written without spaces, of which one says about as much as three Latin ones.
DENSE_SCRIPT = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")

BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never main text.
OUTSIDE = frozenset("button fieldset footer head legend menu nav option select".split())
#: Elements that stand around the main text, unless they hold most of it (a page within one form, say).
SETTLED = frozenset("aside dialog form header".split())
INLINE_KEPT = frozenset("button option select span".split())
#: Elements whose content is not markup.
RAW = "script|style|noscript|template|textarea|iframe|svg|object|title|xmp"
VOID = frozenset("hr br img input meta link".split())
#: Parts of class names, ids and roles that name what stands around an article.
AROUND = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "copyright dialog discussion disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar warning widget".split())
COMMENTS = frozenset("comment comments discussion disqus replies reply respond".split())
#: Of these, words that also name subjects: inside an article a section so named stays if it holds prose.
SUBJECTS = frozenset("promoted recommended related respond search sharing social warning widget".split())
#: First and last parts of names that say something of an element's state or neighbours, not what it is.
STATE_FIRST = frozenset("backface cat category has no not overflow tag term topic with without".split())
STATE_LAST = frozenset("active allowed aware closed collapsed disabled enabled expanded off offset on open opened shown visible".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*[^>]*>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-z!?/][^>]*\Z",
    re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
HIDDEN_VALUE = re.compile(r"aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SHOWN_WIDE = re.compile(r":(?:block|contents|flex|grid|inline\S*|table\S*)$")
PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])", 0)


class Block:
    __slots__ = ("text", "linked", "outside", "article", "heading", "wrappers")

    def __init__(self, text: str, linked: int, outside: bool, article: bool, heading: bool, wrappers: tuple[Wrapper, ...] = ()):
        self.text, self.linked, self.outside, self.article, self.heading, self.wrappers = text, linked, outside, article, heading, wrappers


class Wrapper:
    """An element that by its names stands around the article."""

    __slots__ = ("comment", "subject", "main", "hides")

    def __init__(self, comment: bool, subject: bool = False):
        self.comment, self.subject, self.main, self.hides = comment, subject, False, True


def _hidden(attributes: str) -> bool:
    return bool(HIDDEN.search(QUOTED.sub("\"\"", attributes)) or HIDDEN_VALUE.search(attributes))


def _named(tag: str, attributes: str) -> Wrapper | None:
    """A wrapper if class names, id or role say that an element stands around the article or holds reader comments."""
    words: set[str] = set()
    for m in NAMES.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        names = value.split()
        shown = any(SHOWN_WIDE.search(x) for x in names)
        for name in names:
            if ":" in name or shown and name.lower() == "hidden":
                continue
            parts = [x for x in re.split(r"[^a-z0-9]+", name.lower()) if x]
            finer = [x.lower() for x in PARTS.split(name.replace("_", "-")) if x]
            if parts and not (len(finer) > 1 and (finer[0] in STATE_FIRST or finer[-1] in STATE_LAST)):
                words.update(parts, finer)
    hit = words & AROUND
    if tag in HEADINGS:
        hit = hit - {"header", "banner"}
    return Wrapper(bool(words & COMMENTS), hit <= SUBJECTS) if hit or words & COMMENTS else None


def _prose_chars(b: Block, least: int) -> int:
    size = weight(b.text)
    return size if size >= least and b.linked <= LINK_HIGH * len(b.text) else 0


def _settle(found: list[Block]) -> None:
    """Lets wrappers hide what they hold, but not the page's main element, nor most of its prose where no article lies elsewhere.

    Comments hide unless the page has no other prose. Inside an article a section named like a subject hides unless it
    holds prose.
    """
    wrappers = {w: None for b in found for w in b.wrappers}
    if not wrappers:
        return
    seen = [b for b in found if not b.outside]
    least = LONG if any(_prose_chars(b, LONG) for b in seen if not any(w.comment for w in b.wrappers)) else SHORT
    size = {id(b): _prose_chars(b, least) for b in seen}
    total, apart, held, within = 0, 0, {}, {}
    for b in seen:
        own = _prose_chars(b, SHORT)
        apart += own
        for w in b.wrappers:
            within[w] = within.get(w, 0) + own
        if not any(w.comment for w in b.wrappers):
            total += size[id(b)]
            for w in b.wrappers:
                held[w] = held.get(w, 0) + size[id(b)]
    clear = any(b.article and not b.wrappers and _prose_chars(b, SHORT) for b in seen)
    prose = {w for b in seen if b.article and _prose_chars(b, LONG) for w in b.wrappers}
    for w in wrappers:
        if w.main or w.subject and not w.comment and w in prose:
            w.hides = False
        elif w.comment:
            w.hides = clear or within.get(w, 0) < apart or not apart
        else:
            w.hides = clear or held.get(w, 0) <= MOST * total
    for b in seen:
        b.outside = any(w.hides for w in b.wrappers)


def blocks(page: str) -> list[Block]:
    """Stretches of text between block elements, in page order, with their white space as single spaces."""
    out: list[Block] = []
    # Element; 1 in an article's own header or 2 outside; named wrappers; whether in an article; whether in one without names.
    open_: list[tuple[str, int, tuple[Wrapper, ...], bool, bool]] = []
    text: list[str] = []
    linked, in_link, heading = 0, False, False
    outside = article = False
    wrappers: tuple[Wrapper, ...] = ()

    def close_block():
        nonlocal linked, in_link
        if text:
            words = "".join(text).split()
            if words:
                out.append(Block(" ".join(words), linked, outside, article, heading, wrappers))
            text.clear()
        linked, in_link = 0, False

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            if "&" in piece:
                piece = html.unescape(piece)
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, end = tag.lower(), bool(m[2] or m[5])
        if tag == "a":
            in_link = not end
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCK and tag not in INLINE_KEPT:
            continue
        if tag != "span":
            close_block()
        if end:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    if tag == "span" and any(x[1] or x[2] for x in open_[k:]):
                        close_block()
                    del open_[k:]
                    break
        elif tag not in VOID:
            attributes = m[4] or m[7] or ""
            named = _named(tag, attributes) if attributes and tag != "body" else None
            hidden = bool(attributes) and tag != "body" and _hidden(attributes)
            own = (named,) if named else ()
            if tag == "body":
                # What was left open before the body does not hold it, and its names are of the whole page.
                open_.clear()
                open_.append((tag, 0, (), False, False))
            elif tag in ("main", "article"):
                # What was left open before the article does not hold it, unless readers wrote it.
                _, level, around, _, inside = open_[-1] if open_ else (None, 0, (), False, False)
                if tag == "main":
                    for w in (*around, *own):
                        w.main = True
                if not inside:
                    around = tuple(w for w in around if w.comment)
                level = 2 if hidden or level == 2 and inside else 0
                open_.append((tag, level, around + own, True, inside or not (level or around or own)))
            else:
                if tag in ("p", "li", "dt", "dd", "td", "th", "tr") or tag in HEADINGS:
                    # These end an open element of their own kind.
                    if open_ and open_[-1][0] in ("p", *HEADINGS) or open_ and open_[-1][0] == tag:
                        open_.pop()
                above = open_[-1] if open_ else (None, 0, (), False, False)
                if tag == "header" and above[3] and not hidden:
                    level = 1
                    own = own if named and named.comment else ()
                else:
                    level = 2 * (hidden or tag in OUTSIDE)
                    if tag in SETTLED and not own:
                        own = (Wrapper(False),)
                if tag == "span" and (level or own):
                    close_block()
                # Of an article's header only the headings are text.
                open_.append((tag, 0 if tag in HEADINGS and above[1] == 1 and not level else max(above[1], level), above[2] + own, above[3], above[4]))
        outside, wrappers, article = (open_[-1][1] > 0, open_[-1][2], open_[-1][3]) if open_ else (False, (), False)
        heading = bool(open_) and open_[-1][0] in HEADINGS
    if at < len(page):
        piece = html.unescape(page[at:])
        text.append(piece)
        if in_link:
            linked += len(piece.strip())
    close_block()
    _settle(out)
    return out


def stop_counts(text: str) -> tuple[int, dict[str, int]]:
    """Words of a text, and the stop words among them by language."""
    words = WORD.findall(text.lower())
    counts: dict[str, int] = {}
    for w in words:
        for name in STOP_WORDS.get(w, ()):
            counts[name] = counts.get(name, 0) + 1
    return len(words), counts


def weight(text: str) -> int:
    """Length of a text in Latin letters."""
    return len(text) if text.isascii() else len(text) + 2 * len(DENSE_SCRIPT.findall(text))


def _other_script(text: str) -> bool:
    return not text.isascii() and 2 * len(OTHER_SCRIPT.findall(text)) > sum(map(len, WORD.findall(text)))


def first_pass(found: list[Block]) -> tuple[list[bool | None], list[bool]]:
    """For each block True for main text, False for what surrounds it, None if in doubt; and whether it reads as prose.

    Where no list fits what a page says, or a block's script has none, stop words tell nothing: a long block poor in
    links is main text there, a middling one in doubt.
    """
    size = [weight(b.text) for b in found]
    verdict: list[bool | None] = [None] * len(found)
    open_: list[tuple[int, float]] = []
    total, by_name = 0, {}
    for i, b in enumerate(found):
        if b.outside or b.linked / len(b.text) > (LINK_HIGH_IN_ARTICLE if b.article else LINK_HIGH) or b.text[0] == "©" and not b.article:
            verdict[i] = False
        elif size[i] < SHORT:
            verdict[i] = None if b.article or not b.linked else False
        elif _other_script(b.text):
            open_.append((i, 1.0))
        else:
            n, counts = stop_counts(b.text)
            total += n
            for name, k in counts.items():
                by_name[name] = by_name.get(name, 0) + k
            open_.append((i, max(counts.values(), default=0) / max(n, 1)))
    unlisted = max(by_name.values(), default=0) < STOP_LOW * total
    prose = [False] * len(found)
    for i, stops in open_:
        prose[i] = unlisted or stops >= STOP_HIGH
        if prose[i] and size[i] > LONG:
            verdict[i] = True
        elif not (prose[i] or stops >= STOP_LOW or found[i].article):
            verdict[i] = False
    return verdict, prose


def main_blocks(page: str) -> list[Block]:
    """Blocks judged to be main text.

    Where a page marks an article, only what lies in it can be main text, unless long paragraphs elsewhere are nearly all of
    the page's prose, as where articles are teasers. A doubtful block follows the nearest decided
    block of its zone, a heading the one after it; between two at equal distance, and without any, it is main text. A
    doubtful block of prose needs main text on one side only, and is itself main text where no block is so clearly.
    """
    found = [b for b in blocks(page) if not b.outside]
    inside = sum(_prose_chars(b, SHORT) for b in found if b.article)
    beside = sum(_prose_chars(b, LONG) for b in found if not b.article)
    alone = any(b.article for b in found) and beside <= MOST * (inside + beside)
    if alone:
        found = [b for b in found if b.article]
    else:
        for b in found:
            b.article = False  # a teaser says nothing of the page
    first, prose = first_pass(found)
    if not alone and True not in first:
        first = [True if v is None and p else v for v, p in zip(first, prose)]
    n = len(found)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        before[i] = last
        if first[i] is not None:
            last = i
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        if first[i] is not None:
            last = i
    kept = []
    for i, b in enumerate(found):
        verdict = first[i]
        if verdict is None:
            p, q = before[i], after[i]
            if p is None and q is None:
                verdict = True
            elif p is None or q is None:
                verdict = first[q if p is None else p]
                if alone and not verdict:
                    verdict = not b.linked
            elif b.heading:
                verdict = first[q]
            elif prose[i] or i - p == q - i:
                verdict = first[p] or first[q]
            else:
                verdict = first[p] if i - p < q - i else first[q]
        if verdict:
            kept.append(b)
    return kept


def extract(page: str | None) -> str:
    return "\n".join(b.text for b in main_blocks(page or ""))


def main_text(page: Column) -> Column:
    """Main text of an HTML column: blocks joined by line breaks; empty for null, empty and text-free pages."""
    return arrow_udf(lambda a: pa.array([extract(p.as_py()) for p in a], pa.string()), "string")(page.cast("string"))


@query("op7_html_two_pass_blocks")
def op7(spark, folder):
    got = table(spark, folder, "pages").select("page_id", "url", main_text(F.col("html")).alias("text"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
