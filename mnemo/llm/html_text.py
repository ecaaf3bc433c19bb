"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels each block good, bad, near-good or short by stop-word
density, length and link density, with its place in the page as further evidence. The furniture of a page (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) is bad. An element that only its name, its role or a form makes
furniture is none if it holds more than half of the page's text outside links, or all articles and a third of that text; so
the wrappers that some sites put around everything do no harm. Comments are named so, or begin at a heading that says so. In
an <article> or <main> element nothing but a list of links is bad: what its words alone would reject is near-good there.
Where a page has such an element, what is outside is near-good at best. The stop words are those of four languages; on a page
on which they are too rare for any of these, sentences take their place: a block with the end of a sentence is worth as many
stop words as a good one, and characters of scripts without spaces count thrice. In the second pass near-good and short blocks inherit the label of the nearest decided blocks of their
part of the page, and where there is none, that part decides. Titles count with what follows them.

Defined cases: null html is empty; a page without main text has the empty text; an empty table gives no rows. Unclosed and
stray tags are closed by the elements around them, and whatever follows "<![" up to the next ">" is a comment. Pages of any
length and nesting are taken whole, in time that grows with their length. A comment without an end takes the rest of the
page, and a link without an end stops where the next block begins. Repeated rows give equal results; null
page_id and url stand as they are. Only page_id, url and html are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element names of HTML, common function words of four languages, and words that name page furniture
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template head title svg math iframe object canvas audio video select button textarea".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
TITLE_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_TAGS = frozenset("article main".split())
FURNITURE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|header|footer|foot|masthead|sidebar|side|aside|related|recommend\w*|share|sharing|social|"
    r"comment\w*|disqus|replies|respond|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|breadcrumbs?|pagination|pager|widget|copyright|toolbar|skip)(?:$|[-_ ])",
    re.IGNORECASE,
)
#: Names that only tell of furniture elsewhere.
OTHER_NAMES = re.compile(r"(?:has|with|without|no|is)[-_]|.*[-_](?:free|less|enabled|open)$", re.IGNORECASE)
COMMENT_NAMES = re.compile(r"(?:^|[-_])(?:comments?|commentlist|disqus|repl(?:y|ies)|responses?|respond)(?:$|[-_])", re.IGNORECASE)
COMMENT_TITLES = re.compile(r"(?:\d+ )?(?:(?:reader|user|all) )?(?:comments?|kommentare?|commentaires?|comentarios?|responses)(?: ?\(?\d*\)?)?:?|(?:leave|post|write) a (?:comment|reply)|(?:reader|user) (?:comments|responses|replies)", re.IGNORECASE)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his i if in is it its more no not of on or our she so that the their there they this to was we were what when which who will with would you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "aber als am auch auf aus bei das dass dem den der die ein eine einem einen einer er es für hat ich im ist mit nach nicht oder sich sie sind so über um und uns von vor war wie wir zu zum zur "
    "al como con cuando del el ella entre era ese esta este fue hay las lo los más me muy para pero por porque se si sin sobre su sus también una y ya".split()
)

#: Silent elements that can hold blocks if they are closed, and end at the next block if their end tag is left out. The
#: parser reads script, style, title, iframe and textarea as text up to their end tags, so blocks in those are none.
CLOSABLE_TAGS = frozenset("a button select object svg math video audio canvas noscript template".split())
#: Of these, another start closes the one before; and the blocks that do not end them.
FLAT_TAGS = frozenset("a button select".split())
HELD_TAGS = frozenset("option br hr".split())
_closable = re.compile("<(?:" + "|".join(sorted(CLOSABLE_TAGS - {"a"})) + ")\\b", re.IGNORECASE)
_link_starts, _link_ends = re.compile("<a[\\s>]", re.IGNORECASE), re.compile("</a\\b", re.IGNORECASE)

#: Characters of a short and of a long block; the share of stop words of near-good and of good blocks; the share of
#: characters in links beyond which a block is bad, and that of a list of links within content.
SHORT, LONG, STOP_LOW, STOP_HIGH, MAX_LINKS, LISTED = 70, 200, 0.2, 0.3, 0.2, 0.8
#: The share of stop words on a page below which no list of them fits; the shares of a page's text that pardon an element.
STOP_FITS, MOST, WITH_ARTICLES = 0.1, 1 / 2, 1 / 3
GOOD, BAD, NEAR, BRIEF = "good", "bad", "near", "short"

_word = re.compile(r"[^\W\d_]+")
_space = re.compile(r"\s+")
_ended = re.compile(r"[.!?…。！？؟۔।։]")
_dense = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e00-\u0eff]")
_comment_end = re.compile("--!?>")


class _Parser(HTMLParser):
    """A parser to which "<![" begins a comment, as HTML has it, and not an error, and a comment without an end takes the rest."""

    def parse_comment(self, i: int, report: bool = True) -> int:
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = _comment_end.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i):
            end = self.rawdata.find(">", i)
            return len(self.rawdata) if end < 0 else end + 1
        return super().parse_html_declaration(i)


class _Ends(_Parser):
    """Finds the closable elements without an end tag, as (element, its number among its like)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.started: Counter[str] = Counter()
        self.waiting: dict[str, list[int]] = {t: [] for t in CLOSABLE_TAGS}
        self.unclosed: set[tuple[str, int]] = set()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSABLE_TAGS:
            if tag in FLAT_TAGS and self.waiting[tag]:
                self.unclosed.add((tag, self.waiting[tag].pop()))
            self.waiting[tag].append(self.started[tag])
            self.started[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        if tag in CLOSABLE_TAGS and self.waiting[tag]:
            self.waiting[tag].pop()

    def close(self) -> None:
        super().close()
        self.unclosed |= {(t, n) for t, rest in self.waiting.items() for n in rest}


class _Blocks(_Parser):
    """Collects the text, the characters in links and whether it is a title of each block, and of each element of interest the blocks that it holds.

    An element's blocks are a range, so what holds for them is settled once all are known.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.links: list[int] = []
        self.titles: list[bool] = []
        self.open: list[tuple[str, int, str]] = []  # element, its first block, kind
        self.opened: Counter[str] = Counter()  # of these, how many of each name
        self.ranges: list[tuple[str, int, int]] = []  # kind, first block, end
        self.depth = {"silent": 0, "content": 0, "link": 0, "title": 0}
        self.parts: list[str] = []
        self.linked = 0
        self.started: Counter[str] = Counter()
        self.unclosed: set[tuple[str, int]] = set()
        self.hiding: list[str] = []  # open elements that the next block closes

    def feed(self, data: str) -> None:
        if _closable.search(data) or len(_link_starts.findall(data)) != len(_link_ends.findall(data)):
            ends = _Ends()
            ends.feed(data)
            ends.close()
            self.unclosed = ends.unclosed
        super().feed(data)

    def close(self) -> None:
        super().close()
        self.end_block()
        while self.open:
            self._leave(*self.open.pop())

    def end_block(self) -> None:
        text = _space.sub(" ", "".join(self.parts)).strip()
        if text:
            self.texts.append(text)
            self.links.append(self.linked)
            self.titles.append(self.depth["title"] > 0)
            if self.titles[-1] and len(text) < SHORT and COMMENT_TITLES.fullmatch(text):
                self._comments_from(len(self.texts) - 1)
        self.parts, self.linked = [], 0

    def _comments_from(self, block: int) -> None:
        """A heading says that comments follow: to the end of the element around it."""
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] not in TITLE_TAGS and self.open[k][0] in BLOCK_TAGS and self.open[k][0] != "header"), None)
        if at is None:
            return
        tag, first, kind = self.open[at]
        # the element's own kind ends here, and what follows in it is comments
        self.open[at] = (tag, first, f"{kind},comments@{block}")

    def _leave(self, tag: str, first: int, kind: str) -> None:
        end = len(self.texts)
        self.opened[tag] -= 1
        own, _, mark = kind.partition(",")
        if mark and end > (at := int(mark.split("@")[1].partition(",")[0])):
            self.ranges.append(("comments", at, end))
        if own and end > first:
            self.ranges.append((own, first, end))
        d = self.depth
        d["silent"] -= tag in SILENT_TAGS
        d["content"] -= own == "content"
        d["link"] -= tag == "a"
        d["title"] -= tag in TITLE_TAGS

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """content, or how sure it is that the element is furniture: comments, tag, named; or nothing."""
        names = [n for name, value in attrs if name in ("class", "id") and value for n in value.split() if not OTHER_NAMES.match(n)]
        if tag not in ("body", "html") and any(COMMENT_NAMES.search(n) for n in names):
            return "comments"
        if tag in CONTENT_TAGS:
            return "content"
        if tag in FURNITURE_TAGS and not (tag == "header" and self.depth["content"]):  # a header of an article holds its title
            return "named" if tag in ("form", "header") else "tag"
        if any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs):
            return "tag"
        if tag not in ("body", "html", "header") and any(FURNITURE_NAMES.search(n) for n in names) or any(name == "role" and (value or "").lower() in FURNITURE_ROLES for name, value in attrs):
            return "named"
        return ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
            self._close_unclosed(tag)
        if tag in VOID_TAGS:
            return
        if tag in ("p", "li", "tr", "td", "th", "dd", "dt", "option") and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)
        kind = self._kind(tag, attrs) if attrs or tag in CONTENT_TAGS or tag in FURNITURE_TAGS else ""
        if tag == "head" or (tag in CLOSABLE_TAGS and (tag, self.started[tag]) in self.unclosed):
            self.hiding.append(tag)
        self.started[tag] += 1
        self.open.append((tag, len(self.texts), kind))
        self.opened[tag] += 1
        d = self.depth
        d["silent"] += tag in SILENT_TAGS
        d["content"] += kind == "content"
        d["link"] += tag == "a"
        d["title"] += tag in TITLE_TAGS

    def _close_unclosed(self, tag: str) -> None:
        """An open head ends where a block begins, and so does an element whose end tag is left out."""
        while self.hiding and tag not in HELD_TAGS:
            name = self.hiding.pop()
            if self.opened[name]:
                self.handle_endtag(name)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
        while self.opened[tag]:
            element = self.open.pop()
            self._leave(*element)
            if element[0] == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.depth["silent"]:
            return
        self.parts.append(data)
        if self.depth["link"]:
            self.linked += len(data.strip())

    def places(self) -> tuple[list[bool], list[bool]]:
        """Of each block, whether it is furniture and whether it is in a content element."""
        n = len(self.texts)
        upto = [0]
        for text, linked in zip(self.texts, self.links, strict=True):
            upto.append(upto[-1] + max(0, len(text) - linked))
        sure = _covered([(a, b) for kind, a, b in self.ranges if kind in ("tag", "comments")], n)
        articles = [(a, b) for kind, a, b in self.ranges if kind == "content" and not all(sure[a:b])]
        first, last = min((a for a, _ in articles), default=0), max((b for _, b in articles), default=0)

        def pardoned(a: int, b: int) -> bool:
            share = (upto[b] - upto[a]) / max(1, upto[-1])
            return share > MOST or (bool(articles) and a <= first and last <= b and share >= WITH_ARTICLES)

        named = _covered([(a, b) for kind, a, b in self.ranges if kind == "named" and not pardoned(a, b)], n)
        return [x or y for x, y in zip(sure, named, strict=True)], _covered(articles, n)


def _covered(ranges: list[tuple[int, int]], n: int) -> list[bool]:
    """Which of n places lie in one of the ranges."""
    steps = [0] * (n + 1)
    for a, b in ranges:
        steps[a] += 1
        steps[b] -= 1
    return [k > 0 for k in accumulate(steps[:n])]


def _stop_share(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _word.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def classify(text: str, linked: int, furniture: bool = False, inside: bool | None = None, fits: bool = True) -> str:
    """The first pass. inside: whether the block is in the page's content element; None if the page has none. fits: whether stop words tell anything."""
    if furniture or linked > MAX_LINKS * len(text) and not inside or "©" in text and len(text) < LONG and not inside:
        return BAD
    size = len(text)
    if fits:
        stop, words = _stop_share(text)
        stops = stop / words if words else 0.0
    else:
        size += 2 * len(_dense.findall(text))
        stops = STOP_HIGH if _ended.search(text) else 0.0
    if inside and linked > LISTED * len(text) and stops < STOP_HIGH:
        return BAD
    if size < SHORT:
        return BRIEF
    if stops >= STOP_HIGH and size > LONG and inside is not False:
        return GOOD
    return NEAR if stops >= STOP_LOW or inside else BAD


def _decided(labels: list[str], parts: list[bool]) -> list[str | None]:
    """Of each block the nearest decided label before it in its part of the page."""
    last: dict[bool, str] = {}
    found = []
    for label, part in zip(labels, parts, strict=True):
        found.append(last.get(part))
        if label in (GOOD, BAD):
            last[part] = label
    return found


def settle(labels: list[str], inside: list[bool]) -> list[bool]:
    """The second pass: which blocks are good, when near-good and short ones follow the nearest decided ones of their part.

    Within content an undecided block is bad only between bad ones. Elsewhere a short block needs good neighbours on both
    sides and a near-good one needs one, and the page's ends count as bad.
    """
    before = _decided(labels, inside)
    after = _decided(labels[::-1], inside[::-1])[::-1]

    def good(label: str, content: bool, b: str | None, a: str | None) -> bool:
        if label in (GOOD, BAD):
            return label == GOOD
        if content:
            return not b == a == BAD
        return b == a == GOOD or (label == NEAR and GOOD in (b, a))

    return [good(*x) for x in zip(labels, inside, before, after, strict=True)]


def labelled(html: str) -> list[tuple[str, str, bool, bool]]:
    """Text, first label, whether within content, and whether good in the end, of each block of a page."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    texts, links, titles = parser.texts, parser.links, parser.titles
    furniture, inside = parser.places()
    content = any(c and not f for f, c in zip(furniture, inside, strict=True))
    plain = [_stop_share(t) for t, k, f in zip(texts, links, furniture, strict=True) if not f and k <= MAX_LINKS * len(t) and len(t) >= SHORT]
    fits = not plain or sum(s for s, _ in plain) >= STOP_FITS * sum(w for _, w in plain)
    labels = [classify(*block, inside=c if content else None, fits=fits) for *block, c in zip(texts, links, furniture, inside, strict=True)]
    for i in range(len(labels) - 2, -1, -1):
        if titles[i] and labels[i] == BRIEF and labels[i + 1] in (GOOD, NEAR):
            labels[i] = labels[i + 1]
    # furniture within an article is no neighbour of its text
    inside = [content and c and not f for f, c in zip(furniture, inside, strict=True)]
    return list(zip(texts, labels, inside, settle(labels, inside), strict=True))


def main_text(html: str) -> str:
    """The main text of a page: its good blocks, joined by an empty line."""
    return "\n\n".join(text for text, _, _, good in labelled(html) if good)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            # a lone surrogate of a character reference has no UTF-8
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
