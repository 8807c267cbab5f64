"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides the clear ones by stop-word density, length and
link density: long blocks with many stop words are good, link-dense ones without them and runs of links are bad, and so
is page furniture (menus, footers, forms, adverts, comments ...).  What is short, or neither, stays ambiguous and, in the
second pass, takes the label of the nearest decided blocks: both sides' if they agree, else the nearer one's.  Where a
page marks its article (``article`` or ``main``), blocks outside it are bad; inside it, a block has its neighbours among
the article's own blocks, furniture aside, and the article's two ends count as good ones, as do ties.

Furniture is known by its element, by being hidden, or by a word of its classes, id or role that stands first or last in
a name (``site-footer``, but not ``has-sidebar``, ``tag-social`` or ``search-off``).  Where such names would hide every
article of a page, they hide neither articles nor what an article stands in.

Cases: a null or empty page, or one of markup alone, has the empty text; broken markup (unclosed tags, comments
or quotes) is read as far as it goes; repeated rows give repeated rows; whole pages are read, however long.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Common function words of the languages that the rules know.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can could for from had has have he her his if in into is it its more no not of on
    one or other our out said she so some than that the their them then there these they this to up was we were what when which who will with would you
    aber als am an auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch
    nur oder sich sie sind so über um und uns von vor war was wie wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont
    sur un une vous
    al como con cuando de del desde donde el ella en entre era es esta este fue ha hasta la las le lo los más me muy no nos o para pero por que se ser si
    sin sobre son su sus también un una y ya
    """.split()
)

# Words of class, id and role attributes that mark page furniture.
FURNITURE = frozenset(
    """
    ad ads adsense advert advertisement advertising adverts alert banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie
    cookies copyright dialog disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices
    overlay pager pagination popup promo promotion promotions recommended related replies reply respond search share sharebar sharing sidebar
    signup social sponsor sponsored subscribe subscription toolbar widget widgets
    """.split()
)
# Those of them that name furniture in an id too, and in longer names.
PLAIN_FURNITURE = frozenset(
    """
    ads adsense advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
    disqus footer gdpr login masthead menu modal nav navbar navigation newsletter pager pagination popup respond sharebar sidebar signup sponsor
    sponsored subscribe subscription toolbar widget widgets
    """.split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements by their part in a page.
DROPPED = frozenset("nav footer aside form head title button select option textarea label input iframe object embed canvas video audio noscript template svg math dialog menu".split())
# Words that make a name one of a topic, a layout or a state instead.
TOPIC = frozenset("tag tags category cat topic format type status is in".split())
LAYOUT = frozenset("has with without no not layout".split())
STATES = frozenset("off none no hidden disabled closed inactive free less".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
OUTER = frozenset("html body article main".split())

# Attributes end at the tag's own or the next tag's bracket, and no part of them is read twice, so that broken markup takes no
# longer than other markup.
_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^'"<>])*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe)\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})(?:>|(?=<)|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
ARTICLE = re.compile(r"<(?:article|main)\b", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")

#: Lengths in characters and densities as shares, after which a block counts as clear.
SHORT, LONG, MANY_STOPS, SOME_STOPS, MANY_LINKS, LINK_RUN = 70, 200, 0.30, 0.15, 0.33, 3


@dataclass
class Block:
    text: str
    links: int
    furniture: bool
    article: int
    label: str = ""
    doubt: int = 0  # number of the element around it whose name may be one of furniture or of a subject


def _named(value: str, is_id: bool) -> int:
    """2 if a class, id or role has a furniture word as one of its names, or first or last in one; 1 if that may be a subject; else 0."""
    level = 0
    for name in value.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if words and not FURNITURE.isdisjoint((words[0], words[-1])) and words[-1] not in STATES and words[0] not in TOPIC and LAYOUT.isdisjoint(words):
            plain = not PLAIN_FURNITURE.isdisjoint((words[0], words[-1]))
            level = max(level, 2 if plain or not is_id and len(words) < 3 else 1)
    return level


def _furniture(tag: str, attrs: str, in_article: bool) -> int:
    """3 for furniture by element or hidden, 2 for that by name, 1 where densities have to decide whether a name says so, else 0.

    A heading's id is the name of its section's subject.
    """
    if tag in DROPPED or tag == "header" and not in_article:
        return 3
    if not attrs or tag in ("html", "body"):
        return 0
    given: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attrs):
        given.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or UNSHOWN.search(given.get("style", "")):
        return 3
    if tag == "main":
        return 0
    level = max((_named(given[x], x == "id") for x in ("class", "id", "role") if x in given and not (x == "id" and tag in HEADINGS)), default=0)
    return level if in_article else 2 * (level > 0)


class _Open:
    """The open elements of a page, with the places of each name, of block elements, and of those that end no other."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []  # tag, inside furniture (and how known), number of the article it is in
        self.places: dict[str, list[int]] = defaultdict(list)
        self.outlines: list[int] = []  # not inline
        self.walls: list[int] = []  # neither inline nor closing themselves

    def push(self, tag: str, furniture: int, article: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, furniture, article))
        self.places[tag].append(at)
        if tag not in INLINE:
            self.outlines.append(at)
            if tag not in CLOSES_ITSELF:
                self.walls.append(at)

    def cut(self, at: int) -> list[str]:
        """Close all from a place on; their names."""
        names = [x[0] for x in self.stack[at:]]
        del self.stack[at:]
        for name in names:
            self.places[name].pop()
        for places in (self.outlines, self.walls):
            while places and places[-1] >= at:
                places.pop()
        return names

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def ended_by(self, tag: str) -> int:
        """The place of the element that an end tag closes; an inline one closes nothing beyond its block.  -1 if none."""
        at = self.last(tag)
        return -1 if tag in INLINE and self.outlines and at < self.outlines[-1] else at

    def ended_before(self, tag: str) -> int:
        """The place of the paragraph, or list item and the like, that the start of a block closes; -1 if none."""
        at = max(self.last("p"), self.last(tag) if tag in CLOSES_ITSELF else -1)
        return -1 if self.walls and at < self.walls[-1] else at


def blocks(page: str, names_hide_articles: bool = True) -> list[Block]:
    """The blocks of a page in order, each with its text, the characters in links, and where it stands."""
    found: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    links = articles = in_link = 0
    furniture, article = 0, 0
    doubts = 0

    def flush() -> None:
        nonlocal links
        if parts:
            if text := " ".join("".join(parts).split()):
                found.append(Block(text, links, furniture > 1, article, doubt=doubts if furniture == 1 else 0))
            parts.clear()
            links = 0

    def close(at: int) -> None:
        nonlocal furniture, article, in_link
        if opened.outlines and opened.outlines[-1] >= at or furniture != (opened.stack[at - 1][1] if at else 0):
            flush()
        in_link = max(0, in_link - opened.cut(at).count("a"))
        furniture, article = opened.stack[-1][1:] if opened.stack else (0, 0)

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            parts.append(plain)
            if in_link:
                links += len(plain.strip())

    at = 0
    for token in TOKEN.finditer(page):
        text(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if token["end"]:
            if (place := opened.ended_by(tag)) >= 0:
                close(place)
            elif not inline:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if not inline:
            if (place := opened.ended_before(tag)) >= 0:
                close(place)
            flush()
        if tag in VOID:
            continue
        inside = max(furniture, _furniture(tag, token["attrs"], article > 0))
        if inside in (1, 2) and tag in ("article", "main") and not article and not names_hide_articles:
            inside = 0
        if inside != furniture:
            flush()
            doubts += inside == 1
        if tag in ("article", "main") and not inside and not article:
            articles += 1
            opened.push(tag, inside, articles)
        elif not token["attrs"].endswith("/") or not inline:
            opened.push(tag, inside, article)
            in_link += tag == "a"
        furniture, article = opened.stack[-1][1:] if opened.stack else (0, 0)
    text(page[at:])
    flush()
    return found


def stop_density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(found: list[Block]) -> None:
    """Label the clear blocks ``good`` or ``bad`` and leave ``""`` on the others."""
    marked = any(b.article and not b.furniture for b in found)
    prose = {b.doubt for b in found if b.doubt and len(b.text) >= SHORT and b.links <= MANY_LINKS * len(b.text) and stop_density(b.text) >= MANY_STOPS}
    for b in found:
        size = len(b.text)
        link_dense = b.links > MANY_LINKS * size
        if b.furniture or marked and not b.article or b.doubt and b.doubt not in prose:
            b.label = "bad"
        elif size < SHORT:
            b.label = "bad" if b.links and not b.article else ""
        elif link_dense:  # teasers and inline lists of links; linked prose of an article stays open
            b.label = "bad" if not b.article or stop_density(b.text) < SOME_STOPS else ""
        elif size >= (SHORT if b.article else LONG) and stop_density(b.text) >= (SOME_STOPS if b.article else MANY_STOPS):
            b.label = "good"
    run: list[Block] = []
    for b in [*found, Block("", 0, False, 0)]:  # lists of links inside an article
        if b.article and not b.furniture and b.label != "good" and b.links > 0.9 * len(b.text):
            run.append(b)
        else:
            if len(run) >= LINK_RUN:
                for x in run:
                    x.label = "bad"
            run = []


def second_pass(found: list[Block]) -> None:
    """Give each undecided block the label of its nearest decided neighbours."""
    whole, by_article = list(range(len(found))), defaultdict(list)
    for i, b in enumerate(found):
        if b.article and not b.furniture:
            by_article[b.article].append(i)
    given = _inherited(found, whole, "") | {i: x for own in by_article.values() for i, x in _inherited(found, own, "good").items()}
    for i, label in given.items():
        found[i].label = label


def _inherited(found: list[Block], places: list[int], ends: str) -> dict[int, str]:
    """Labels for the undecided blocks among ``places``, whose two ends have the label ``ends``; ties and no labels at all are good."""
    labels = [ends, *(found[i].label for i in places), ends]
    left, right = [0] * len(labels), [len(labels) - 1] * len(labels)
    for i in range(1, len(labels)):
        left[i] = i - 1 if labels[i - 1] else left[i - 1]
    for i in range(len(labels) - 2, -1, -1):
        right[i] = i + 1 if labels[i + 1] else right[i + 1]
    given = {}
    for i, place in enumerate(places, 1):
        if not labels[i]:
            a, b, nearer = labels[left[i]], labels[right[i]], (i - left[i]) - (right[i] - i)
            if a == b or not a or not b:
                given[place] = a or b or "good"
            elif nearer:
                given[place] = a if nearer < 0 else b
            else:
                given[place] = "good" if ends or len(found[place].text) >= SHORT else "bad"
    return given


def main_text(page: str | None) -> tuple[str, int, int]:
    """The text of the good blocks in page order, how many there are, and how many blocks the page has."""
    found = blocks(page or "")
    if page and not any(b.article and not b.furniture for b in found) and ARTICLE.search(page):
        found = blocks(page, names_hide_articles=False)
    first_pass(found)
    second_pass(found)
    good = [b.text for b in found if b.label == "good"]
    return " ".join(good), len(good), len(found)


def extract_text(pages: DataFrame, key: str = "page_id", source: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key, *carry, text, n_chars, n_kept_blocks, n_blocks`` of every page.  One pass, no shuffle."""
    names = [key, *carry]
    schema = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [main_text(x.as_py()) for x in batch.column(len(names))]
            columns = [
                *batch.columns[: len(names)],
                pa.array([x[0] for x in done], pa.string()),
                pa.array([len(x[0]) for x in done], pa.int64()),
                pa.array([x[1] for x in done], pa.int64()),
                pa.array([x[2] for x in done], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{i}" for i in range(len(names))), "text", "n_chars", "n_kept_blocks", "n_blocks"])

    chosen = pages.select(*(pages[c].alias(f"c{i}") for i, c in enumerate(names)), pages[source].alias("page"))
    out = chosen.mapInArrow(run, f"{schema}, text string, n_chars bigint, n_kept_blocks bigint, n_blocks bigint")
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(names)})
