"""Main text of web pages by consensus host paths.

Every page's containers are scored; the page votes for the generalised
tag-class path of its best one. Votes are counted per host in Spark, and every
page is extracted again with the winning path of its host. Pages that do not
have that path fall back to their own best container.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hosts import host_of
from .scratch import Scratch

# Roles of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form button select textarea option iframe object svg canvas dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("html body main article section div td center".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div section article body main td blockquote".split())
# Words in names of classes, ids and roles.
#: What an element holds that is no part of the article, wherever it stands.
APART = frozenset(
    "ad ads adbox advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login "
    "breadcrumb breadcrumbs sidebar comment comments respond replies disqus pagination pager share sharing "
    "anzeige anzeigen werbung kommentar kommentare publicite commentaire commentaires publicidad anuncio anuncios comentario comentarios".split()
)
#: What an element is on its page; parts of an article may have names with these words, too.
PLACE = frozenset("nav navbar navigation menu aside widget footer header masthead topbar toolbar notice notices alert hinweis hinweise aviso avis social related recommended skip tags complementary contentinfo".split())
#: Words of layout, which say nothing about what an element holds.
LAYOUT = frozenset(
    "active area bar block bottom box btn button buttons cell center close col column container css desktop dialog fixed floating form global grid group head holder "
    "icon icons inner item items js large layer layout left line link links list main message mobile module outer overview page panel primary region right root row secondary "
    "site slot small sticky tab tabs thread tool tools top unit view visible wrap wrapper zone".split()
)
#: Words of the article itself: beside them a place is one within the article, what is apart stays apart.
OF_ARTICLE = frozenset("article blog body content entry feed news post posts section story text title".split())
#: Words beside which the others of a class name say what a page has, not what an element is.
ABOUT_PAGE = frozenset("has with no without not hide show".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
# A quote opens a value only after an equals sign; one that is never closed is a character like others.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*))?)?""")
_TAG_END = re.compile(r"[\s/]*>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_WORDS = re.compile(r"[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+")
_DIGITS = re.compile(r"\d+")
_SPACES = re.compile(r"\s+")
#: Share of a page's wanted text that the container covers from which an article or main around it is looked for.
COVERAGE = 0.6
#: Share that the main container covers where there is neither: text beside it is dropped.
WHOLE = 0.98
#: Share under which a page does not follow the path its host voted for.
LITTLE = 0.05


@dataclass
class Block:
    """A run of text between block borders, and the innermost container around it (-1: none)."""

    text: str
    inside: int
    wanted: bool
    linked: int


@dataclass
class Page:
    """Containers by their position in the page; an outer one comes before those inside it."""

    steps: list[str] = field(default_factory=list)  #: generalised elements from the outer container to each
    tags: list[str] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def path(self, i: int) -> str:
        out = []
        while i >= 0:
            out.append(self.steps[i])
            i = self.outer[i]
        return "/".join(reversed(out))

    def at_path(self, path: str) -> list[bool]:
        """Which containers have this path or lie inside one that has."""
        wanted = path.split("/")
        on_way, inside = [], []
        for step, outer, depth in zip(self.steps, self.outer, self.depth):
            ok = depth < len(wanted) and step == wanted[depth] and (outer < 0 or on_way[outer])
            on_way.append(ok)
            inside.append((ok and depth == len(wanted) - 1) or (outer >= 0 and inside[outer]))
        return inside


@lru_cache(maxsize=4096)
def name_says(name: str) -> int:
    """2 if a name of a class, id or role is one of what is no article, 1 if it might be, 0 if not.

    It is one if all its words are; words of layout may stand among them, and
    words of the article beside those that are apart from it. One such word
    among others (notice-board, social-history) only might be one.
    """
    words = {w.lower() for w in _WORDS.findall(name)}
    marks = words & (APART | PLACE)
    if not marks or words & ABOUT_PAGE:
        return 0
    rest = words - marks - LAYOUT
    return 2 if not rest or (rest <= OF_ARTICLE and marks <= APART) else 1


def _judged(tag: str, attributes: list[tuple[str, str]], by_name: bool) -> tuple[int, str]:
    """How much an element looks like no part of any article (0 to 2), and its generalised classes."""
    classes, marked = "", 2 if tag in DROPPED else 0
    for name, value in attributes:
        if name == "class":
            classes = "".join("." + _DIGITS.sub("#", c) for c in sorted(set(value.split())))
        if by_name and name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            marked = max(marked, *(name_says(x) for x in value.split()), 0)
    return marked, classes


def _tag_at(source: str, at: int, lenient: bool) -> tuple[str, bool, list[tuple[str, str]], int] | None:
    """(name, closing, attributes, end) of the tag whose ``<`` is at ``at``; None if none ends there before the page does."""
    closing = source.startswith("/", at + 1)
    m = _NAME.match(source, at + 1 + closing)
    name, at, attributes = m[0].lower(), m.end(), []
    if source.startswith(">", at):
        return name, closing, attributes, at + 1
    if lenient:
        return name, closing, attributes, source.find(">", at) + 1
    while not (end := _TAG_END.match(source, at)):
        m = _ATTRIBUTE.match(source, at)
        if m is None:
            return None
        attributes.append((m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")))
        at = m.end()
    return name, closing, attributes, end.end()


def tokenise(source: str) -> Iterator[tuple[str, bool, list[tuple[str, str]], str]]:
    """(tag, closing, attributes, text): text where tag is ''.

    Comments, declarations and the inside of raw elements are left out. A
    ``<`` that opens nothing is text. The time is linear in the page: a tag
    that quotes keep open up to the page's end ends at its first ``>``, as do
    all tags after it.
    """
    at, size, last, lenient = 0, len(source), source.rfind(">"), False
    while at < size:
        start = source.find("<", at)
        if start < 0 or start > last:  # nothing ends any more; a comment takes the rest
            comment = source.find("<!--", at)
            yield "", False, [], source[at : comment if comment >= 0 else size]
            return
        if start > at:
            yield "", False, [], source[at:start]
        after = source[start + 1 : start + 3]
        if after[:1] == "!" and source.startswith("--", start + 2):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
        elif after[:1] in ("!", "?"):
            at = source.find(">", start) + 1
        elif (after[1:] if after[:1] == "/" else after)[:1].isascii() and (after[1:] if after[:1] == "/" else after)[:1].isalpha():
            found = _tag_at(source, start, lenient)
            if found is None:
                lenient = True
                found = _tag_at(source, start, lenient)
            tag, closing, attributes, at = found
            yield tag, closing, attributes, ""
            if tag in RAW and not closing and not source.endswith("/>", start, at):
                end = _RAW_END[tag].search(source, at)
                if end is None:
                    return
                at = end.start()
        else:
            yield "", False, [], "<"
            at = start + 1


def parse(source: str, by_name: bool = True) -> Page:
    """Containers and text blocks of a page; unclosed and misnested tags are allowed.

    Elements that are no part of an article are known by their tag and, with
    ``by_name``, by their class, id or role; where a name only might be one of
    these, blocks with half their text in links or more are left out.
    """
    page = Page()
    # open elements: (tag, how much they or those around look unwanted, container index or -1, step of the path)
    stack: list[tuple[str, int, int, str]] = []
    count: Counter[str] = Counter()
    around = -1
    texts: list[str] = []
    linked = 0
    dropped = 0

    def end_block() -> None:
        nonlocal linked
        if texts:
            text = _SPACES.sub(" ", entities.unescape("".join(texts))).strip()
            if text:
                page.blocks.append(Block(text, around, dropped < 1 or (dropped < 2 and 2 * linked < len(text)), linked))
            texts.clear()
        linked = 0

    def close_to(depth: int) -> None:
        nonlocal dropped, around
        while len(stack) > depth:
            tag, _, container, _ = stack.pop()
            count[tag] -= 1
            if container >= 0:
                around = page.outer[container]
        dropped = stack[-1][1] if stack else 0

    def open_like(names, stop=frozenset()) -> int:
        for i in range(len(stack) - 1, -1, -1) if any(count[n] for n in names) else ():
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                break
        return -1

    for tag, closing, attributes, shown in tokenise(source):
        if not tag:
            texts.append(shown)
            if count["a"]:
                linked += len(shown)
            continue
        if tag not in INLINE:
            if tag == "br":
                texts.append(" ")
                continue
            end_block()
        if closing:
            i = open_like((tag,), SCOPES if tag in ("li", "p") or tag in INLINE else frozenset(("body", "html")) - {tag})
            if i >= 0:
                close_to(i)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and (i := open_like(("p",), SCOPES)) >= 0:
            close_to(i)
        if tag in CLOSED_BY_LIKE and (i := open_like(CLOSED_BY_LIKE[tag], frozenset(("ul", "ol", "dl", "table")))) >= 0:
            close_to(i)
        marked, classes = _judged(tag, attributes, by_name)
        step = tag + classes
        container = -1
        if tag in CONTAINERS:
            container = len(page.steps)
            between = [step]
            for outer_tag, _, i, outer_step in reversed(stack):
                if i >= 0:
                    break
                if outer_tag not in INLINE:
                    between.append(outer_step)
            page.steps.append(">".join(reversed(between)))
            page.tags.append(tag)
            page.outer.append(around)
            page.depth.append(page.depth[around] + 1 if around >= 0 else 0)
            around = container
        dropped = max(dropped, marked)
        stack.append((tag, dropped, container, step))
        count[tag] += 1
    end_block()
    return page


def _score(block: Block) -> int:
    """The length of a block's text outside links, 0 of an unwanted one."""
    return max(0, len(block.text) - block.linked) if block.wanted else 0


def best_container(page: Page) -> int:
    """The container that holds the main text, -1 if there is none.

    The score of a container is its wanted text outside links. From the deepest
    one with a share of COVERAGE of the page's, the first on ties, it goes
    outwards: to the outermost article around it, else to the outermost main,
    else to the first with a share of WHOLE.
    """
    scores = [0] * len(page.steps)
    total = 0
    for block in page.blocks:
        score = _score(block)
        total += score
        if block.inside >= 0:
            scores[block.inside] += score
    for i in range(len(scores) - 1, -1, -1):
        if page.outer[i] >= 0:
            scores[page.outer[i]] += scores[i]
    fit = [i for i, s in enumerate(scores) if s and s >= COVERAGE * total]
    if not fit:
        return -1
    best = max(fit, key=lambda i: (page.depth[i], scores[i], -i))
    named, i = {}, best
    while i >= 0:
        named[page.tags[i]] = i
        i = page.outer[i]
    if "article" in named or "main" in named:
        return named.get("article", named.get("main", -1))
    while best >= 0 and scores[best] < WHOLE * total:
        best = page.outer[best]
    return best


def extract(page: Page, path: str | None) -> str:
    """Wanted blocks inside the containers with this path, else inside the best container, joined by one space.

    A path with less than a share of LITTLE of the page's text outside links is not followed.
    """
    for chosen in (path, None):
        if chosen is None:
            best = best_container(page)
            if best < 0:
                return " ".join(b.text for b in page.blocks if b.wanted)
            chosen = page.path(best)
        inside = page.at_path(chosen)
        blocks = [b for b in page.blocks if b.wanted and b.inside >= 0 and inside[b.inside]]
        if blocks and (path is None or sum(map(_score, blocks)) >= LITTLE * sum(map(_score, page.blocks))):
            break
        path = None
    return " ".join(b.text for b in blocks)


def main_text(source: str, path: str | None) -> str:
    """``extract`` of a page; one whose every text stands under an unwanted name is read by tags alone."""
    return extract(parse(source), path) or extract(parse(source, by_name=False), path)


def extract_main_text(pages: DataFrame, scratch: Scratch, broadcast_hosts: int = 50_000) -> DataFrame:
    """A row per page: page_id, url, text, n_chars.

    Null or empty html gives ''. A null url is a host of its own; repeated rows
    stay. Ties between paths of a host go to the path that sorts first.

    Votes leave each task as one row per page and are combined before the
    shuffle, so a host with a third of all pages is a few counts. The table of
    winners has a row per host; it is broadcast while it has at most
    ``broadcast_hosts`` rows and joined by host beyond, where AQE splits a hot one.
    """
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for source in batch.column(1):
                page = parse(source.as_py() or "")
                best = best_container(page)
                paths.append(page.path(best) if best >= 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["host", "path"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source.as_py() or "", path.as_py()) for source, path in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    located = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    votes = located.select("host", "html").mapInArrow(vote, "host string, path string")
    votes = votes.filter("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "path"))
    winners = scratch.table(votes.withColumn("place", first).filter("place = 1").select("host", "path"), "winners")
    if winners.count() <= broadcast_hosts:
        winners = F.broadcast(winners)
    kind = pages.schema["page_id"].dataType.simpleString()
    out = located.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(pick, f"page_id {kind}, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
