"""Main text of web pages by two-pass block rules.

Pass one looks at each block alone: blocks inside boilerplate elements or with many links are bad; long blocks with
many function words are good, those in between near-good; brief blocks and blocks of any length with few function words
stay undecided. Containers whose class or id names speak against them make their blocks bad, unless they hold most of
the page's dense text. Pass two decides the undecided: a block inherits the label of its nearest decided neighbours, a
near-good block stands unless bad blocks enclose it, and a short heading follows the text below it. Where a page marks
its article and most of the text that the first pass takes for good or near-good stands there, only blocks of the
article take part, and its borders decide nothing.

Scripts without blanks between words are measured by function characters, and their characters count as three columns.
Elements end where HTML implies their ends: with their parent, at the next item, cell, row or block, and a head where
the body's first element begins. A page that leaves another unseen element open to its end is read again, with elements
of that name ending at the next block; a boilerplate element that only the page's end closes ends at its first block
that reads like text.

Defined cases: null or empty html gives the empty text and 0 characters; repeated rows are extracted alike; broken
markup is read as far as it goes. No block is cut and no page is skipped, however long.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField

from millrace.llm.common import fresh, table, with_columns

# Elements of HTML by their role.
UNSEEN = frozenset("script style noscript template svg math head title iframe object canvas select datalist option textarea button audio video".split())
IN_HEAD = frozenset("base basefont bgsound html link meta noframes noscript script style template title head img".split())
ASIDE = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation complementary contentinfo search form dialog alertdialog menu menubar toolbar tablist".split())
BREAKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BREAKS - frozenset("body caption dd dt html legend li tbody td tfoot th thead tr".split())
BOUND = frozenset({"script", "style"})  # without an end tag these go on to the end of the page, as in browsers
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th caption table".split())
TABLE = frozenset("table tbody td tfoot th thead tr caption".split())

# Which open elements end where another begins, and inside what. One list for each element.
_ROWS, _LISTS = frozenset("tr td th".split()), frozenset("ul ol menu".split())
ENDED_BY = {
    "li": [(frozenset({"li"}), _LISTS)],
    "dt": [(frozenset({"dt", "dd"}), frozenset({"dl"}))],
    "dd": [(frozenset({"dt", "dd"}), frozenset({"dl"}))],
    "option": [(frozenset({"option"}), frozenset({"select", "datalist"}))],
    "td": [(frozenset({"td", "th"}), frozenset({"tr", "table"}))],
    "th": [(frozenset({"td", "th"}), frozenset({"tr", "table"}))],
    "tr": [(frozenset({"tr"}), frozenset({"table"}))],
    "tbody": [(frozenset("thead tbody tfoot caption".split()), frozenset({"table"}))],
    "tfoot": [(frozenset("thead tbody tfoot caption".split()), frozenset({"table"}))],
    "body": [(frozenset({"head"}), frozenset())],
}

# Words in class and id attributes that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup privacy promo promotion recommended related replies respond "
    "search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
STRONG = frozenset("ad ads advert adverts advertisement comment comments cookie cookies consent disqus footer nav navbar navigation newsletter replies respond sidebar sidenav".split())
COMMENTS = frozenset("comment comments discussion disqus replies respond".split())
PAGE_MARKS = frozenset({"header", "masthead"})  # these mark boilerplate outside an article only

# Frequent function words of several European languages.
FUNCTION_WORDS = frozenset(
    (
        "a about after all also an and are as at be been but by can could did do for from had has have he her him his how i if in into is it its like made may me more most my no not now of on one only or other our out over she so some such than that the their them then there these they this through to under up us very was we were what when where which while who will with would you your "
        "au aux avec ce ces comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur une un vous y "
        "aber als am auch auf aus bei bin bis da das dass dem den der die durch ein eine einem einen einer es für hat ich im ist man mit nach nicht noch nur oder sein sich sie sind so und um uns unter vom von vor war was werden wie wird zu zum zur über "
        "al algo con como cuando del desde donde el ella ellos en entre era es esta este ha hay la las lo los más muy ni nos o para pero por porque que se sin sobre su sus también te tiene todo un una y ya yo "
        "che di della il gli non per sono una uno dos em não os uma com de het een van op te dat niet aan och att det som på för av"
    ).split()
)

# Frequent function characters of Chinese; kana do the same for Japanese.
FUNCTION_CHARS = frozenset("的一是不了在人有我他这这個个上们來来到时時大地为為子中你说說生国國年着就那和要她出也得里后自以会會家可下而过過天去能对對小多然于心")

SHORT, LONG = 70, 200  # columns: below SHORT a block is brief, above LONG a dense one is certainly text
FEW, MANY = 0.12, 0.28  # shares of function words
LINKED = 0.33  # share of characters inside links from which a block counts as navigation
AHEAD = 200  # columns between a heading and the text it may belong to


@dataclass(frozen=True)
class State:
    """What the open elements around a place say of it."""

    unseen: bool = False  # isn't shown
    offs: tuple[int, ...] = ()  # numbers of the boilerplate elements it stands in
    mark: int = -1  # number of the innermost container whose names speak against it
    article: int = 0  # number of the article it stands in, 0 for none
    heading: bool = False
    link: bool = False

    @property
    def off(self) -> bool:
        return bool(self.offs)


@dataclass
class Block:
    state: State = State()
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    columns: int = 0
    label: str = ""


@dataclass
class Mark:
    """A container whose class, id or role names something other than the article: evidence, no verdict."""

    outer: int
    strong: bool
    comments: bool = False


PLAIN = State()
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002ffff]")


def wide(text: str) -> int:
    """Characters of scripts that are written without blanks."""
    return len(_WIDE.findall(text))


class _Blocks(HTMLParser):
    """Cuts a page into blocks and notes where each stands, with the ends of elements that HTML lets authors omit."""

    def __init__(self, loose: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.loose = loose  # unseen elements that end at the next block
        self.blocks: list[Block] = []
        self.block = Block()
        self.open: list[tuple[str, State]] = []
        self.count: dict[str, int] = {}  # of open elements by name
        self.marks: list[Mark] = []
        self.articles = 0
        self.left: set[str] = set()  # unseen elements that only the page's end closed
        self.offs = 0  # boilerplate elements so far
        self.unclosed: set[int] = set()  # those that only the page's end closed

    @property
    def state(self) -> State:
        return self.open[-1][1] if self.open else PLAIN

    def end_block(self) -> None:
        if self.block.parts:
            self.blocks.append(self.block)
            self.block = Block()

    def pop(self, to: int, own: str = "") -> None:
        """Close the open elements from number ``to`` on."""
        for tag, state in reversed(self.open[to:]):
            self.count[tag] -= 1
            if own in ("", "body", "html"):
                if tag in UNSEEN and tag != "head" and state.unseen:
                    self.left.add(tag)
                elif tag in ASIDE and state.offs:
                    self.unclosed.add(state.offs[-1])
        del self.open[to:]

    def last(self, tags: frozenset[str], barrier: frozenset[str]) -> int:
        """Number of the innermost open element of these names inside the barrier, or -1."""
        if any(self.count.get(t) for t in tags):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in tags:
                    return i
                if self.open[i][0] in barrier:
                    break
        return -1

    def implied_ends(self, tag: str) -> None:
        """Close what ends where ``tag`` begins."""
        if self.count.get("head") and tag not in IN_HEAD:
            self.end_element("head")
        if tag in BREAKS:
            for name in self.loose:
                if (at := self.last(frozenset({name}), frozenset())) >= 0:
                    self.pop(at, name)
            if tag in ENDS_P and (at := self.last(frozenset({"p"}), CELLS)) >= 0:
                self.pop(at, "p")
        for tags, barrier in ENDED_BY.get(tag, ()):
            if (at := self.last(tags, barrier)) >= 0:
                self.pop(at, tag)

    def end_element(self, tag: str) -> None:
        at = self.last(frozenset({tag}), CELLS - {tag} if tag in BREAKS and tag not in TABLE else frozenset())
        if at < 0:
            return
        if tag not in BREAKS and tag not in UNSEEN and any(t in BREAKS for t, _ in self.open[at + 1 :]):
            self.count[tag] -= 1  # an inline element doesn't end the blocks in it
            del self.open[at]
        else:
            self.pop(at, tag)

    def boilerplate(self, tag: str, names: dict, inside: bool) -> bool:
        """Whether an element is none of the article by what it is."""
        roles = set((names.get("role") or "").lower().split())
        if tag in ASIDE or roles & ROLES or (tag == "header" or "banner" in roles) and not inside:
            return True
        return "hidden" in names or (names.get("aria-hidden") or "").strip().lower() == "true"

    def marked(self, tag: str, names: dict, inside: bool) -> Mark | None:
        if tag in ("html", "body", "main"):
            return None
        named = " ".join(v for k in ("class", "id") if (v := names.get(k)))
        words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower())) if named else set()
        if tag == "form" or words & (MARKS if inside else MARKS | PAGE_MARKS):
            return Mark(self.state.mark, bool(words & STRONG), bool(words & COMMENTS))
        return None

    def set_cdata_mode(self, elem, **options):
        if elem not in self.loose:
            super().set_cdata_mode(elem, **options)

    def handle_starttag(self, tag, attrs):
        self.implied_ends(tag)
        if tag in VOID:
            if tag == "hr":
                self.end_block()
            elif tag == "br" and not self.state.unseen:
                self.add(" ")
            return
        names, state = dict(attrs), self.state
        if tag in ("article", "main") and state.off and not state.unseen:  # an unclosed container ends where the article begins
            at = next(i for i, (_, s) in enumerate(self.open) if s.off)
            if self.open[at][0] not in ("aside", "article", "section", "div"):
                self.pop(at, self.open[at][0])
                state = self.state
        inside = bool(state.article)
        if tag in UNSEEN:
            state = replace(state, unseen=True) if tag not in self.loose or tag != "head" else state
        elif not state.unseen:
            if self.boilerplate(tag, names, inside):
                self.offs += 1
                state = replace(state, offs=(*state.offs, self.offs))
            elif mark := self.marked(tag, names, inside):
                self.marks.append(mark)
                state = replace(state, mark=len(self.marks) - 1)
            if tag in ("article", "main") and not state.off and not inside:
                self.articles += 1
                state = replace(state, article=self.articles)
            if tag in HEADINGS:
                state = replace(state, heading=True)
            if tag == "a":
                state = replace(state, link=True)
            if tag in BREAKS:
                self.end_block()
        self.open.append((tag, state))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in BREAKS:
            self.handle_starttag(tag if tag in VOID else "hr", attrs)

    def handle_endtag(self, tag):
        if tag in BREAKS and not self.state.unseen:
            self.end_block()
        self.end_element(tag)

    def add(self, text: str) -> None:
        if not self.block.parts:
            self.block.state = self.state
        self.block.parts.append(text)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self.end_element("head")
        state = self.state
        if not state.unseen:
            if not self.block.parts and data.isspace():
                return
            self.add(data)
            if state.link:
                self.block.linked += len(data.strip())


def blocks_of(html: str) -> tuple[list[Block], list[Mark]]:
    loose: frozenset[str] = frozenset()
    while True:
        parser = _Blocks(loose)
        parser.feed(html)
        parser.close()
        parser.pop(0)
        left = parser.left - loose - BOUND
        if not left:  # UNSEEN holds a few names, and each turn makes another one loose
            break
        loose |= left
    parser.end_block()
    out = []
    for b in parser.blocks:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            b.columns = len(b.text) + 2 * wide(b.text)
            out.append(b)
    if parser.unclosed:
        close_at_text(out, parser.unclosed)
    return out, parser.marks


def close_at_text(blocks: list[Block], unclosed: set[int]) -> None:
    """Let boilerplate elements that a page never closes end at their first block that reads like text."""
    ended: set[int] = set()
    for b in blocks:
        if open_here := unclosed.intersection(b.state.offs) - ended:
            if b.columns >= SHORT and b.linked <= LINKED * len(b.text) and density(b.text) >= FEW and not set(b.state.offs) - unclosed:
                ended |= open_here
        if ended:
            b.state = replace(b.state, offs=tuple(k for k in b.state.offs if k not in ended))


def density(text: str) -> float:
    """Share of function words; of function characters, twice, in a script without blanks."""
    if 3 * wide(text) > len(text):
        letters = [c for c in text if c.isalpha()]
        return min(1.0, 2 * sum(c in FUNCTION_CHARS or "\u3041" <= c <= "\u309f" or "\u0e00" <= c <= "\u0eff" for c in letters) / len(letters))
    words = text.lower().split()
    return sum(w in FUNCTION_WORDS or w.strip(".,;:!?\"'()[]*#%$&|") in FUNCTION_WORDS for w in words) / len(words)


def first_pass(b: Block) -> str:
    """good, near, bad or short (undecided), from the block alone."""
    if b.state.off:
        return "bad"
    if b.linked > LINKED * len(b.text) and not (b.state.article and b.columns >= SHORT and sentence(b)):  # an article may link a sentence
        return "bad"
    if "©" in b.text and b.columns < LONG and not b.state.article:
        return "bad"
    if b.columns < SHORT:
        return "bad" if b.linked else "short"
    dense = density(b.text)
    if dense >= MANY:
        return "good" if b.columns > LONG else "near"
    return "near" if dense >= FEW else "short"


def weigh_marks(blocks: list[Block], marks: list[Mark]) -> None:
    """Blocks of a container with speaking names are bad, unless it holds the page's text.

    A weak name yields where the container has more dense text than all that is outside it, some of it certainly text
    if the page has such; a strong one only where nothing outside is certainly text, comments only where nothing outside
    so much as reads like a sentence.
    """
    if not marks:
        return
    none = all(b.label != "good" for b in blocks)
    inside, sure, said = ([0] * len(marks) for _ in range(3))
    text = all_sure = all_said = 0
    for b in blocks:
        dense = b.label in ("good", "near")
        size, certain, says = b.columns * dense, b.label == "good", dense or b.label == "short" and sentence(b)
        text, all_sure, all_said = text + size, all_sure + certain, all_said + says
        k = b.state.mark
        while k >= 0:
            inside[k], sure[k], said[k] = inside[k] + size, sure[k] + certain, said[k] + says
            k = marks[k].outer
    holds = [(sure[k] or none and not m.strong) and (said[k] == all_said if m.comments else sure[k] == all_sure if m.strong else 2 * inside[k] > text) for k, m in enumerate(marks)]
    for b in blocks:
        k = b.state.mark
        while k >= 0:
            if not holds[k]:
                b.label = "bad"
            k = marks[k].outer


def sentence(b: Block) -> bool:
    """Whether a block reads like a sentence: closed by a stop, with some function words."""
    return b.text.rstrip("\"')»”*#%$&| ")[-1:] in tuple(".!?…。！？") and density(b.text) >= FEW


def second_pass(blocks: list[Block]) -> None:
    """Decide the undecided and the near-good blocks from their neighbours, in place."""
    # The best that a page has is its text: near-good blocks, else long undecided ones, else what may be a sentence.
    for better in (lambda b: b.label == "near", lambda b: b.label == "short" and b.columns >= SHORT, lambda b: b.label == "short" and (b.state.article or sentence(b))):
        if any(b.label == "good" for b in blocks):
            break
        for b in blocks:
            if better(b):
                b.label = "good"

    def beside(labels: tuple[str, ...], step: int) -> list[int | None]:
        """For each block the number of the nearest of these labels before it (step 1) or behind it (-1)."""
        last, out = None, []
        for i in range(len(blocks))[::step]:
            out.append(last)
            last = i if blocks[i].label in labels else last
        return out[::step]

    label = lambda i: None if i is None else blocks[i].label
    before, behind = beside(("good", "bad"), 1), beside(("good", "bad"), -1)
    nearer = list(zip(beside(("near", "bad"), 1), beside(("near", "bad"), -1), strict=True))
    headings = [0]
    for b in blocks:
        headings.append(headings[-1] + (b.state.heading and b.label != "bad"))
    decided = {}
    for i, b in enumerate(blocks):
        if b.label != "short":
            continue
        found = {label(before[i]), label(behind[i])} - {None}
        if len(found) < 2:
            decided[i] = found.pop() if found else "bad"
            continue
        bad, good = (before[i], behind[i]) if label(before[i]) == "bad" else (behind[i], before[i])
        low, high = min(i, bad), max(i, bad)
        if b.state.heading:
            decided[i] = "bad"  # unless text follows, below
        elif headings[high] - headings[low + 1] > 0:  # the bad block belongs to another section
            decided[i] = "good"
        elif label(nearer[i][bad > i]) == "near":  # a near-good block towards the bad side speaks for text
            decided[i] = "good"
        else:
            far = abs(good - i) - abs(bad - i)
            decided[i] = "good" if far < 0 or far == 0 and (blocks[bad].state.off or sentence(b)) else "bad"  # an element that ends says little
    for i, found in decided.items():
        blocks[i].label = found
    before, behind = beside(("good", "bad"), 1), beside(("good", "bad"), -1)
    for b, x, y in zip(blocks, before, behind, strict=True):
        if b.label == "near":
            b.label = "bad" if label(x) == label(y) == "bad" else "good"
    for i, b in enumerate(blocks):  # a heading belongs to the text just below it
        if b.state.heading and b.label == "bad" and i in decided:
            far = 0
            for c in blocks[i + 1 :]:
                if c.label == "good":
                    b.label = "good"
                if c.label == "good" or (far := far + c.columns) > AHEAD:
                    break


def main_text(html: str | None) -> str:
    """The main text of a page: kept blocks in page order, two line breaks between them."""
    if not html:
        return ""
    blocks, marks = blocks_of(html)
    for b in blocks:
        b.label = first_pass(b)
    weigh_marks(blocks, marks)
    own = [b for b in blocks if b.state.article and not b.state.off]
    text, within = (sum(b.columns for b in x if b.label in ("good", "near")) for x in (blocks, own))
    if own and 2 * within >= text:  # each marked article by itself: what surrounds it says nothing about it
        for k in dict.fromkeys(b.state.article for b in own):
            second_pass([b for b in own if b.state.article == k])
        return "\n\n".join(b.text for b in own if b.label == "good")
    second_pass(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract(df: DataFrame, html: str, names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """``df`` with the main text of its html column and that text's number of code points."""

    def make():
        def step(pages):
            texts = [main_text(x) for x in pages]
            return [texts, [len(x) for x in texts]]

        return step

    return with_columns(df, html, [StructField(names[0], StringType()), StructField(names[1], LongType())], make)


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    names = fresh(pages, "text"), fresh(pages, "n_chars")
    return extract(pages, "html", names).select("page_id", "url", F.col(names[0]).alias("text"), F.col(names[1]).alias("n_chars"))
