"""Transcripts as speaker turns, whatever house style they are written in.

A page becomes a list of paragraphs (or a printed transcript a list of lines), each
with what styles go by: its tag and class, how it is set, the bold words or the
link it begins with, and its text. A dialect is a table of rules that say what a
paragraph is (a turn's beginning, more of it, a heading, a time, ...), and one
automaton goes over these events by a table of transitions, which a dialect may
change. Dialects so are data; there is one parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCKS = {"p", "div", "li", "blockquote", "td", "th", "tr", "center", "title", *(f"h{k}" for k in range(1, 7))}
_BOLD = {"b", "strong"}
_HIDDEN = {"script", "style", "head"}


class Paragraph(NamedTuple):
    """What a style can go by."""

    tag: str = "line"
    cls: str = ""
    centred: bool = False
    lead: str = ""  # the bold words that it begins with
    link: str = ""  # the class of the first link, and its text
    link_text: str = ""
    anchor: str = ""
    text: str = ""


def _plain(text: str) -> str:
    return " ".join(text.split())


class _Paragraphs(HTMLParser):
    """The paragraphs of a page in order; bold runs may open before a paragraph or end inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Paragraph] = []
        self.bold = self.hidden = 0
        self._begin("p", {})

    def _begin(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.cls = tag, re.sub(r"[^a-z0-9]", "", (attrs.get("class") or "").lower())
        style = (attrs.get("style") or "").replace(" ", "").lower()
        self.centred = (attrs.get("align") or "").lower() == "center" or "text-align:center" in style or tag == "center"
        self.said: list[str] = []
        self.lead: list[str] = []
        self.leading, self.anchor = True, attrs.get("id") or ""
        self.link, self.link_text, self.in_link = "", [], False

    def _end(self) -> None:
        text = _plain("".join(self.said))
        if text:
            self.out.append(Paragraph(self.tag, self.cls, self.centred, _plain("".join(self.lead)), self.link, _plain("".join(self.link_text)), self.anchor, text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _BLOCKS:
            self._end()
            self._begin(tag, given)
        elif tag in _BOLD:
            self.bold += 1
        elif tag == "br":
            self.handle_data(" ")
        elif tag == "a":
            self.anchor = self.anchor or given.get("name") or ""
            if not self.link and given.get("class"):
                self.link, self.in_link = re.sub(r"[^a-z0-9]", "", given["class"].lower()), True
        elif tag == "span":
            self.anchor = self.anchor or given.get("id") or ""

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCKS:
            self._end()
            self._begin("p", {})
        elif tag in _BOLD:
            if not self.bold and self.leading and not self.lead:
                self.lead = list(self.said)  # a run that was opened nowhere ends here
            self.bold = max(0, self.bold - 1)
            self.leading = self.leading and not _plain("".join(self.lead))
        elif tag == "a":
            self.in_link = False

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.said.append(data)
        if self.in_link:
            self.link_text.append(data)
        if self.bold and (self.leading or self.lead == self.said[:-1]):
            self.lead.append(data)
        elif data.strip() and self.bold:
            self.leading = False

    def all(self) -> list[Paragraph]:
        self.close()
        self._end()
        return self.out


def paragraphs(html: str) -> list[Paragraph]:
    """The paragraphs of a page that have any text."""
    parser = _Paragraphs()
    parser.feed(html)
    return parser.all()


def lines(text: str) -> list[Paragraph]:
    """The lines of a printed transcript; blank ones are paragraphs without text."""
    return [Paragraph(text=_plain(x)) for x in re.split(r"\r\n|[\n\r\f]", text)]


class Rule(NamedTuple):
    """What a paragraph is if it has all that is given here. ``name`` and ``body`` are groups of the patterns."""

    event: str
    cls: tuple[str, ...] = ()
    tag: tuple[str, ...] = ()
    centred: bool | None = None
    link: str = ""
    lead: str = ""
    text: str = ""
    named: Callable[[str], bool] | None = None  # whether the name found is one

    def match(self, p: Paragraph) -> dict[str, str] | None:
        if (self.cls and p.cls not in self.cls) or (self.tag and p.tag not in self.tag) or (self.centred is not None and p.centred != self.centred) or (self.link and p.link != self.link):
            return None
        found: dict[str, str] = {}
        for pattern, value in ((self.lead, p.lead), (self.text, p.text)):
            if pattern:
                m = re.match(pattern, value)
                if not m:
                    return None
                found |= {k: v or "" for k, v in m.groupdict().items()}
        return found if self.named is None or self.named(found["name"]) else None


# States: before the proceedings, with no turn open, with one, awaiting a heading's words, and after the end.
BEFORE, CLOSED, OPEN, AWAITING, DONE = "before", "closed", "open", "awaiting", "done"
#: From a state by an event to a state, and what is done: ``begin`` a turn, ``add`` to it, end it and note a
#: ``section`` or ``subject``, note a ``time``, go on with the ``last`` turn, or nothing.
TRANSITIONS: dict[tuple[str, str], tuple[str, str]] = {
    **{(s, "begins"): (OPEN, "begin") for s in (CLOSED, OPEN)},
    (OPEN, "more"): (OPEN, "add"),
    (OPEN, "blank"): (OPEN, "add"),
    **{(s, "heading"): (CLOSED, "section") for s in (BEFORE, CLOSED, OPEN, AWAITING)},
    **{(s, "subject"): (CLOSED, "subject") for s in (CLOSED, OPEN)},
    **{(s, "time"): (s, "time") for s in (CLOSED, OPEN)},
    **{(s, "announced"): (AWAITING, "end") for s in (BEFORE, CLOSED, OPEN, AWAITING)},
    **{(AWAITING, e): (CLOSED, "section") for e in ("more", "begins")},
    (BEFORE, "chair"): (CLOSED, ""),
    **{(s, "nameless"): (OPEN, "last") for s in (CLOSED, OPEN)},
    **{(s, "stop"): (DONE, "end") for s in (CLOSED, OPEN)},
}


class Dialect(NamedTuple):
    """A house style: the rules in order, of which the first that fits counts; else a paragraph is ``more``."""

    rules: tuple[Rule, ...]
    start: str = CLOSED
    printed: bool = False
    #: A pattern that pages of this style have, and no other style tried before it.
    mark: str = ""
    transitions: dict[tuple[str, str], tuple[str, str]] = {}


_CLOCK = r"(?P<time>\d{1,2}[:.]\d{2}(?:\s*[ap]\.?\s?m\.?)?)"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_LABEL = r"(?P<name>[^:]{1,160}?)\s*:\s*"
_ANY_LABEL = r"^(?P<name>[^:]{1,240}?)\s?:\s*(?P<body>.*)$"
#: Who is named by an office, what may stand before it, and the labels of many at once.
OFFICES = ("speaker", "chair", "chairman", "chairperson", "chairwoman", "clerk", "clerk assistant", "sergeant at arms")
RANKS = ("", "acting ", "deputy ", "assistant deputy ", "vice ")
ADDRESSES = ("the", "mr.", "madam", "madame")
MANY = ("hon. members", "some hon. members", "some members", "some honourable members", "an hon. member", "an honourable member")
#: What a person's label begins with.
HONORIFICS = ("mr.", "mrs.", "ms", "ms.", "miss", "dr.", "hon.", "madam", "member", "mla")
_OFFICIAL = {f"{a} {r}{o}" for a in ADDRESSES for r in RANKS for o in OFFICES} | set(MANY)


def printed_label(name: str) -> bool:
    """Whether a print's words before a colon name a speaker: an office, many, or an honorific and one to five words.

    A person's office may follow behind a comma.
    """
    words = name.lower().replace("-", " ").split()
    if " ".join(words) in _OFFICIAL:
        return True
    own = name.partition(",")[0].split()
    return 2 <= len(own) <= 6 and own[0].lower() in HONORIFICS and all(w[:1].isalpha() and not set(w) & set("()[];!?\"") for w in own[1:])

#: The dialects, in the order in which a page is tried.
DIALECTS: dict[str, Dialect] = {
    "classes": Dialect(
        (
            Rule("begins", cls=("speakerbegins",), text=_LABEL + r"(?P<body>.*)$"),
            Rule("nameless", cls=("speakerbegins",)),
            Rule("more", cls=("speakercontinues", "speakercontinuesmidspeech")),
            Rule("time", cls=("timestamp", "timeline"), text=rf".*?{_CLOCK}"),
            Rule("heading", cls=("proceedings", "proceedingsheading", "proceduralheading", "businessheading")),
            Rule("subject", cls=("subjectheading",)),
            Rule("note", cls=("timestamp", "timeline", "timelineroman", "speakername", "editorialcomment", "chairchangemidspeech", "styleline", "dateoftranscript")),
        ),
        mark=r'(?i)class="?speaker-?(begins|continues)',
    ),
    "linked names": Dialect((Rule("begins", link="hsdmla"), Rule("heading", tag=("h1", "h2", "h3", "h4")), Rule("note", text=r"^(?:Previous|Next)(?:\s+Next)?$")), mark=r'(?i)class="[^"]*hsd_mla'),
    "speaker starts": Dialect((Rule("begins", cls=("speakerstart",), lead=_LABEL + "$"), Rule("note", cls=("procedure",)), Rule("time", cls=("timestamp",), text=rf".*?{_CLOCK}"), Rule("heading", tag=("h1", "h2", "h3", "h4"))), mark=r'(?i)class="?speakerStart'),
    "word 97": Dialect((Rule("begins", lead=_LABEL + "$"), Rule("heading", centred=True), Rule("note", text=r"^\*\s*\(\d+:\d+\)$")), mark=r"(?is)<meta[^>]+generator[^>]+Microsoft Word 97(?!.*MsoNormal)"),
    "front page": Dialect((Rule("begins", lead=r"(?P<name>[^a-z:]*[A-Z][^:]{0,80}?(?:\([^)]*\))?)\s*:$"), Rule("heading", centred=True)), mark=r"(?i)<meta[^>]+generator[^>]+FrontPage"),
    "bold names": Dialect(
        (
            Rule("time", text=rf"^\*?\s*\(?{_CLOCK}\)?$"),
            Rule("begins", lead=_LABEL + "$"),
            Rule("heading", cls=("msoheading8",)),
            Rule("heading", tag=("h1", "h2", "h3", "h4")),
            Rule("set apart", text=r"(?P<whole>.+)$"),
        ),
        mark=r"(?i)<(?:b|strong)\b",
    ),
    "printed": Dialect(
        (
            Rule("stop", text=r"(?i)^\[The (?:Assembly|House) adjourned at"),
            Rule("blank", text=r"^$"),
            Rule("note", text=r"^\d{3,5}$"),
            Rule("note", text=r"(?i)^[A-Z]\w+ Hansard$"),
            Rule("note", text=rf"^(?:{_MONTHS})\s+\d{{1,2}},\s+\d{{4}}$"),
            Rule("chair", text=r"(?P<name>\[.*)$", named=lambda t: t.lower().endswith(" in the chair]")),
            Rule("note", text=r"(?P<name>\[.*)$", named=lambda t: t.find("]") == len(t) - 1),
            Rule("announced", text=r"(?i)^head:$"),
            Rule("heading", text=r"(?i)^head:\s*(?P<section>.+)$"),
            Rule("begins", text=_ANY_LABEL, named=printed_label),
        ),
        start=BEFORE,
        printed=True,
        mark=r"(?im)^\s*head:|in the chair\]\s*$",
        transitions={(AWAITING, "note"): (AWAITING, ""), (AWAITING, "blank"): (AWAITING, "")},
    ),
    "two languages": Dialect(
        (
            Rule("stop", text=r"(?i)^\((?:The )?House adjourned at"),
            Rule("blank", text=r"^$"),
            Rule("note", text=r"^\d{1,5}$"),
            Rule("time", text=rf"^{_CLOCK}$"),
            Rule("note", text=rf"(?i)^(?:legislative assembly|province of \w[\w ]*|assemblée législative|province d\w+ [\w\- ]+|(?:{_MONTHS})\s+\d{{1,2}}(?:,\s+\d{{4}})?)$"),
            Rule("note", text=r"(?P<name>[(\[].*)$", named=lambda t: t[-1] in "])"),
            Rule("begins", text=_ANY_LABEL, named=printed_label),
        ),
        printed=True,
        mark=r"(?im)^(?:Mr\.|Madame?) Speaker:",
    ),
}


def dialect_of(text: str) -> str:
    """The dialect of a page by its marks; printed lines without any are ``printed``."""
    for name, dialect in DIALECTS.items():
        if dialect.printed == ("<" not in text[:2000] and "</" not in text) and re.search(dialect.mark, text):
            return name
    return "bold names" if "</" in text else "printed"


class Turn(NamedTuple):
    speaker: str
    bracket: str | None
    body: str
    section: str | None
    subject: str | None
    spoken_at: str | None
    anchor: str | None


def _events(dialect: Dialect, found: list[Paragraph]) -> Iterator[tuple[str, dict[str, str], Paragraph]]:
    for p in found:
        for rule in dialect.rules:
            groups = rule.match(p)
            if groups is None:
                continue
            if rule.event == "set apart":  # bold from end to end: a heading; else it is part of a turn
                yield ("heading" if p.lead and p.lead == p.text else "more"), {}, p
            elif rule.event == "begins" and not rule.text:
                lead = p.link_text if rule.link else p.lead
                rest = p.text[p.text.find(lead) + len(lead) :] if lead in p.text else p.text
                # Links to the turns around it may stand before the colon.
                rest = rest if lead.endswith(":") else re.sub(r"^\s*(?:Previous|Next|\s)*:", "", rest)
                yield "begins", {"name": groups.get("name") or lead.rstrip(" :"), "body": rest.strip()}, p
            else:
                yield rule.event, groups, p
            break
        else:
            yield ("more" if p.text else "blank"), {}, p


def _joined(parts: list[str], printed: bool) -> str:
    """A turn's paragraphs by line; those of a print are lines, which blanks part and hyphens at their ends join."""
    if not printed:
        return "\n".join(x for x in parts if x)
    whole = "\n".join(parts)
    whole = re.sub(r"(?<=[^\W\d_])-\n(?=[a-zß-ÿ])", "", whole)
    return "\n".join(x for x in (_plain(block) for block in re.split(r"\n\s*\n", whole)) if x)


def read_turns(text: str, name: str | None = None) -> list[Turn]:
    """The turns of one transcript, in a dialect or in that of its marks. Turns without words go."""
    dialect = DIALECTS[name or dialect_of(text)]
    table = TRANSITIONS | dialect.transitions
    state, section, subject, clock = dialect.start, None, None, None
    turns: list[tuple[Turn, list[str]]] = []
    open_turn: tuple[Turn, list[str]] | None = None
    for event, groups, p in _events(dialect, lines(text) if dialect.printed else paragraphs(text)):
        state, action = table.get((state, event), (state, ""))
        if action in ("begin", "section", "subject", "end") and open_turn:
            turns.append(open_turn)
            open_turn = None
        if action == "begin":
            label = _plain(groups["name"])
            bracket = re.match(r"^(.*?)\s*\(([^()]+)\)$", label)
            first = Turn(bracket[1] if bracket and bracket[1] else label, bracket[2].strip() if bracket and bracket[1] else None, "", section, subject, clock, p.anchor or None)
            open_turn = (first, [groups.get("body", "")])
        elif action == "add" and open_turn:
            open_turn[1].append(p.text)
        elif action == "last" and (open_turn or turns):
            open_turn = open_turn or turns.pop()
            open_turn[1].append(p.text)
        elif action == "section":
            section, subject = groups.get("section") or p.text, None
        elif action == "subject":
            subject = p.text
        elif action == "time":
            clock = groups["time"]
        if state == OPEN and open_turn is None:
            state = CLOSED
    if open_turn:
        turns.append(open_turn)
    whole = [t._replace(body=_joined(parts, dialect.printed)) for t, parts in turns]
    return [t for t in whole if t.body]


_TURN = "struct<speaker:string,bracket:string,body:string,section:string,subject:string,spoken_at:string,anchor:string>"


def dialect(text: Column) -> Column:
    """The dialect of a transcript; null for a null."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if t is None else dialect_of(t) for t in batch.to_pylist()], pa.string())

    return run(text)


def transcript_turns(pages: DataFrame, key: str, text: str, dialect: str | None = None) -> DataFrame:
    """``key, sequence, speaker, bracket, body, section, subject, spoken_at, anchor, dialect`` of all turns.

    ``dialect`` is a name in ``DIALECTS`` or, by default, each page's own by its
    marks. ``bracket`` is what a label has in brackets at its end, a person behind
    an office or an office behind a person. Nulls and empty pages have no turn, nor
    have pages without a label. A page is one sitting and is read as a whole.
    """
    kind = pa.list_(pa.struct([(c, pa.string()) for c in Turn._fields]))

    @F.arrow_udf(f"struct<dialect:string,turns:array<{_TURN}>>")
    def run(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch.to_pylist():
            name = dialect or dialect_of(t or "")
            out.append({"dialect": name, "turns": [x._asdict() for x in read_turns(t or "", name)]})
        return pa.array(out, pa.struct([("dialect", pa.string()), ("turns", kind)]))

    read = pages.select(F.col(key), run(F.col(text).cast("string")).alias("r")).select(key, F.col("r.dialect").alias("dialect"), F.posexplode("r.turns").alias("sequence", "t"))
    return read.select(key, "sequence", "t.*", "dialect")
