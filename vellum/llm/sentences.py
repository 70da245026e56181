"""Sentence units of texts in many languages: cascading tables of ordered break and no-break rules.

A rule is a pair of patterns, for what stands before and what follows a position.  Tables are tried in order - quotations, what
goes on, the document's own language, the other languages, the default - and the first rule that fits decides the position.
Documents mix languages and their ``lang`` is partly wrong, so the label only decides which table comes first.  Behind a quotation
that ends with a mark, what stands before is the text in front of its opening mark.

Positions that are tried: after a mark that can end a sentence, with its closing marks; a blank between two Thai letters.
Blank lines and list markers at the start of a line always separate.  Positions inside a quotation or brackets never do.

Defined results: null and blank texts have no units; a very long text is treated like any other; repeated rows give repeated units.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far a rule looks back and ahead, in characters.
BACK, AHEAD = 24, 24

# Abbreviations.  ``always`` never end a sentence; ``number`` do not before a number.
ALWAYS = {
    "en": r"mr|mrs|ms|messrs|dr|prof|eng|insp|st|vs|viz|cf|i\.\s*e|e\.\s*g|sq|pat|u\.\s*s",
    "de": r"z\.\s*b|u\.\s*a|d\.\s*h|i\.\s*d\.\s*r|i\.\s*d|vgl|gem|bzw|dipl\.-ing|ing|ggf|evtl|sog|inkl|hr|fr",
    "fr": r"mme|mlle|p\.\s*ex|c\.-à-d|env|mm\.\s*les",
    "es": r"sr|sra|dra|srta|ing|p\.\s*ej|ud|uds",
    "hi": "डॉ|प्रो|एम|मि|मी|क्र|सं|श्री|कु",
}
NUMBER = {
    "en": r"figs?|nos?|pp?|sect|secs?|ref|refs|ch|vol|approx|abt|ca|max|min|nom|para|eq|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec",
    "de": r"abb|nr|abs|s|ca|max|min|mind|bd|kap|tab|figs?|ziff|bl",
    "fr": r"figs?|p|pp|n°|no|max|min|env|d'env|art|chap",
    "es": r"figs?|págs?|núms?|n\.º|aprox|máx|mín|máx|art|cap\.",
    "hi": "पृ|चि",
}
#: Words that go on after an abbreviation in texts of capital letters only.
GOES_ON = r"ARE|AND|MAY|SUIT|REFERS|IS|WAS|WERE|CAN|FÜR|UND|ODER|ALS|PARA|POUR|Y|ET|OU|O|DE|DU|DES|IN|OF|TO|ON|FROM|WHICH|THAT"


@dataclass(frozen=True)
class Rule:
    """Whether a position with ``before`` in front of it and ``after`` behind it is a break."""

    breaks: bool
    before: str
    after: str = ""


def language_table(lang: str) -> list[Rule]:
    return [
        Rule(False, rf"(?i)(?<![\p{{Latin}}\p{{Devanagari}}\d])(?:{ALWAYS[lang]})\.", r""),
        Rule(False, rf"(?i)(?<![\p{{Latin}}\p{{Devanagari}}\d])(?:{NUMBER[lang]})\.", r"\s*[(（]?\p{Lu}?\d"),
    ]


#: Text without a small letter, for as far as it is looked at; the quotation itself is checked for one beforehand.
CAPITALS = r"(?:\A|[^\p{Ll}])[^\p{Ll}]{0,19}"

TABLES: dict[str, list[Rule]] = {
    # what follows shows that the sentence goes on
    "goes_on": [
        Rule(False, r"", r"\s*[,;:，、；：)\]）]"),
        Rule(False, r"[.!?…]\W*", r"\s+\p{Ll}"),
        Rule(False, r"…", r"\s*\p{Han}|\s*[\p{Hiragana}\p{Katakana}]"),
    ],
    "de_first": [
        Rule(False, r"(?i)(?<!\p{L})(?:am|im|vom|zum|beim|ab|bis|seit|der|die|das|den|dem)\s\d{1,2}\.", r"\s(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|JANUAR|MAI|JUNI|AUGUST)"),
        Rule(False, r"(?i)(?<!\p{L})(?:am|im|vom|zum|beim)\s+\d{1,2}\.", r"\s+\p{L}"),
    ],
    "es_first": [
        Rule(False, r"(?<!\p{L})S\.", r"\s*[AL]\."),
        Rule(True, r"(?<!\p{L})S\.\s*[AL]\.", r"\s+[\p{Lu}\d¿¡«\"(„“\p{Lo}]"),
    ],
    "initials": [
        Rule(True, r"\d\s+\p{Lu}\.", r"\s+[\p{Lu}\d¿¡«\"(„“\p{Lo}]"),
        Rule(False, r"\p{Lu}\.-\p{Lu}\.", r"\s*\p{Lu}"),
        Rule(False, r"(?:^|[\s(„«\"])\p{Lu}\.", r"\s*\p{Lu}"),
        Rule(False, r"(?<![\p{L}\d.])\p{Ll}\.", r""),
        Rule(False, r"\p{Devanagari}\.", r""),
    ],
    "capitals": [
        Rule(False, r"\s\.\.\.", r"\s+\p{Lu}{2}"),
        Rule(False, r"(?<!\p{L})(?:ETC|CO|INC|BROS|CORP|LTD|JUN|A\.M|P\.M|IN|FT|FF|USW|CIE|MIN|Ä|\.\.)\.", rf"\s+(?:{GOES_ON})(?!\p{{L}})"),
    ],
    # scripts without spaces between sentences
    "ja": [
        Rule(True, r"[。！？｡][」』”’»）)\"]*", r""),
        Rule(True, r"[!?]", r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
    ],
    "zh": [
        Rule(True, r"[。！？｡][」』”’»）)\"]*", r""),
        Rule(True, r"[!?]", r"\p{Han}"),
    ],
    # with a blank in between
    "th": [Rule(True, r"\p{Thai}", r"\p{Thai}")],
    # behind a quotation: a word or a mark that goes on, a quotation that a colon sets off, a script without case, a text of capitals only
    "quotation": [
        Rule(False, r"", r"\s*(?:\p{Ll}|[,;，、；]|[とをがはの])"),
        Rule(True, r"[:：]\s*", r"(?!\s*[:：])"),
        Rule(False, r"", r"\s*\p{Lo}"),
        Rule(False, CAPITALS, r"[^\p{Ll}]{20}|[^\p{Ll}]*\Z"),
        Rule(True, r"", r"\s*[\p{Lu}\d„«\"“¿¡(]"),
    ],
    "default": [
        Rule(True, r"(?:\p{Ll}{2}|\d[a-z]?|[)%°\"”“»])[.!?][\"”“»]?|[!?][\"”“»]?", r"[\"„«“¿¡]{0,2}\p{Lu}(?:\p{Ll}|\s|['’])"),
        Rule(True, r"[.!?…।॥][\"”“»’)\]）」』]*|[.!?…।॥]\s*»", r"\s"),
        Rule(True, r"[।॥]", r""),
    ],
}
LANGUAGES = ("en", "de", "fr", "es", "hi")

MARK = regex.compile(r"[.!?…。！？｡।॥]+")
BLANK_LINE = regex.compile(r"(?:\r?\n| )(?:[^\S\n]*(?:\r?\n| ))+")
#: A list marker at the start of a line, with the text behind it.
MARKER = regex.compile(r"(?m)^[^\S\n]*(?:[•‣◦▪●·*–—-]|\(?\d{1,3}[.)）]|[（(][\p{L}\d]{1,4}[)）]|\p{L}\)|[①-⑳])(?=[^\S\n]+\S|(?<=[）①-⑳・])\S)")
THAI_GAP = regex.compile(rf"(?<={TABLES['th'][0].before})\s+(?={TABLES['th'][0].after})")
#: Opening marks with what closes them, and marks that open and close alike (fixed values).
PAIRS = {"„": "“”", "“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）"}
ALIKE = ('"', "''")
QUOTE = regex.compile("|".join(map(regex.escape, (*PAIRS, *{c for closers in PAIRS.values() for c in closers} - set(PAIRS), *ALIKE))))
CLOSERS = "\"”“»」』)]）’"


Compiled = list[tuple[bool, regex.Pattern, regex.Pattern]]


def ending(before: str) -> str:
    """The pattern for text that ends so, searched from its end."""
    return f"(?ri)(?:{before[4:]})\\Z" if before.startswith("(?i)") else f"(?r)(?:{before})\\Z"


@lru_cache(maxsize=16)
def cascade(lang: str) -> tuple[Compiled, regex.Pattern, Compiled, Compiled]:
    """All rules in the order for a document of this language: what goes on, the tables of abbreviations and the like, the default.

    The middle tables are tried only where the text before could matter to any of them, which one pattern tells.
    """
    own = [lang] if lang in LANGUAGES else []
    unspaced = [*TABLES["zh"], *TABLES["ja"]] if lang == "zh" else [*TABLES["ja"], *TABLES["zh"]]
    middle = [*TABLES["de_first"], *TABLES["es_first"], *(r for x in own + [x for x in LANGUAGES if x not in own] for r in language_table(x)), *TABLES["initials"], *TABLES["capitals"]]
    compiled = lambda rules: [(r.breaks, regex.compile(ending(r.before)), regex.compile(r.after)) for r in rules]
    any_of = "|".join(f"(?i:{r.before[4:]})" if r.before.startswith("(?i)") else f"(?:{r.before})" for r in middle)
    return compiled(TABLES["goes_on"]), regex.compile(f"(?r)(?:{any_of})\\Z"), compiled(middle), compiled(unspaced + TABLES["default"])


def is_break(before: str, after: str, tables: tuple[Compiled, regex.Pattern, Compiled, Compiled]) -> bool:
    """What the first rule that fits decides; no rule, no break."""
    goes_on, suspect, middle, default = tables
    for rules in (goes_on, middle, default):
        if rules is middle and not suspect.search(before):
            continue
        for breaks, head, tail in rules:
            if tail.match(after) and head.search(before):
                return breaks
    return False


def list_starts(text: str) -> list[int]:
    """Starts of list items: any bullet, and numbers or letters that begin or go on a sequence or follow a lead-in."""
    out: list[int] = []
    last = ""
    for m in MARKER.finditer(text):
        mark = m.group().strip()
        core = mark.strip("().）（")
        if core.isdigit() and mark[-1] in ".)）" and mark[0] not in "(（" and core != "1":
            before = text[: m.start()].rstrip()
            line = before[before.rfind("\n") + 1 :].lstrip()
            if last != str(int(core) - 1) and not before.endswith((":", "：")) and not line.startswith(mark[:1]):
                continue
        last = core
        out.append(m.end() - len(m.group().lstrip()))
    return out


def quotations(text: str) -> tuple[list[int], list[int]]:
    """First and last position of each quotation and bracket, none inside another, however long; a mark without its partner is none.

    One walk over the marks: an opening mark of the same kind starts anew, as the one before it was left open; marks that open and close
    alike are paired in turn.
    """
    spans: list[tuple[int, int]] = []
    open_at: dict[str, int] = {}
    for m in QUOTE.finditer(text):
        mark, at = m.group(), m.start()
        if mark in ALIKE:
            if mark in open_at:
                spans.append((open_at.pop(mark), m.end() - 1))
            else:
                open_at[mark] = at
            continue
        opened = max((o for o in open_at if o in PAIRS and mark in PAIRS[o]), key=open_at.get, default=None)
        if opened is not None:
            spans.append((open_at.pop(opened), at))
        elif mark in PAIRS:
            open_at[mark] = at
    outer: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return [a for a, _ in outer], [b for _, b in outer]


def paragraph_breaks(text: str, lang: str) -> list[int]:
    """Positions in a text without blank lines at which a unit begins."""
    rules = cascade(lang)
    cuts = set(list_starts(text)) | {m.end() for m in THAI_GAP.finditer(text)}
    starts, ends = quotations(text)
    opening = set(starts)
    marker_ends = {m.end() for m in MARKER.finditer(text)}
    for m in MARK.finditer(text):
        at = m.end()
        k = bisect.bisect_right(starts, m.start()) - 1
        quote = None
        if k >= 0 and starts[k] < m.start() <= ends[k]:
            if text[at : ends[k]].strip().strip("'"):
                continue  # inside a quotation or bracket
            quote, at = starts[k], ends[k] + 1
        while at < len(text) and text[at] in CLOSERS and at not in opening:
            at += 1
        if at in marker_ends or at >= len(text):
            continue
        after = text[at : at + AHEAD]
        decided = None
        if quote is not None and text[quote] not in "(（":
            decided = behind_quotation(text, quote, at, after)
        if is_break(text[max(0, at - BACK) : at], after, rules) if decided is None else decided:
            cuts.add(at)
    return sorted(cuts)


def behind_quotation(text: str, start: int, at: int, after: str) -> bool | None:
    """What the first rule of the quotations' table decides behind one that starts and ends here; None if none fits."""
    before = text[max(0, start - BACK) : start]
    for breaks, head, tail, capitals in quotation_table():
        if tail.match(after) and head.search(before) and not (capitals and not in_capitals(text, start, at)):
            return breaks
    return None


def in_capitals(text: str, start: int, at: int) -> bool:
    """Whether a quotation with what stands around it has letters and no small one."""
    around = [c for c in text[max(0, start - 20) : at + 20] if c.isalpha()]
    return bool(around) and not any(c.islower() for c in around)


@lru_cache(maxsize=1)
def quotation_table() -> list[tuple[bool, regex.Pattern, regex.Pattern, bool]]:
    return [(r.breaks, regex.compile(ending(r.before)), regex.compile(r.after), r.before == CAPITALS) for r in TABLES["quotation"]]


def units(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Start and end of each sentence unit, in order, without outer white space."""
    out: list[tuple[int, int]] = []
    code = (lang or "").lower()[:2]
    at = 0
    bounds = [(m.start(), m.end()) for m in BLANK_LINE.finditer(text or "")] + [(len(text or ""), 0)]
    for stop, following in bounds:
        part = text[at:stop] if text else ""
        if part.strip():
            cuts = [0, *paragraph_breaks(part, code), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                piece = part[a:b]
                size = len(piece.strip())
                if size:
                    start = at + a + len(piece) - len(piece.lstrip())
                    out.append((start, start + size))
        at = following
    return out


def sentences(docs: DataFrame, doc_key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(doc_key, start_pos, end_pos)`` of every unit of every document; one narrow pass."""
    kind = docs.schema[doc_key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, (body, code) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for a, b in units(body, code):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[doc_key, "start_pos", "end_pos"])

    return docs.select(doc_key, text, lang).where(F.length(text) > 0).mapInArrow(split, f"{doc_key} {kind}, start_pos int, end_pos int")
