"""Sentences of a paragraph by four archetypes of text, and the clean-up of line breaks before it.

One cutter serves all archetypes; ``PROFILES`` says in what they differ.  Abbreviations and references that
an archetype protects are masked sign for sign, so that no rule sees into them and places stay as they are.
A text with a colon before a full sentence is cut in two regions there, and each region at its sentence marks.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# Abbreviations that don't end a sentence, as patterns, by archetype.
ACADEMIC = (
    r"et al|Fig|Figs|Eq|Eqs|No|Nos|Vol|Vols|pp|p|ch|Ch|sec|Sec|ref|Ref|refs|Refs|Tab|Tabs|App|Suppl|vs|cf|viz|ca|approx|"
    r"Dr|Mr|Mrs|Ms|Prof|Sr|Jr|Ph\.D|M\.D|B\.A|M\.A|B\.S|M\.S|Ed\.D|Inc|Ltd|Corp|Co|LLC|Assoc|Dept|Univ|"
    r"etc|e\.g|i\.e|ibid|op\. cit|loc\. cit|min|max|avg|std|approx|est|U\.S|U\.K|U\.S\.A|CEO|CFO|CTO|AI|API|URL|HTML|CSS|JS|PDF|FAQ"
)
LITERARY = "Dr|Mr|Mrs|Ms|Prof|Sr|Jr"
ESSAY = r"Dr|Mr|Mrs|Ms|Prof|Sr|Jr|Inc|Ltd|Corp|Co|etc|vs|e\.g|i\.e"
GENERIC = r"Dr|Mr|Mrs|Ms|Prof|Sr|Jr|Inc|Ltd|Corp|Co|etc|vs|e\.g|i\.e|U\.S|U\.K|Ph\.D|M\.D|B\.A|M\.A|CEO|CFO|CTO|AI|API|URL|HTML|CSS|JS|PDF|FAQ|Q&A"
# Verbs that make what follows a colon a sentence, and phrases that make it a list.
VERBS = """is are was were has have had do does did can could should will would may might be been being make makes made take takes took give gives gave
find finds found see sees saw come comes came go goes went get gets got think thinks thought know knows knew become becomes became seem seems seemed
appear appears appeared use uses used consider considers considered""".split()
LIST_INTRO = "the following|as follows|including|such as|for example|namely"
# References of academic texts.
PLACEHOLDER = r"\[(?:MATH|TABLE|FIGURE|EQ|FIG)_\d+\]"
CITATION = r"\([A-Z][a-zA-Z]+(?:\s+(?:et\s+al\.?|&\s+[A-Z][a-zA-Z]+))?,?\s*\d{4}[a-z]?\)"
NUMBERS = r"\[\d+(?:[-,]\d+)*\]"

OPENS = "\"'“”‘’"
MARK = re.compile(rf"[.!?](?=\s+(?:[{OPENS}(\[{{]*\s*)?[A-Z0-9가-힣぀-ゟ゠-ヿ一-鿿])")
ABBREVIATED = re.compile(rf"(?a:\b)(?:{ACADEMIC})$", re.I)
REFERENCE = re.compile(rf"(?i:{PLACEHOLDER})$|{CITATION}$|{NUMBERS}$")
SENTENCE_START = re.compile(rf"[{OPENS}]?\s*[A-Z]")
SENTENCE_END = re.compile(r"[.!?][\"'’”)\]]*$")
VERB = re.compile(rf"(?a:\b)(?:{'|'.join(VERBS)})(?a:\b)", re.I)
MASK = "\1"
SOLID, FIVE_WORDS = re.compile(r"\S"), re.compile(r"\S+(?:\s+\S+){4}")
INTRODUCES = re.compile(rf"(?:{LIST_INTRO})$", re.I)


class Profile(NamedTuple):
    protected: tuple[re.Pattern, ...]
    shortest: int
    utterance: str  # a pattern of the ways to end ("mark", "colon", "rest") and the most words that make a piece an utterance


def _abbreviations(names: str) -> re.Pattern:
    return re.compile(rf"(?a:\b)(?:{names})\.", re.I)


PROFILES = {
    "academic": Profile((_abbreviations(ACADEMIC), re.compile(PLACEHOLDER, re.I), re.compile(CITATION), re.compile(NUMBERS)), 2, ""),
    "literary": Profile((_abbreviations(LITERARY),), 1, "few words"),
    "essay": Profile((_abbreviations(ESSAY),), 2, "phrase"),
    "generic": Profile((_abbreviations(GENERIC),), 3, ""),
}


class Scope:
    """Which brackets and quotations are open in a text from ``begin`` on, kept as the text is read further."""

    SIGNS = re.compile(r"[()\[\]{}\"'“”‘’]")

    def __init__(self, text: str, begin: int = 0):
        self.text, self.begin, self.at = text, begin, begin
        self.depth, self.quoted, self.held = dict.fromkeys("([{", 0), {"'": False, '"': False}, {"'": 0, '"': 0}

    def read(self, to: int) -> bool:
        """Reads on to ``to``; is anything open there?  Apostrophes of words open nothing."""
        depth, quoted, held = self.depth, self.quoted, self.held
        for m in self.SIGNS.finditer(self.text, self.at, to):
            sign, at = m[0], m.start()
            if sign in depth:
                depth[sign] += 1
                continue
            if sign in ")]}":
                opener = "([{"[")]}".index(sign)]
                depth[opener] = max(0, depth[opener] - 1)
                continue
            kind = '"' if sign in '"“”' else "'"
            after_letter = at > self.begin and re.match("[a-zA-Z]", self.text[at - 1]) is not None
            if kind == "'" and after_letter and (sign == "'" or sign == "’" and not held[kind]):
                continue
            opens = sign in "“‘" or sign in "'\"" and not quoted[kind] or sign == "’" and not held[kind]
            if sign == "”" and not held[kind]:
                continue
            held[kind] = max(0, held[kind] + (1 if opens else -1))
            quoted[kind] = opens or (sign in "”’" and held[kind] > 0)
        self.at = to
        return any(depth.values()) or any(quoted.values())


def in_open_scope(text: str) -> bool:
    """Is a bracket or quotation opened in ``text`` and not closed?"""
    return Scope(text).read(len(text))


def ends_abbreviated(text: str, begin: int = 0, end: int | None = None) -> bool:
    """Does the text before a mark end with an abbreviation, a citation, a numbered reference or a placeholder?

    Abbreviations are short, and a reference starts at the last bracket that opens, so only that much is looked at.
    """
    end = len(text) if end is None else end
    while end > begin and text[end - 1].isspace():
        end -= 1
    if end > begin and text[end - 1] in ")]":
        at = text.rfind("(" if text[end - 1] == ")" else "[", begin, end)
        return at >= 0 and REFERENCE.match(text[at:end]) is not None
    return ABBREVIATED.search(text[max(begin, end - 40) : end]) is not None


def _colon(masked: str) -> int | None:
    """The first colon that no list follows but a full sentence: a capital, five words, a verb and a mark at the end."""
    if ":" not in masked:
        return None
    stripped = masked.rstrip()
    end = SENTENCE_END.search(stripped, max(0, len(stripped) - 200))
    last_verb = max((m.start() for m in VERB.finditer(masked)), default=-1)
    for m in re.finditer(":", masked):
        at = m.end()
        start = SOLID.search(masked, at)
        if end is None or start is None or last_verb < at or end.start() < at:
            return None  # nor do later ones
        if SENTENCE_START.match(masked, start.start()) and FIVE_WORDS.match(masked, start.start()) and not INTRODUCES.search(masked[max(0, m.start() - 40) : m.start()].rstrip()):
            return m.start()
    return None


def opens_full_sentence(text: str) -> bool:
    """Is what follows a colon a full sentence: a capital, five words, a verb and a mark at the end?"""
    text = text.strip()
    return bool(SENTENCE_START.match(text)) and len(text.split()) >= 5 and bool(VERB.search(text)) and bool(SENTENCE_END.search(text))


def _ends(masked: str, start: int, stop: int) -> list[int]:
    """Where the sentences of a region end, its last one left out."""
    out, begin, scope = [], start, Scope(masked, start)
    last = len(masked[:stop].rstrip())
    for m in MARK.finditer(masked, 0, stop):
        at = m.start()
        if at < begin:
            continue
        solid = SOLID.search(masked, at + 1, stop)
        after = solid.start() if solid else stop
        if scope.read(at) or ends_abbreviated(masked, begin, at) or (0 < last - after < 5 and MASK not in masked[after:last]):
            continue
        out.append(at + 1)
        begin, scope = after, Scope(masked, after)
    return out


def cut_sentences(text: str, archetype: str) -> list[tuple[str, str]]:
    """(sentence, type) of a clean text; types: sentence, utterance."""
    profile, masked = PROFILES[archetype], text
    for pattern in profile.protected:
        masked = pattern.sub(lambda m: MASK * len(m[0]), masked)
    colon = _colon(masked)
    regions = [(0, len(text), "rest")] if colon is None else [(0, colon, "colon"), (colon + 1, len(text), "rest")]
    pieces = []
    for start, stop, last in regions:
        ends = _ends(masked, start, stop)
        begin = start
        for end in ends:
            pieces.append((text[begin:end].strip(), "mark"))
            begin = end
        pieces.append((text[begin : stop + (last == "colon")].strip(), last))
    kept = [(s, how) for s, how in pieces if len(s) >= profile.shortest or (how == "colon" and archetype != "academic")]
    if not kept and len(text) >= profile.shortest:
        return [(text, "sentence")]
    return [(s, _type(s, how, profile.utterance)) for s, how in kept]


def _type(text: str, how: str, utterance: str) -> str:
    words = len(text.split())
    if utterance == "few words":
        return "utterance" if words <= 2 else "sentence"
    if utterance == "phrase" and how == "colon":
        return "utterance" if words <= 3 else "sentence"
    if utterance == "phrase" and how == "rest":
        return "utterance" if text.endswith(":") or (words <= 3 and text[-1:] not in ".!?") else "sentence"
    return "sentence"


# List items and addresses, as the joining of lines sees them.
LIST_LINE = re.compile(r"\s*(?:[-*•]|\d+\.)\s+")
ADDRESS = re.compile(r"(?i:https?://|www\.)|\S+@\S+\.\S+")


def _title_like(line: str) -> bool:
    words = line.split()
    return 1 < len(words) <= 12 and sum(bool(re.fullmatch(r"[A-Z][A-Za-z'-]*", w)) for w in words) >= 0.6 * len(words)


def _joint(line: str, following: str) -> str | None:
    """What stands between a line and the one after it if they are joined, None if not."""
    if LIST_LINE.match(line):
        return None
    if re.search("[A-Za-z0-9]-$", line):
        return "- " if ADDRESS.search(line + following) else ""
    if re.search("[.!?…]+[\"'’”)\\]]?$", line.strip()) or not following:
        return None
    if re.match("[A-Z]", following) and (_title_like(line) or len(line) <= 40):
        return None
    return None if LIST_LINE.match(following) else " "


def join_lines(text: str) -> str:
    """Line breaks inside sentences become spaces; lists, titles and paragraphs (blank lines) keep theirs."""
    text = re.sub(r"\r\n?", "\n", text)
    lines, out, i = re.split(r"(?<!\n)\n(?!\n)", text), [], 0
    while i < len(lines):
        line, following = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
        i += 1
        if "\n" in line or not line:  # a paragraph ends in it
            out += [line] if line else []
            continue
        line, following = line.rstrip(), following.lstrip(" \t")
        joint = _joint(line, following)
        if joint is None:
            out.append(line)
        else:
            out.append((line[:-1] if joint != " " else line) + joint + following)
            i += 1
    joined = re.sub(r"\n{2,}", "\n\n", "\n".join(out))
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+\n", "\n", joined)).strip()


def clean_text(text: str | None) -> str:
    """Without tags, entities and zero-width signs, in NFC, line breaks joined."""
    text = re.sub(r"&[a-zA-Z0-9#]+;", " ", re.sub(r"<[^>]*>", "", text or ""))
    return join_lines(unicodedata.normalize("NFC", re.sub("[​-‍﻿]", "", text)))


def split_sentences(text: str | None, archetype: str = "generic", clean: bool = False) -> list[tuple[str, str]]:
    """(sentence, type) of a text; ``clean``: its line breaks and tags are done with already."""
    text = unicodedata.normalize("NFC", text or "") if clean else clean_text(text)
    if not text:
        return []
    lines = [(re.sub(r"[ \t]+", " ", re.sub("[\r\n\x0b\x0c\x85\u2028\u2029]+", " ", s)).strip(), kind) for s, kind in cut_sentences(text, archetype)]
    least = 1 if archetype == "literary" else 2
    return [(s, kind) for s, kind in lines if len(s) >= least and not re.fullmatch(r"[.!?…—\-:;]+", s)]
