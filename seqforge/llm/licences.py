"""Sentence-rule recognition of licences (operator 8).

A text is cut into sentences, both as its lines stand and with the lines of a paragraph joined, marks of
comments and lists left out. A sentence is normalised (lower case, words of letters and digits, one
spelling of licence) and looked up whole: it is the sentence of one known identifier or of none, so a
phrase inside another sentence, or a denial of it, is not recognised. Declared slots in known sentences
(<*>, a holder's name) take up to SLOT words. A line of SPDX-License-Identifier is the sentence of each
identifier in its expression (AND, OR, WITH, brackets; -only, -or-later and + are of the licence before them).

Rules are ordered sequences of identifiers: those of a licence's whole text, of the sentences that tell it,
and of sentences that name it. Between two sentences of a rule up to ``gap`` others may stand, as copyright
notices do. The longest rules come first; a rule that matches at a place takes its sentences, so that no
other uses them. Matching looks only as far as the gap, so its cost follows the text's length.

The known sentences are public texts (licence_texts.py). Null and empty texts have no licence. Repeated
rows have a row each, null doc_ids too; an empty table gives an empty result; other columns are ignored.
Texts are read whole, whatever their length; a task needs about ten times the bytes of its longest one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts
from .licence_texts import CORES, FORMS, IDENTIFIED, NAMES, SHORTER, SLOT, TERMS, TEXTS
from .textbuf import arrow_text
from .tokenizing import slices

GAP = 3
#: Ends a sentence: a mark before white space.
BREAK = re.compile(r"(?<=[.!?;:])\s+")
#: Sentences that end with one of these may go on behind it: "License: MIT".
TAG = re.compile(r"(?:identifier|licen[cs]e):\s+$", re.IGNORECASE)
SPDX = re.compile(r"[\s#*/;%>|!\"'<-]*SPDX-License-Identifier:\s*([\w.+() -]*\w[+)]*)", re.IGNORECASE)
#: Marks of comments and lists before a line or sentence, and sentences that are nothing else.
LEADER = re.compile(r"[\s#*/;%>|!\"'<-]*(?:\(?(?:\d{1,2}|[a-zA-Z]|[ivxIVX]{1,4})[.)](?=\s|$)\s*)?")
#: Between paragraphs: lines of white space or marks of comments alone.
PARAGRAPH = re.compile(r"\n[\s#*/;%>|!<-]*\n")
MARKED = re.compile(r"\s*(?:#|//|/\*|\*|;|%|--)")
WORD = re.compile(r"[^\W_]+")
SPELT = {"licence": "license", "licenced": "licensed", "licences": "licenses"}


def normalise(sentence: str) -> str:
    """Words of letters and digits, lower case, one spelling, joined by spaces; without what leads it."""
    return " ".join(SPELT.get(w, w) for w in WORD.findall(sentence[LEADER.match(sentence).end() :].lower()))


def _paragraphs(text: str):
    """The lines of each paragraph; two commented lines or more are one apart from lines that are not."""
    for paragraph in PARAGRAPH.split(text):
        runs = [list(run) for _, run in groupby(paragraph.split("\n"), lambda line: bool(MARKED.match(line)))]
        own: list[str] = []
        for run in runs:
            if own and len(run) > 1 and MARKED.match(run[0]) or len(own) > 1 and MARKED.match(own[-1]) and MARKED.match(own[-2]):
                yield own
                own = []
            own += run
        yield own


def sentences(text: str) -> list[str]:
    """The sentences of a licence's text, in order."""
    joined = (re.sub(r"\s+", " ", p) for p in re.split(r"\n\s*\n", text))
    return [s for p in joined for s in BREAK.split(p.strip()) if normalise(s)]


def _known() -> tuple[dict[str, list[str]], list[tuple[str, tuple[str, ...]]]]:
    """(identifier: wordings; rules: licence, identifiers), the longest rules first."""
    forms: dict[str, list[str]] = {}
    of: dict[str, str] = {}
    rules: list[tuple[str, tuple[str, ...]]] = []

    def name(wording: str, own: str) -> str:
        found = of.setdefault(normalise(wording), own)
        if wording not in forms.setdefault(found, []):
            forms[found].append(wording)
        return found

    for licence, names in NAMES.items():
        own = f"{licence}.name"
        for each in names:
            short = each.removeprefix("the ")
            for wording in [*(f.format(each) for f in FORMS + TERMS), short]:
                name(wording, own)
        for form in IDENTIFIED:
            name(form.format(licence), own)
        name(f"SPDX-License-Identifier: {licence}", own)
        rules.append((licence, (own,)))
    for licence, text in TEXTS.items():
        own = [name(s, f"{licence}.{k}") for k, s in enumerate(sentences(text))]
        rules += [(licence, tuple(own))] + [(licence, tuple(own[k] for k in core)) for core in CORES[licence]]
        for k, wording in ((k, w) for x, k, w in SHORTER if x == licence):
            forms[own[k]].append(wording)
    return forms, sorted(dict.fromkeys(rules), key=lambda r: -len(r[1]))


#: Identifier: wordings. Rules: (licence, identifiers).
SENTENCES, RULES = _known()


def cuts(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the sentences of a text, and of those that a TAG ends together with what follows."""
    begins = [0, *(m.end() for m in BREAK.finditer(text))]
    ends = [*begins[1:], len(text)]
    return [*zip(begins, ends), *((a, ends[k + 1]) for k, (a, b) in enumerate(zip(begins, ends)) if k + 1 < len(ends) and TAG.search(text, a, b))]


class Recogniser:
    def __init__(self, known=SENTENCES, rules=RULES, gap: int = GAP):
        import ahocorasick

        self.rules, self.gap = rules, gap
        self.whole, self.slotted = {}, {}
        for identifier, wordings in known.items():
            for wording in wordings:
                if "<*>" not in wording:
                    self.whole[normalise(wording)] = identifier
                else:
                    pieces = [normalise(x) for x in wording.split("<*>")]
                    slot = rf"(?:\S+ ){{0,{SLOT - 1}}}\S+"
                    pattern = re.compile("".join(re.escape(x) + (" " if x else "") + (slot + " " * bool(y)) for x, y in zip(pieces, pieces[1:])) + re.escape(pieces[-1]))
                    self.slotted.setdefault(" ".join(pieces[0].split()[:3]), []).append((pattern, identifier))
        self.spdx = {licence.lower(): f"{licence}.name" for licence in NAMES if f"{licence}.name" in known}
        rarest = {min(normalise(w.replace("<*>", " ")).split(), key=lambda x: (x in COMMON, -len(x))) for wordings in known.values() for w in wordings}
        self.hints = ahocorasick.Automaton()
        for w in rarest:
            self.hints.add_word(w, w)
        self.hints.make_automaton()

    def may_hold(self, text: str) -> bool:
        """Whether a word is there that each known sentence has one of; a sentence wrapped over lines
        or spelt otherwise has it as well."""
        low = text.lower().replace("licence", "license")
        return next(self.hints.iter(low), None) is not None

    def identifier(self, sentence: str) -> str | None:
        """The identifier whose sentence this is, as a whole."""
        key = normalise(sentence)
        if key in self.whole:
            return self.whole[key]
        near = self.slotted.get(" ".join(key.split(" ", 3)[:3]), ())
        return next((identifier for pattern, identifier in near if pattern.fullmatch(key)), None)

    def named(self, sentence: str) -> tuple[str, ...]:
        """The identifiers whose sentence this is: those of an SPDX expression, or one at most."""
        if (line := SPDX.match(sentence)) is not None:
            words = (re.sub(r"(-only|-or-later|\+)$", "", w) for w in re.findall(r"[\w.+-]+", line[1].lower()))
            return tuple(dict.fromkeys(self.spdx[w] for w in words if w in self.spdx))
        found = self.identifier(sentence)
        return () if found is None else (found,)

    def identifiers(self, text: str) -> list[tuple[str, int]]:
        """(identifier, number of the sentence) of the known sentences, in order. Where a line and a joined
        sentence overlap the longer counts."""
        out, number = [], 0
        for paragraph in _paragraphs(text):
            lines, joined, at = [], [], 0
            for line in paragraph:
                bare = line[LEADER.match(line).end() :] if joined else line
                joined.append(bare.strip())
                lines.append((at, joined[-1]))
                at += len(joined[-1]) + 1
            flow = " ".join(joined)
            found = []
            begins = [0, *(m.end() for m in BREAK.finditer(flow))]
            for a, b in cuts(flow):
                if known := self.named(flow[a:b]):
                    found.append((a, -(b - a), known))
            for at, line in lines:
                for a, b in cuts(line):
                    if known := self.named(line[a:b]):
                        found.append((at + a, a - b, known))
            counted = [k for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(flow)])) if normalise(flow[a:b])]
            end = -1
            for a, size, known in sorted(found):
                if a >= end:
                    place = number + bisect_right(counted, bisect_right(begins, a) - 1) - 1
                    out += [(each, place) for each in known]
                    end = a - size
            number += len(counted)
        return out

    def matches(self, found: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """(licence, place in found of its first identifier): what the rules make of a sequence."""
        places: dict[str, list[int]] = {}
        for k, (identifier, _) in enumerate(found):
            places.setdefault(identifier, []).append(k)
        free, out = [True] * len(found), []
        for licence, names in self.rules:
            for i in places.get(names[0], ()):
                taken = [i] if free[i] else []
                for want in names[1:] if taken else ():
                    own = places.get(want, [])
                    k = bisect_right(own, taken[-1])
                    limit = found[taken[-1]][1] + self.gap + 1
                    while k < len(own) and not free[own[k]] and found[own[k]][1] <= limit:
                        k += 1
                    if k == len(own) or found[own[k]][1] > limit:
                        break
                    taken.append(own[k])
                if len(taken) == len(names):
                    for k in taken:
                        free[k] = False
                    out.append((licence, i))
        return sorted(out, key=lambda x: x[1])

    def licences(self, text: str) -> list[tuple[str, int]]:
        """(licence, number of the sentence of its first identifier), in order of the text."""
        found = self.identifiers(text)
        return [(licence, found[i][1]) for licence, i in self.matches(found)]


#: Words too frequent to tell that a licence sentence may be near.
COMMON = {"this", "that", "with", "without", "the", "and", "version", "under", "work", "name", "you", "may", "for"}
_made: list[Recogniser] = []


def recognise(docs: DataFrame) -> DataFrame:
    """doc_id, n_licences, licences (distinct, in order of the text, comma-joined), n_known_sentences."""

    def run(batches):
        if not _made:
            _made.append(Recogniser())
        own = _made[0]
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = arrow_text(part["text"])
                raw, rows = data.tobytes(), []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    text = raw[a:b].decode()
                    known = own.identifiers(text) if own.may_hold(text) else []
                    found = own.matches(known)
                    rows.append((len(found), ",".join(dict.fromkeys(x for x, _ in found)), len(known)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64())))], names=["doc_id", "n_licences", "licences", "n_known_sentences"])

    return texts(docs).mapInArrow(run, "doc_id long, n_licences long, licences string, n_known_sentences long")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(table(spark, sf_dir, "documents"))
