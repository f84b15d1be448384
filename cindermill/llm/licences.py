"""Operator 3: licence scan. An Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates the expressions that follow the tags."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import WORD_TABLE, map_rows, table

# The base phrases; further notice phrases; and the permissiveness (0 to 1) by which licences are ranked.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "affero general public license": "agpl",
    "all rights reserved": "proprietary",
    "apache software license": "apache",
    "bsd license": "bsd",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "confidential and proprietary": "proprietary",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "eclipse public license": "epl",
    "gnu gpl": "gpl",
    "gnu lesser general public license": "lgpl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
    "unlicense": "unlicense",
    "zlib license": "zlib",
}
PERMISSIVENESS = {
    "agpl": 0.2, "apache": 0.9, "bsd": 1.0, "cc-by": 0.9, "cc-by-nc": 0.2, "cc-by-nc-nd": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nd": 0.2, "cc-by-sa": 0.5, "cc0": 1.0, "epl": 0.5,
    "gpl": 0.3, "isc": 1.0, "lgpl": 0.5, "mit": 1.0, "mpl": 0.6, "proprietary": 0.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0,
}
#: What a linking or similar exception (``WITH ...``) adds to a licence's permissiveness.
EXCEPTION_BONUS = 0.2
TAGS = ("spdx license identifier", "licence identifier", "license identifier")
#: A tag of whole words, written with a hyphen, or with other signs between its words and a colon; it stands on one line, and its expression ends with that or at the next tag.
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_TAG = re.compile(rf"(?<![^{_GAP}])(?:SPDX-)?Licen[cs]e(?:-Identifier(?![^{_GAP}])[ \t]*:?|(?:(?![\r\n])[{_GAP}])+Identifier[ \t]*:)[ \t]*", re.I)
_LINE_END = re.compile(r"[\r\n]|\Z")
_EXPRESSION = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
_PRIORITY = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of an identifier: its known family without version or variant, else the identifier in lower case."""
    name = identifier.lower()
    best = max((f for f in PERMISSIVENESS if name == f or name.startswith((f + "-", f + "+")) or (name.startswith(f) and name[len(f) :][:1].isdigit())), key=len, default=None)
    return best or {"0bsd": "bsd", "licenseref-proprietary": "proprietary"}.get(name, name)


def to_postfix(text: str) -> list[str] | None:
    """Shunting-yard: the longest well-formed licence expression at the start of ``text`` in postfix order; None if there is none."""
    out: list[str] = []
    stack: list[str] = []
    depth, want_operand = 0, True
    # The last point at which the expression was complete: the output's length and the operators that waited (three at most).
    good: tuple[int, list[str]] | None = None
    at = 0
    while m := _EXPRESSION.match(text, at):
        word, at = m.group(1), m.end()
        op = word.lower()
        if op == "(":
            if not want_operand:
                break
            stack.append(op)
            depth += 1
        elif op == ")":
            if want_operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif op in _PRIORITY:
            if want_operand:
                break
            while stack and stack[-1] != "(" and _PRIORITY[stack[-1]] >= _PRIORITY[op]:
                out.append(stack.pop())
            stack.append(op)
            want_operand = True
        else:
            if not want_operand:
                break
            out.append(word.rstrip(".-"))
            want_operand = False
        if not want_operand and not depth:
            good = len(out), stack[::-1]
    return out[: good[0]] + good[1] if good else None


def evaluate(postfix: list[str]) -> tuple[float, list[str]]:
    """(permissiveness, labels): ``or`` lets the user choose the freer side, ``and`` binds to the stricter, ``with`` frees its left side a little. Licences that are not known count 0.5."""
    # Of each operand its value, and where its labels begin; they go on to the last.
    stack: list[tuple[float, int]] = []
    labels: list[str] = []
    for item in postfix:
        if item not in _PRIORITY:
            stack.append((PERMISSIVENESS.get(label := family(item), 0.5), len(labels)))
            labels.append(label)
            continue
        (right, exception), (left, start) = stack.pop(), stack.pop()
        if item == "with":
            del labels[exception:]
            stack.append((min(1.0, left + EXCEPTION_BONUS), start))
        else:
            stack.append(((max if item == "or" else min)(left, right), start))
    return stack[0][0], labels


class Scanner:
    """Phrase automaton of a worker. ``extra`` and ``base`` map phrases of words to labels."""

    def __init__(self, base: dict[str, str] = BASE, extra: dict[str, str] = NOTICES):
        self.base, self.extra = base, extra
        self.automaton = ahocorasick.Automaton()
        for phrase in {*base, *extra, *TAGS}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        words = text.encode().translate(WORD_TABLE).split()
        line = f" {b' '.join(words).decode()} "
        places: list[int] = []
        base, extra, notices, tagged = set(), set(), 0, False
        seen_to = seen_words = 0
        for end, phrase in self.automaton.iter(line):
            if phrase in TAGS:
                tagged = True
                continue
            if phrase in self.base:
                start = end - len(phrase) - 1
                seen_words += line.count(" ", seen_to, start) - line.count(" ", start, seen_to)
                seen_to = start
                places.append(seen_words)
                base.add(self.base[phrase])
            if phrase in self.extra:
                extra.add(self.extra[phrase])
                notices += 1
        expressions, freedom = [], []
        if tagged:
            found = list(_TAG.finditer(text))
            ends = [m.start() for m in found[1:]] + [len(text)]
            for m, end in zip(found, ends, strict=False):
                postfix = to_postfix(text[m.end() : _LINE_END.search(text, m.end(), end).start()])
                if postfix:
                    value, labels = evaluate(postfix)
                    expressions.append(" ".join(postfix))
                    freedom.append(value)
                    extra.update(labels)
        labels = base | extra
        # Each base phrase, notice and evaluated tag is a piece of evidence that leaves less doubt.
        doubt = 0.5 ** min(len(places), 60) * 0.6 ** min(notices, 60) * 0.1 ** min(len(expressions), 60)
        freedom += [PERMISSIVENESS.get(x, 0.5) for x in labels] if not freedom else []
        return (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - doubt,
            min(freedom, default=None), "; ".join(expressions),
        )


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("permissiveness", T.DoubleType()),
    T.StructField("expressions", T.StringType()),
]


class _Scan:
    factory = True

    def __init__(self, base, extra):
        self.base, self.extra = base, extra

    def __call__(self):
        return Scanner(self.base, self.extra)


def scan(docs: DataFrame, base: dict[str, str] = BASE, extra: dict[str, str] = NOTICES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Licence evidence of every document.

    n_words, n_base (all places of base phrases, overlapping ones too), first_word, last_word (null without a place),
    base_labels, labels (sorted, joined by commas; empty without any), score (0 without evidence), permissiveness (of
    the strictest expression, or else of the labels; null without any), expressions (postfix, joined by "; "). Null
    and empty texts have no words; rows are independent, so repeated rows stay; other columns are ignored, and a kept
    column that has the name of a result gives way to it.
    """
    return map_rows(docs, _Scan(base, extra), FIELDS, list(keep), ["text"])


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
