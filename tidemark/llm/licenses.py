"""Licence scans: an Aho-Corasick pass finds notice phrases and identifier tags, and a shunting-yard
parser evaluates the licence expression after a tag.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame

from .common import folded_word_spans, folded_words, map_texts
from .phrases import PhraseAutomaton

#: The phrases that every scan counts as base evidence.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: More notice phrases, which only add labels.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Identifiers that an evaluation lets through unless the caller names others.
PERMITTED = frozenset("apache-2.0 mit bsd-2-clause bsd-3-clause isc bsl-1.0 cc0-1.0 cc-by-4.0 zlib unlicense 0bsd".split())
#: Exceptions that make a licence outside the list usable.
PERMITTED_EXCEPTIONS = frozenset(["classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception"])

_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]+)")
_AFTER_TAG = re.compile(r"[ \t]*:[ \t]*([^\r\n]*)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def parse_expression(line: str) -> tuple[list[str], str]:
    """The longest licence expression at the start of ``line`` in postfix order, and as written.

    ``with`` binds closer than ``and``, ``and`` closer than ``or``. The expression ends before the first
    token that cannot continue it; without a valid beginning the result is empty.
    """
    output: list[str] = []
    stack: list[str] = []
    best, rest, until = 0, [], 0
    at, open_, operand, after_with = 0, 0, True, False
    while token := _TOKEN.match(line, at):
        word = token[1].lower()
        if operand:
            if word == "(" and not after_with:
                stack.append(word)
                open_ += 1
            elif word in _PRECEDENCE or word in "()":
                break
            else:
                output.append(word)
                operand, after_with = False, False
        elif word in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[word]:
                output.append(stack.pop())
            stack.append(word)
            operand, after_with = True, word == "with"
        elif word == ")" and open_:
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
            open_ -= 1
        else:
            break
        at = token.end()
        if not operand and not open_:
            best, rest, until = len(output), stack[::-1], at
    return output[:best] + rest, line[:until].strip()


def evaluate(postfix: list[str], permitted: Collection[str] = PERMITTED, exceptions: Collection[str] = PERMITTED_EXCEPTIONS) -> bool:
    """Whether the expression leaves a way to use the work under permitted licences."""
    stack: list[bool] = []
    for word in postfix:
        if word in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(left and right if word == "and" else left or right)
        else:
            stack.append(word.rstrip("+") in permitted or word in exceptions)
    return bool(stack) and stack[-1]


RESULTS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "score double, expressions array<string>, permitted boolean"
)


def scan_licenses(
    df: DataFrame,
    text: str = "text",
    base: dict[str, str] = BASE_PHRASES,
    notices: dict[str, str] = NOTICE_PHRASES,
    permitted: Collection[str] = PERMITTED,
    keep: list[str] | None = None,
) -> DataFrame:
    """Licence evidence of every text.

    ``n_base`` counts all places of base phrases, overlapping ones included; ``first_word`` and
    ``last_word`` are their smallest and largest start (NULL without one). ``labels`` adds those of other
    notices and the identifiers of tag expressions. ``expressions`` holds the expressions as written and
    ``permitted`` whether all of them can be met by permitted licences (NULL without one). ``score`` is
    1 - 2^-e for e pieces of evidence, a tag counting twice. NULL and empty texts have no words and score
    0; repeated rows each get their result; input columns with a result's name are replaced.
    """
    base, notices, permitted = dict(base), dict(notices), frozenset(permitted)

    def make():
        automaton = PhraseAutomaton(
            (tuple(folded_words(p.encode())), (kind, label))
            for kind, table in (("base", base), ("notice", notices), ("tag", {TAG: ""}))
            for p, label in table.items()
        )

        def work(batch):
            rows = [_scan_text(raw, automaton, permitted) for raw in batch]
            return list(zip(*rows)) or [[]] * 9

        return work

    return map_texts(df, text, RESULTS, make, keep)


def _scan_text(raw: bytes | None, automaton: PhraseAutomaton, permitted: frozenset[str]) -> tuple:
    words = folded_words(raw)
    starts: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    tags: list[int] = []
    notices = 0
    for start, end, values in automaton.find(words):
        for kind, label in values:
            if kind == "tag":
                tags.append(end)
                continue
            labels.add(label)
            if kind == "base":
                starts.append(start)
                base_labels.add(label)
            else:
                notices += 1
    written, usable = [], []
    if tags:
        _, ends = folded_word_spans(raw)
        decoded = raw.decode()
        for end in tags:
            line = _AFTER_TAG.match(decoded, int(ends[end - 1]))
            postfix, expression = parse_expression(line[1]) if line else ([], "")
            if postfix:
                written.append(expression)
                usable.append(evaluate(postfix, permitted))
                labels.update(w for w in postfix if w not in _PRECEDENCE)
    evidence = len(starts) + notices + 2 * len(written)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base_labels), sorted(labels),
        1 - 0.5 ** min(evidence, 50), written, all(usable) if usable else None,
    )
