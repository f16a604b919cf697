"""Aho-Corasick over word sequences."""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick


class PhraseAutomaton:
    """Finds phrases whose words stand consecutively, overlapping ones included.

    The alphabet is the words of the phrases; any other word is symbol 0 and ends every match.
    """

    def __init__(self, phrases: Iterable[tuple[tuple[bytes, ...], object]]):
        self.symbols: dict[bytes, int] = {}
        values: dict[tuple[int, ...], tuple[int, list]] = {}
        for words, value in phrases:
            if not words:
                continue
            key = tuple(self.symbols.setdefault(w, len(self.symbols) + 1) for w in words)
            values.setdefault(key, (len(key), []))[1].append(value)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, value in values.items():
            self.automaton.add_word(key, value)
        self.automaton.make_automaton()
        self.empty = not values

    def find(self, words: list[bytes]) -> list[tuple[int, int, list]]:
        """(first word, end word, values) of every place, by end."""
        if self.empty or not words or self.symbols.keys().isdisjoint(words):
            return []
        get = self.symbols.get
        line = tuple([get(w, 0) for w in words])
        return [(last + 1 - n, last + 1, values) for last, (n, values) in self.automaton.iter(line)]
