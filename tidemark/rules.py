"""Rules as data: anchors, categories, named entities, low-value patterns, heading map.

A rule set is configuration. It comes from a plain mapping (parsed YAML or JSON) and is turned
into literals of the plan; no keyword lives in the code of the operators.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from .functions.text import SEPARATORS

# Suffixes a term may carry, and the reason given to records without an anchor.
INFLECTIONS = ("", "s", "es", "ed", "ing")
NO_ANCHOR_REASON = "No vision-language domain anchor in upstream text."


def fold_term(term: str) -> str:
    """A rule term in the folded form of ``functions.text.normalize``."""
    ascii_text = unicodedata.normalize("NFKD", term).encode("ascii", "ignore").decode("ascii")
    return " ".join(re.sub(SEPARATORS, " ", ascii_text.lower()).split())


def fold_terms(terms: Iterable[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in map(fold_term, terms) if t))


def term_pattern(term: str) -> str:
    """Regex of a folded term: alphanumeric boundaries and an optional inflection."""
    suffix = "|".join(s for s in INFLECTIONS if s)
    return rf"(?<![a-z0-9]){re.escape(term)}(?:{suffix})?(?![a-z0-9])"


def guide_tokens(term: str) -> tuple[tuple[str, ...], bool]:
    """Tokens of which a text must hold one to match the term, and whether that suffices.

    A term of one alphanumeric run matches exactly the texts holding that token or an inflected
    form. Otherwise the longest inner run must appear as a token and the pattern decides.
    """
    runs = re.findall(r"[a-z0-9]+", term)
    if runs == [term]:
        return tuple(term + s for s in INFLECTIONS), True
    if not runs:
        return (), False
    whole = runs[:-1] if term.endswith(runs[-1]) else runs
    if whole:
        return (max(whole, key=len),), False
    return tuple(runs[-1] + s for s in INFLECTIONS), False


@dataclass(frozen=True)
class Category:
    key: str
    label: str
    terms: tuple[str, ...]
    blurb: str = ""


@dataclass(frozen=True)
class Entity:
    """A model family (with ``org``) or a watch-list entry (with ``note``)."""

    name: str
    terms: tuple[str, ...]
    org: str = ""
    note: str = ""


@dataclass(frozen=True)
class LowValueRule:
    pattern: str
    reason: str
    action: str

    @property
    def java_pattern(self) -> str:
        # Word characters, boundaries and case folding are Unicode-aware in rule patterns.
        return "(?U)" + self.pattern


@dataclass(frozen=True)
class RuleSet:
    anchors: tuple[str, ...] = ()
    categories: tuple[Category, ...] = ()
    families: tuple[Entity, ...] = ()
    watchlist: tuple[Entity, ...] = ()
    low_value: tuple[LowValueRule, ...] = ()
    heading_categories: tuple[tuple[str, tuple[str, ...]], ...] = ()
    minimum_hits: int = 1
    labels: dict[str, str] = field(default_factory=dict, compare=False)

    @classmethod
    def from_config(cls, config: Mapping) -> "RuleSet":
        """Build from the ``domain / taxonomy / model_families / watchlist / low_value`` blocks."""
        domain = config.get("domain") or {}
        categories = []
        for key, spec in (config.get("taxonomy") or {}).items():
            spec = spec or {}
            label = spec.get("label") or key.replace("_", " ").title()
            categories.append(Category(key, label, fold_terms(spec.get("terms") or ()), spec.get("blurb") or ""))

        def entities(block: str) -> tuple[Entity, ...]:
            return tuple(
                Entity(e["name"], fold_terms([e["name"], *(e.get("aliases") or ())]), e.get("org", ""), e.get("note", ""))
                for e in (config.get(block) or ())
                if e.get("name")
            )

        low = config.get("low_value") or {}
        rules = tuple(
            LowValueRule(r["pattern"], r.get("reason") or f"Matched {action} rule", action)
            for action in ("demote", "suppress")
            for r in (low.get(action) or ())
            if r.get("pattern")
        )
        headings = tuple(
            (fold_term(str(needle)), tuple(keys or ()))
            for needle, keys in (config.get("heading_categories") or {}).items()
            if fold_term(str(needle))
        )
        return cls(
            anchors=fold_terms(domain.get("anchors") or ()),
            categories=tuple(categories),
            families=entities("model_families"),
            watchlist=entities("watchlist"),
            low_value=rules,
            heading_categories=headings,
            minimum_hits=max(0, int(domain.get("minimum_hits", 1))),
            labels={c.key: c.label for c in categories},
        )
