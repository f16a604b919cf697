"""Matching records against rule sets and rule tables.

Rule sets of configuration size become literals of one expression, so matching is a projection:
no shuffle, no regex per term and row. The text is split into tokens once, intersected with the
tokens that can start a match, and only terms of several words are confirmed by their pattern.
Rule *tables* (large vocabularies) go through a positional join of tokens instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import (
    computed, constant, empty_strings, let, literal_map, literal_strings, ordered_union, strings,
)
from ..functions.text import normalize, title_case
from ..plans.storage import broadcast_if_small, stored
from ..rules import INFLECTIONS, NO_ANCHOR_REASON, LowValueRule, RuleSet, guide_tokens, term_pattern

#: Words of rules, or places asked for, some 60 bytes each, that may be broadcast.
BROADCAST_WORDS = 250_000

_RULE = "array<struct<kind:string,ord:int,name:string,term:string,guides:array<string>,pattern:string>>"
_HIT = "array<struct<kind:string,ord:int,name:string,term:string>>"


def _rule_rows(rules: RuleSet) -> list[tuple[str, int, str, str]]:
    rows = [("anchor", 0, "", t) for t in rules.anchors]
    rows += [("category", i, c.key, t) for i, c in enumerate(rules.categories) for t in c.terms]
    rows += [("family", i, e.name, t) for i, e in enumerate(rules.families) for t in e.terms]
    rows += [("watch", i, e.name, t) for i, e in enumerate(rules.watchlist) for t in e.terms]
    return rows


def rule_hits(text: Column, rules: RuleSet) -> Column:
    """All rule terms found in a folded text, in rule order, as an array of structs."""
    rows = _rule_rows(rules)
    if not rows:
        return F.array().cast(_HIT)
    specs, guides = [], set()
    for kind, ordinal, name, term in rows:
        tokens, enough = guide_tokens(term)
        guides.update(tokens)
        pattern = None if enough else term_pattern(term)
        specs.append({"kind": kind, "ord": ordinal, "name": name, "term": term, "guides": tokens, "pattern": pattern})
    table = constant(specs, _RULE)
    known = literal_strings(sorted(guides))

    def matched(present: Column) -> Column:
        def hit(rule: Column) -> Column:
            guided = F.arrays_overlap(present, rule["guides"]) | (F.size(rule["guides"]) == 0)
            return guided & (rule["pattern"].isNull() | F.coalesce(F.rlike(text, rule["pattern"]), F.lit(False)))

        found = F.filter(table, hit)
        return F.transform(found, lambda r: F.struct(r["kind"], r["ord"], r["name"], r["term"]))

    tokens = F.array_intersect(F.split(text, "[^a-z0-9]+"), known)
    return let(tokens, matched).cast(_HIT)


def _names(hits: Column, kind: str, field: str) -> Column:
    found = F.filter(hits, lambda h: h["kind"] == kind)
    return F.array_distinct(F.transform(found, lambda h: h[field]))


def _lookup(keys: Column, table: dict[str, str]) -> Column:
    """Values of a small literal map for each key that has a non-empty one."""
    table = {k: v for k, v in table.items() if v}
    if not table:
        return empty_strings()
    literal = literal_map(table)
    return F.array_compact(F.transform(keys, lambda k: F.try_element_at(literal, k)))


def _hit_columns(df: DataFrame, rules: RuleSet, text_col: str, columns) -> DataFrame:
    """Add columns derived from the hits of ``rules``, with the hits computed once per row."""
    sample = columns(F.array().cast(_HIT))
    row = let(rule_hits(F.col(text_col), rules), lambda hits: F.struct(*[c.alias(n) for n, c in columns(hits).items()]))
    return computed(df, row, sample)


def match_terms(df: DataFrame, rules: RuleSet, text_col: str = "match_text") -> DataFrame:
    """Add ``anchors``, ``categories`` and ``matched_terms`` in rule order.

    Hinted categories (column ``hint_categories``, when present) follow the inferred ones.
    """

    def columns(hits: Column) -> dict[str, Column]:
        categories = _names(hits, "category", "name")
        if "hint_categories" in df.columns:
            categories = ordered_union(categories, F.col("hint_categories"))
        return {
            "anchors": _names(hits, "anchor", "term"),
            "categories": categories,
            "matched_terms": _names(hits, "category", "term"),
        }

    only = RuleSet(anchors=rules.anchors, categories=rules.categories)
    return _hit_columns(df, only, text_col, columns)


def match_entities(df: DataFrame, rules: RuleSet, text_col: str = "match_text") -> DataFrame:
    """Add ``model_families`` and append the organisation of each hit to ``organizations``."""

    def columns(hits: Column) -> dict[str, Column]:
        families = _names(hits, "family", "name")
        orgs = _lookup(families, {e.name: e.org for e in rules.families})
        return {"model_families": families, "organizations": _append_missing(F.col("organizations"), orgs)}

    return _hit_columns(df, RuleSet(families=rules.families), text_col, columns)


def match_watchlist(df: DataFrame, rules: RuleSet, text_col: str = "match_text") -> DataFrame:
    """Add ``watchlist`` and ``watchlist_notes``."""

    def columns(hits: Column) -> dict[str, Column]:
        names = _names(hits, "watch", "name")
        return {"watchlist": names, "watchlist_notes": _lookup(names, {e.name: e.note for e in rules.watchlist})}

    return _hit_columns(df, RuleSet(watchlist=rules.watchlist), text_col, columns)


def _append_missing(base: Column, extra: Column) -> Column:
    base = strings(base)
    return F.concat(base, F.array_except(extra, base))


def _reasons(rules: Sequence[LowValueRule], action: str, raw: Column) -> Column:
    hits = [F.when(raw.rlike(r.java_pattern), F.lit(r.reason)) for r in rules if r.action == action]
    return F.array_compact(F.array(*hits)) if hits else empty_strings()


def match_low_value(df: DataFrame, rules: Sequence[LowValueRule], raw_col: str = "raw_text") -> DataFrame:
    """Add ``demotions``, ``demotion_reasons`` and ``suppression_reasons`` from raw-text rules."""
    raw = F.col(raw_col)
    row = let(
        _reasons(rules, "demote", raw),
        lambda demoted: F.struct(
            demoted.alias("demotion_reasons"),
            F.size(demoted).alias("demotions"),
            F.array_distinct(_reasons(rules, "suppress", raw)).alias("suppression_reasons"),
        ),
    )
    return computed(df, row, ("demotion_reasons", "demotions", "suppression_reasons"))


def match_records(
    df: DataFrame, rules: RuleSet, text_col: str = "match_text", raw_col: str = "raw_text"
) -> DataFrame:
    """All rule columns of a record in one pass over its text."""
    raw = F.col(raw_col)

    def columns(hits: Column) -> dict[str, Column]:
        anchors, families, watch = _names(hits, "anchor", "term"), _names(hits, "family", "name"), _names(hits, "watch", "name")
        orgs = _lookup(families, {e.name: e.org for e in rules.families})
        no_anchor = F.when(F.size(anchors) == 0, F.array(F.lit(NO_ANCHOR_REASON))).otherwise(empty_strings())
        suppressed = F.array_distinct(_reasons(rules.low_value, "suppress", raw))
        return {
            "anchors": anchors,
            "categories": ordered_union(_names(hits, "category", "name"), F.col("hint_categories")),
            "matched_terms": _names(hits, "category", "term"),
            "model_families": families,
            "organizations": _append_missing(F.col("organizations"), orgs),
            "watchlist": watch,
            "watchlist_notes": _lookup(watch, {e.name: e.note for e in rules.watchlist}),
            "pinned": F.exists(hits, lambda h: h["kind"].isin("family", "watch")),
            "demotion_reasons": _reasons(rules.low_value, "demote", raw),
            "suppression_reasons": F.concat(suppressed, no_anchor),
        }

    return _hit_columns(df, rules, text_col, columns).withColumn("demotions", F.size("demotion_reasons"))


def domain_gate(df: DataFrame, rules: RuleSet, text_col: str = "match_text", minimum: int = 1) -> DataFrame:
    """Add ``anchors``, ``in_domain`` and the reason of records without enough anchors."""
    gated = match_terms(df, RuleSet(anchors=rules.anchors), text_col).drop("categories", "matched_terms")
    return gated.withColumn("in_domain", F.size("anchors") >= minimum).withColumn(
        "domain_reason", F.when(~F.col("in_domain"), F.lit(NO_ANCHOR_REASON))
    )


def suppress(df: DataFrame, rules: Sequence[LowValueRule], raw_col: str = "raw_text") -> DataFrame:
    """Add ``suppression_reasons`` and ``suppressed``."""
    judged = match_low_value(df, rules, raw_col).drop("demotions", "demotion_reasons")
    return judged.withColumn("suppressed", F.size("suppression_reasons") > 0)


def _term_variants(terms: DataFrame) -> DataFrame:
    """(variant, rule, category, cat_ord, term, term_ord, words) of folded rule terms.

    ``words`` are the term's runs of letters and digits with the forms each may take, and what has to stand before
    it; ``lead`` and ``trail`` are characters of the term before its first and after its last run. The last run may be
    inflected; where other characters end the term, a second variant has the inflection as a run of its own.
    """
    folded = terms.withColumn("term", normalize(F.col("term"))).where("term <> ''").dropDuplicates(["category", "term"])
    runs, gaps = F.regexp_extract_all("term", F.lit("([a-z0-9]+)")), F.split("term", "[a-z0-9]+", -1)
    rule = F.monotonically_increasing_id().alias("rule")
    cut = folded.where(F.size(runs) > 0).select(rule, "category", "cat_ord", "term", "term_ord", runs.alias("runs"), gaps.alias("gaps"))
    last, trail = F.size("runs") - 1, F.element_at("gaps", -1)
    forms = F.array(*map(F.lit, INFLECTIONS))
    suffixes = F.array(*[F.lit(s) for s in INFLECTIONS if s])

    def word(run: Column, i: Column) -> Column:
        inflected = F.when((i == last) & (trail == ""), F.transform(forms, lambda s: F.concat(run, s))).otherwise(F.array(run))
        lead, end = F.when(i == 0, F.get("gaps", F.lit(0))).otherwise(""), F.when(i == last, trail).otherwise("")
        return F.struct(inflected.alias("forms"), F.get("gaps", i).alias("gap"), lead.alias("lead"), end.alias("trail"))

    words = F.transform("runs", word)
    open_end = F.transform(words, lambda w: w.withField("trail", F.lit("")))
    suffix = F.struct(suffixes.alias("forms"), trail.alias("gap"), F.lit("").alias("lead"), F.lit("").alias("trail"))
    both = F.when(trail == "", F.array(words)).otherwise(F.array(words, F.concat(open_end, F.array(suffix))))
    variants = cut.select("rule", "category", "cat_ord", "term", "term_ord", F.explode(both).alias("words"))
    return variants.withColumn("variant", F.monotonically_increasing_id())


def _known_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """(row, id, pos, word, before, after, more) of every token that some rule has, with the characters around it."""
    runs, gaps = F.regexp_extract_all(text_col, F.lit("([a-z0-9]+)")), F.split(text_col, "[a-z0-9]+", -1)
    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), runs.alias("runs"), gaps.alias("gaps"))
    n = F.size("runs")
    tokens = texts.where(n > 0).select(
        "row", "id", n.alias("n"),
        F.posexplode(F.arrays_zip(F.col("runs").alias("word"), F.slice("gaps", 1, n).alias("before"), F.slice("gaps", 2, n).alias("after"))).alias("pos", "t"),
    )
    tokens = tokens.select("row", "id", "pos", "t.word", "t.before", "t.after", (F.col("pos") < F.col("n") - 1).alias("more"))
    return tokens.join(vocabulary, "word", "left_semi")


#: Whether a token stands as a rule's word asks: after the same characters as in the term, and with the characters
#: around the term that are not letters or digits themselves, which need a border beyond them.
_STANDS = """(at = 0 OR before = gap)
    AND (lead = '' OR endswith(before, lead) AND (length(before) > length(lead) OR pos = 0))
    AND (trail = '' OR startswith(after, trail) AND (length(after) > length(trail) OR NOT more))"""


def match_term_table(df: DataFrame, terms: DataFrame, id_col: str, text_col: str = "match_text") -> DataFrame:
    """Hits of a rule *table* ``(category, cat_ord, term, term_ord)`` on folded texts.

    One row per (record, category, term). A positional phrase join: texts are split once into tokens with their
    places, of which those are kept that occur in a rule. Every term is joined on its rarest word, as counted in
    these texts, so frequent words are looked at only beside a rare one; for each such place the other words
    are asked for at theirs, by an equi-join on (text, place, word), and a term is found where all of them stand.
    Texts are in no shuffle and no pattern is compiled per row. NULL texts have no hits; repeated ids are texts of
    their own; terms without a letter or digit never match.
    """
    variants = stored(_term_variants(terms), "variants")
    words = variants.select("variant", "rule", F.size("words").alias("of"), F.posexplode("words").alias("at", "w")).select(
        "variant", "rule", "of", "at", F.explode("w.forms").alias("word"), "w.gap", "w.lead", "w.trail"
    )
    words = stored(words, "words")
    vocabulary = stored(words.select("word").distinct(), "vocabulary")
    known = stored(_known_tokens(df, id_col, text_col, broadcast_if_small(vocabulary, BROADCAST_WORDS)), "tokens")
    counts = stored(known.groupBy("word").count(), "counts")
    # A word that no text has, in any of its forms, rules its terms out.
    each = words.join(broadcast_if_small(counts, BROADCAST_WORDS), "word", "left").groupBy("variant", "at").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    rarest = each.groupBy("variant").agg(F.min(F.struct("n", "at")).alias("r")).where("r.n > 0").select("variant", F.col("r.at").alias("at"))
    anchors = stored(words.join(rarest, ["variant", "at"]), "anchors")
    hits = known.join(broadcast_if_small(anchors, BROADCAST_WORDS), "word").where(_STANDS).where("pos >= at")
    hits = stored(hits.select("variant", "rule", "of", "row", "id", F.col("at").alias("anchor"), (F.col("pos") - F.col("at")).alias("start")), "places")
    asked = hits.where("of > 1").join(words.drop("of", "rule"), "variant").where("at <> anchor")
    asked = asked.select("variant", "rule", "of", "row", "start", (F.col("start") + F.col("at")).alias("pos"), "word", "at", "gap", "lead", "trail")
    asked = broadcast_if_small(stored(asked, "asked"), BROADCAST_WORDS)
    met = known.join(asked, ["row", "pos", "word"]).where(_STANDS).groupBy("variant", "rule", "of", "row", "id", "start").agg(F.count("*").alias("n"))
    found = hits.where("of = 1").select("rule", "id").unionByName(met.where("n = of - 1").select("rule", "id")).distinct()
    rules = variants.select("rule", "category", "cat_ord", "term", "term_ord").distinct()
    return found.join(rules, "rule").select(F.col("id").alias(id_col), "category", "cat_ord", "term", "term_ord")


def heading_categories(trail: Column, rules: RuleSet) -> Column:
    """Categories of every heading rule whose needle occurs in a heading trail, in rule order."""
    if not rules.heading_categories:
        return empty_strings()
    rows = [{"needle": needle, "keys": keys} for needle, keys in rules.heading_categories]
    table = constant(rows, "array<struct<needle:string,keys:array<string>>>")
    return let(
        normalize(trail),
        lambda text: F.array_distinct(
            F.flatten(F.transform(F.filter(table, lambda r: F.contains(text, r["needle"])), lambda r: r["keys"]))
        ),
    )


def with_heading_categories(df: DataFrame, rules: RuleSet, trail_col: str = "trail") -> DataFrame:
    return df.withColumn("hint_categories", heading_categories(F.col(trail_col), rules))


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """Published label of a category key, else the key in title case."""
    if not labels:
        return title_case(key)
    return F.coalesce(F.try_element_at(literal_map(labels), key), title_case(key))


def with_labels(df: DataFrame, rules: RuleSet, key_col: str = "category", out: str = "label") -> DataFrame:
    return df.withColumn(out, label_of(F.col(key_col), rules.labels))
