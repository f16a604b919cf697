"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import SPACES, aside, quoted, without

SYMBOLS = "[#*$%&|<>]"
#: Common words of the languages in which texts are expected.
STOP_WORDS = tuple(
    "the of and to in is that was for with "
    "der die das und den von zu mit nicht ein "
    "le la les des et est une dans que du "
    "el los las en por una con del se para".split()
)


@dataclass(frozen=True)
class Rule:
    """``measure`` has to lie in [at_least, at_most]; a NULL measure (nothing to divide by) passes."""

    measure: str
    at_least: float | None = None
    at_most: float | None = None

    def failed(self) -> Column:
        value = F.col(self.measure)
        bounds = [value < self.at_least] if self.at_least is not None else []
        bounds += [value > self.at_most] if self.at_most is not None else []
        return F.coalesce(reduce(lambda a, b: a | b, bounds, F.lit(False)), F.lit(False))


#: Bounds of running prose. Sound texts of any of the languages keep a wide distance from each.
RULES = (
    Rule("mean_word_chars", at_least=2.0, at_most=12.0),
    Rule("symbols_per_word", at_most=0.2),
    Rule("stop_word_ratio", at_least=0.01),
    Rule("dup_line_ratio", at_most=0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
RATIOS = ("mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio")
RESULTS = (*MEASURES, *RATIOS, "base_failed", "failed_rules", "kept")

# The hash of a window above and its position below share one number, so that numbers sort by hash.
# Texts beyond that many words, or with two hashes that only differ in the cut bits, sort pairs instead.
_POSITION_BITS = 24


def _window_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _covered(starts: Column) -> Column:
    """Words under three-word windows that begin at these ascending positions."""
    step = lambda at, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - at, F.lit(3)))
    return F.aggregate(F.transform(starts, step), F.lit(0), lambda a, b: a + b).cast("long")


def _repeated_starts_of_pairs(words: Column, positions: Column) -> Column:
    """Start positions of windows that occur twice, from sorted (hash, position) pairs."""
    pairs = F.sort_array(F.transform(positions, lambda i: F.struct(_window_hash(words, i).alias("h"), i.alias("i"))))
    is_twin = lambda s: lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])
    return let(pairs, lambda s: F.transform(F.filter(s, is_twin(s)), lambda x: x["i"]))


def measure(df: DataFrame, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``df`` with ``MEASURES`` and ``RATIOS`` of every whole text, all of them built-in expressions.

    Words are runs without ASCII white space. NULL and empty texts measure 0 and have NULL ratios.
    Columns with a result's name are replaced, others keep theirs. ``stop_words`` count as written and with a capital.
    """
    inward, outward = aside(without(df, list(RESULTS)))
    rows = df.select(*inward, F.coalesce(F.col(quoted(text)), F.lit("")).alias("_t"))
    # One byte per white space, then a plain split, costs a third of a split on a class.
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", F.col("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    rows = rows.withColumns({"_words": F.array_remove(F.split(spaced, " "), ""), "_lines": lines})
    w, n = F.col("_words"), F.size("_words")
    windows = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    cut = lambda h: F.shiftleft(F.shiftrightunsigned(h, _POSITION_BITS), _POSITION_BITS)
    rows = rows.withColumn("_packed", F.sort_array(F.transform(windows, lambda i: cut(_window_hash(w, i)).bitwiseOR(i.cast("long")))))
    p = F.col("_packed")
    # Places in the sorted numbers whose hash equals that of the place before.
    later = F.when(F.size(p) >= 2, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(
        "_twins", F.filter(later, lambda i: F.shiftrightunsigned(F.get(p, i).bitwiseXOR(F.get(p, i - 1)), _POSITION_BITS) == 0)
    )
    start = lambda i: F.get(p, i).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")
    t = F.col("_twins")
    doubt = F.exists(t, lambda i: _window_hash(w, start(i)) != _window_hash(w, start(i - 1)))
    rows = rows.withColumn(
        "_starts",
        F.sort_array(
            F.when((n >= 1 << _POSITION_BITS) | doubt, _repeated_starts_of_pairs(w, windows)).otherwise(
                F.array_distinct(F.concat(F.transform(t, start), F.transform(t, lambda i: start(i - 1))))
            )
        ),
    )
    either = [x for s in stop_words for x in dict.fromkeys((s, s.capitalize()))]
    measures = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _covered(F.col("_starts")),
        "n_lines": F.size("_lines"),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*either))),
    }
    # Generated columns: a filter on one of them cannot be pushed below and repeat the work per element.
    made = F.inline(F.array(F.struct(*[c.cast("long").alias(k) for k, c in measures.items()])))
    rows = rows.select(*[c for c in rows.columns if c.startswith("_kept_")], made)
    words = F.nullif(F.col("n_words"), F.lit(0))
    rows = rows.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words,
            "stop_word_ratio": F.col("n_stop_words") / words,
            "dup_line_ratio": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        }
    )
    return rows.select(*outward, *MEASURES, *RATIOS)


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``measure`` with the verdict: ``base_failed``, the measures of failed rules, and ``kept``.

    A text fails at the base when it has fewer than ``MIN_WORDS`` words, or when more than
    ``MAX_REPEAT_PERCENT`` percent of its words lie in three-word windows that occur twice; empty and
    NULL texts therefore fail. Repeated rows each get their verdict.
    """
    measured = measure(df, text, stop_words)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.measure)) for r in rules])) if rules else F.array().cast("array<string>")
    return measured.withColumns({"base_failed": base, "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )
