"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Every measure is a column expression over the text, its words and its lines; the table names a
measure and the range in which a document passes. There is no user function and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was with be on as by this an are from at or "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch "
    "le la les de des et un une du en que qui est pour dans au par sur pas plus avec "
    "el los las y del se por con no una su para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """Documents pass while ``low <= measure <= high`` (None: open)."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The base rules: their measures, and the limits a document must keep to be considered at all.
BASE_RULES = (Rule("n_words", low=50), Rule("repeat_word_ratio", high=0.5))

#: The method's rules. They are meant for junk: prose in any of the languages stays well inside.
RULES = (
    Rule("n_words", high=200_000),
    Rule("mean_word_length", low=2.0, high=14.0),
    Rule("symbol_word_ratio", high=0.4),
    Rule("n_stop_words", low=2),
    Rule("dup_line_ratio", high=0.5),
)


def measures(text: Column) -> list[dict[str, Column]]:
    """Measures in steps; those of a step may use the columns of the ones before."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    size = F.size("_words")
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    runs = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(3)]))
    return [
        {"_words": words, "_lines": with_word},
        {"_hashes": hashes},
        {"_runs": F.when(size >= 3, runs).otherwise(F.array().cast("array<bigint>"))},
        {"_repeats": F.size(F.array_distinct("_runs")) < F.size("_runs"), "_bits": F.ceil(F.log2(size + 1)).cast("int")},
        # Runs in the order of the leading bits of their hash; the other bits tell where they start.
        {"_sorted": F.when(F.col("_repeats"), F.sort_array(F.transform("_runs", _packed)))},
        # Where runs start that occur twice or more.
        {"_starts": F.sort_array(F.filter(F.transform("_sorted", _repeated), lambda p: p >= 0))},
        {
            "n_words": size.cast("long"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            # A start covers three words, or as many as there are up to the next start.
            "n_repeat_words": F.coalesce(
                F.aggregate(
                    F.transform("_starts", lambda p, i: F.least(F.coalesce(F.get("_starts", i + 1) - p, F.lit(3)), F.lit(3))),
                    F.lit(0).cast("long"),
                    lambda n, k: n + k,
                ),
                F.lit(0).cast("long"),
            ),
            "n_stop_words": F.size(
                F.array_intersect(F.transform("_words", F.lower), F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)]))
            ).cast("long"),
        },
        {
            "mean_word_length": F.try_divide("word_chars", "n_words"),
            "symbol_word_ratio": F.try_divide("n_symbols", "n_words"),
            "dup_line_ratio": F.try_divide("n_dup_lines", "n_lines"),
            "repeat_word_ratio": F.try_divide("n_repeat_words", "n_words"),
        },
    ]


def _cleared(value: Column) -> Column:
    return F.call_function("shiftleft", F.call_function("shiftright", value, F.col("_bits")), F.col("_bits"))


def _place(packed: Column) -> Column:
    return packed.bitwiseXOR(_cleared(packed)).cast("int")


def _packed(run: Column, i: Column) -> Column:
    return _cleared(run).bitwiseOR(i.cast("long"))


def _repeated(run: Column, j: Column) -> Column:
    """The start of the run if a neighbour has the same hash, else -1."""

    def same(other: Column) -> Column:
        near = _cleared(other) == _cleared(run)
        return F.coalesce(near & (F.get("_runs", _place(other)) == F.get("_runs", _place(run))), F.lit(False))

    before = F.get("_sorted", F.when(j > 0, j - 1))
    return F.when(same(before) | same(F.get("_sorted", j + 1)), _place(run)).otherwise(-1)


def verdict(rules: Sequence[Rule]) -> Column:
    """All rules as one condition. A measure without a value (no words, no lines) breaks no rule."""
    passed = F.lit(True)
    for rule in rules:
        value = F.col(rule.measure)
        if rule.low is not None:
            passed = passed & F.coalesce(value >= F.lit(rule.low), F.lit(True))
        if rule.high is not None:
            passed = passed & F.coalesce(value <= F.lit(rule.high), F.lit(True))
    return passed


def apply_rules(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES
) -> DataFrame:
    """``docs`` with all measures, ``base_failed`` and ``kept``.

    A null text has no words and no lines. Measures replace columns of the same name; others stay.
    """
    out = docs.withColumn("_whole", F.coalesce(F.col(text), F.lit("")))
    for step in measures(F.col("_whole")):
        out = out.withColumns(step)
    failed = ~verdict(base)
    return out.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules)}).drop(
        "_whole", "_words", "_lines", "_hashes", "_runs", "_repeats", "_bits", "_sorted", "_starts"
    )
