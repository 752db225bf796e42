"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Everything is built-in column code. For each kind, a text that can hold a match (one cheap test) is cut
by the pattern: the matches and the gaps between them give the code-point places as running sums, and
the ends of the gaps are the context. Patterns never retry inside a run of their characters (possessive
quantifiers, and look-behind for starts), so a long run costs no more than its length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters on either side in which context words count.
CONTEXT = 40

#: Spans of kinds that are not base kinds need this score.
ACCEPT = 0.5

#: What a context word adds to the score.
CONTEXT_BOOST = 0.3

#: Matches whose places are summed up in one go; longer lists are done block by block.
BLOCK = 256

SPAN = "struct<start:bigint,end:bigint,score:double,ok:boolean>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code of letters and digits leaves 1 when divided by 97 (ISO 7064)."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def add(rest: Column, sign: Column) -> Column:
        value = F.conv(sign, 36, 10).cast("int")
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), add) == 1


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))


def _iban(match: Column) -> Column:
    return mod97(F.replace(match, F.lit(" "), F.lit("")))


#: Letters and digits of an account code after its first four, by country (ISO 13616 registry).
IBAN_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK FI FO FK GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV",
    18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG",
    21: "LY PT ST", 22: "IS TR", 23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}


def _iban_pattern() -> str:
    """The country fixes the length, so what follows a code is never taken into it. Codes of other countries
    are as long as they can be, but end before one of a listed country."""
    known = "(?:" + "|".join(" ".join(IBAN_LENGTHS.values()).split()) + ")[0-9]{2}"
    fixed = [rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}+" for n, c in IBAN_LENGTHS.items()]
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{known})\x20?[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*fixed, other])})(?![A-Za-z0-9])"


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``possible`` is a test that all texts with a match pass. ``prior`` is the score of a confirmed match
    without context. Confirmed matches of base kinds are always reported.
    """

    name: str
    pattern: str
    possible: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    base: bool = True
    prior: float = 0.6
    context: tuple[str, ...] = field(default=())


# The four base patterns are given; written here so that no position is tried twice. A start inside a
# run of the first class is only possible where the match before ended (\G).
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")),
        lambda m: F.lit(True),
        prior=0.8,
        context=("mail", "contact", "write"),
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        context=("ip", "host", "server", "address"),
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        _card,
        prior=0.7,
        context=("card", "visa", "master", "credit", "karte", "tarjeta", "carte"),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: F.contains(t, F.lit("+")),
        lambda m: F.length(_digits(m)).between(8, 15),
        prior=0.6,
        context=("phone", "tel", "call", "mobile"),
    ),
    Kind(
        "iban",
        _iban_pattern(),
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}"),
        _iban,
        base=False,
        prior=0.8,
        context=("iban", "bank", "account", "konto"),
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda m: F.lit(True),
        base=False,
        prior=0.3,
        context=("ssn", "social security"),
    ),
)


def _candidates(kind: Kind) -> Column:
    """Per match: the gap before it, its length, its score and whether it is confirmed."""

    def one(match: Column, i: Column) -> Column:
        score = F.lit(kind.prior)
        if kind.context:
            near = F.concat(F.right(F.get("_gaps", i), F.lit(CONTEXT)), F.lit(" "), F.left(F.get("_gaps", i + 1), F.lit(CONTEXT)))
            words = "|".join(kind.context)
            score += F.when(F.lower(near).rlike(rf"\b(?:{words})"), CONTEXT_BOOST).otherwise(0.0)
        return F.struct(
            F.length(F.get("_gaps", i)).cast("long").alias("gap"),
            F.length(match).cast("long").alias("n"),
            score.alias("score"),
            kind.confirm(match).alias("ok"),
        )

    return F.transform("_matches", one)


def _placed(candidates: Column) -> Column:
    """Candidates as spans: running sums of gaps and lengths, ``BLOCK`` at a time."""
    state = f"struct<at:bigint,out:array<{SPAN}>>"
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, c: Column) -> Column:
        start = acc["at"] + c["gap"]
        span = F.struct(start.alias("start"), (start + c["n"]).alias("end"), c["score"].alias("score"), c["ok"].alias("ok"))
        return F.struct((start + c["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out")).cast(state)

    def block(done: Column, own: Column) -> Column:
        begin = F.struct(F.element_at(done, -1)["at"].alias("at"), none.alias("out")).cast(state)
        return F.concat(done, F.array(F.aggregate(own, begin, step))).cast(f"array<{state}>")

    last = ((F.size(candidates) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(candidates, b * BLOCK + 1, BLOCK))
    begin = F.array(F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))).cast(f"array<{state}>")
    done = F.aggregate(blocks, begin, block)
    return F.when(F.size(candidates) > 0, F.flatten(F.transform(done, lambda x: x["out"]))).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """``docs`` with ``pii``: an array of (kind, base, start, end, score) by kind, then start.

    Places are code points, end exclusive. Null and empty texts have none; repeated rows are judged one
    by one. A column ``pii`` of the input is replaced, other columns stay.
    """
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for k, kind in enumerate(kinds):
        possible = kind.possible(F.col("_text"))
        out = out.withColumns(
            {
                "_matches": F.when(possible, F.regexp_extract_all("_text", F.lit(kind.pattern), F.lit(0))),
                "_gaps": F.when(possible, F.split("_text", kind.pattern)),
            }
        )
        out = out.withColumn("_candidates", _candidates(kind))
        named = F.transform(F.filter(_placed(F.col("_candidates")), _reported(kind)), _named(kind))
        empty = F.array().cast("array<struct<kind:string,base:boolean,start:bigint,end:bigint,score:double>>")
        out = out.withColumn(f"_spans{k}", F.coalesce(named, empty)).drop("_matches", "_gaps", "_candidates")
    every = [f"_spans{k}" for k in range(len(kinds))]
    return out.withColumn("pii", F.concat(*every)).drop("_text", *every)


def _reported(kind: Kind) -> Callable[[Column], Column]:
    return lambda span: span["ok"] if kind.base else span["ok"] & (span["score"] >= ACCEPT)


def _named(kind: Kind) -> Callable[[Column], Column]:
    name, base = F.lit(kind.name).alias("kind"), F.lit(kind.base).alias("base")
    return lambda span: F.struct(name, base, span["start"], span["end"], span["score"])


def of_kind(name: str) -> Column:
    return F.filter("pii", lambda span: span["kind"] == name)


def span_list(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(found: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every character of a span replaced by ``*``; overlapping spans are one.

    Offsets of the remaining characters don't change.
    """
    inside = F.array_distinct(F.flatten(F.transform("pii", lambda s: F.sequence(s["start"], s["end"] - 1))))
    signs = F.split(F.col(text), "")
    shown = F.when(F.size("pii") > 0, F.array_join(F.transform(signs, lambda c, i: F.when(F.array_contains("_inside", i.cast("long")), "*").otherwise(c)), ""))
    return found.withColumn("_inside", inside).withColumn(text, F.coalesce(shown, F.col(text))).drop("_inside")
