"""Personal data in texts: expressions propose, checksums confirm, nearby words decide.

Each kind has a regular expression that proposes spans, an optional check of the span
itself (Luhn, mod 97, ranges, numbers of digits), a score in per cent, and words that raise
the score when they stand close before or after the span. Base kinds are reported whatever
their score; further kinds only from `LEAST_SCORE` on, so that a bare nine-digit number is
nothing until a word next to it says what it is.

Everything is one column expression over the text: no text is moved, and each is read by a
kind's expression only if it holds a character without which that kind can't match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from deltascope.llm.common import let
from deltascope.llm.secrets import _before as running_lengths, either_case

LEAST_SCORE = 50
BOOST = 40
BEFORE, AFTER = 60, 30  # characters in which a context word counts, never beyond the neighbouring match of the kind

# fixed values: lengths of account numbers by country
IBAN_LENGTHS = {
    15: ("NO",), 16: ("BE",), 18: ("DK", "FI", "NL"), 20: ("AT", "EE", "LT", "LU"), 21: ("CH", "HR", "LI", "LV"),
    22: ("BG", "DE", "GB", "IE"), 24: ("CZ", "ES", "RO", "SE", "SK"), 25: ("PT",), 26: ("IS", "TR"), 27: ("FR", "GR", "IT"), 28: ("HU", "PL"),
}
_ACCOUNT = "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
ADDRESS_RANGE = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"


@dataclass(frozen=True)
class Kind:
    """`pattern` is what a kind means; `fast` matches the same spans with lookbehinds and possessive
    loops, which take linear time and no recursion however long the text."""

    name: str
    pattern: str
    needs: str  # one of these characters stands in every match
    score: int
    words: tuple[str, ...]
    check: Callable[[Column], Column] | None = None
    fast: str | None = None
    base: bool = False
    alone: bool = False  # no letter or digit may stand directly before or after

    def context(self) -> str:
        return "|".join(map(either_case, self.words))


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _weighted(number: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Sum of `step(digit, position)` over the digits, positions from 1."""
    each = F.sequence(F.lit(1), F.length(number))
    return F.aggregate(each, F.lit(0), lambda total, i: total + step(F.substr(number, i, F.lit(1)).cast("int"), i))


def luhn(number: Column) -> Column:
    """Every second digit from the right counts double, digit by digit; the sum is a multiple of ten."""
    def step(digit: Column, i: Column) -> Column:
        doubled = digit * 2
        return F.when((F.length(number) - i) % 2 == 0, digit).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    return _weighted(number, step) % 10 == 0


def mod_97(span: Column) -> Column:
    """Account numbers: the first four characters go behind, letters count from ten, the rest by 97 is one."""
    def turned(plain: Column) -> Column:
        return F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def rest(number: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            code = F.ascii(F.substr(number, i, F.lit(1)))
            return F.when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step)

    return let(turned(F.regexp_replace(span, " ", "")), rest) == 1


def _card(span: Column) -> Column:
    return let(digits(span), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _phone(span: Column) -> Column:
    return F.length(digits(span)).between(10, 15)


def _bank(span: Column) -> Column:
    """Weights 3, 7, 1 in turn; the sum is a multiple of ten."""
    weight = lambda d, i: d * F.element_at(F.array(F.lit(1), F.lit(3), F.lit(7)), (i % 3 + 1).cast("int"))
    return (_weighted(span, weight) % 10 == 0) & (span != "000000000")


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind(
        "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@", 60, ("mail", "contact", "write", "correo", "kontakt", "courriel"),
        fast=rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", base=True,
    ),
    Kind(
        "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", ".", 40, ("ip", "address", "host", "server", "login"),
        check=lambda s: s.rlike(ADDRESS_RANGE), fast=r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", base=True,
    ),
    Kind(
        "card", r"[0-9]([\x20-]?[0-9])+", "0123456789", 60, ("card", "credit", "visa", "tarjeta", "karte", "carte"),
        check=_card, fast=r"[0-9](?:[\x20-]?[0-9])++", base=True,
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 40, ("phone", "call", "mobile", "tel", "fax"), check=_phone, base=True),
    Kind("iban", _ACCOUNT, "0123456789", 60, ("iban", "account", "konto", "cuenta", "compte"), check=mod_97, alone=True),
    Kind("social", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 30, ("ssn", "social security", "tax id"), alone=True),
    Kind("bank", "[0-9]{9}", "0123456789", 30, ("routing", "aba", "bank"), check=_bank, alone=True),
    Kind("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", ".-", 30, ("phone", "call", "mobile", "tel", "fax"), alone=True),
)


def _spans(text: Column, kind: Kind, order: int) -> Column:
    pattern = kind.fast or kind.pattern

    def judged(hit: Column, before: Column, after: Column, start: Column) -> Column:
        near = F.right(before, F.lit(BEFORE)).rlike(kind.context()) | F.left(after, F.lit(AFTER)).rlike(kind.context())
        score = F.when(near, min(100, kind.score + BOOST)).otherwise(kind.score)
        fits = F.lit(True) if kind.check is None else kind.check(hit)
        if kind.alone:
            fits = ~F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left(after, F.lit(1)).rlike("[A-Za-z0-9]") & fits
        if not kind.base and kind.score < LEAST_SCORE:
            fits = fits & near
        return F.when(fits, F.struct(
            start.alias("start"), F.lit(order).alias("_order"), (start + F.length(hit)).alias("end"),
            F.lit(kind.name).alias("kind"), score.alias("score"),
        ))

    def located(found: Column) -> Column:
        gaps, hits = found["gaps"], found["hits"]
        sizes = F.transform(hits, lambda hit, i: (F.length(F.get(gaps, i)) + F.length(hit)).cast("long"))
        return let(running_lengths(sizes), lambda sums: F.array_compact(F.transform(
            hits, lambda hit, i: judged(hit, F.get(gaps, i), F.get(gaps, i + 1), F.get(sums, i) + F.length(F.get(gaps, i)))
        )))

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    possible = text.contains(kind.needs) if len(kind.needs) == 1 else text.rlike(f"[{kind.needs}]")
    empty = F.array().cast("array<struct<start:bigint,_order:int,end:bigint,kind:string,score:int>>")
    return F.coalesce(F.when(possible & text.rlike(pattern), let(found, located)), empty)


def find_personal_data(docs: DataFrame, text_column: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per row of `docs`: its columns in the struct `_doc`, and `spans` of kind, start, end and score.

    Spans are in code points, `end` exclusive, by start, then in the order of the kinds;
    those of different kinds may overlap. Within a kind matches are leftmost and do not
    overlap; one that fails its check is dropped and not tried again in part.

    Null text counts as empty and has no spans. Repeated rows and rows that share an id are
    searched each by itself; ids are not looked at. Very long texts are searched whole, in
    time that grows with their length. Extra columns stay inside the struct and can't
    clash. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    # one value worked out once: a filter on the spans pays for them no more than twice
    found = let(text, lambda t: F.transform(
        F.sort_array(F.concat(*[_spans(t, kind, i) for i, kind in enumerate(kinds)])),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")),
    ))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), found.alias("spans"))
