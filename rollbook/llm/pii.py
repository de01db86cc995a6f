"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

#: Letters that can stand in an address before its @.
_LOCAL = "A-Za-z0-9._%+-"
#: A part of an address of at most 255, leading zeros allowed.
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The checksum of payment cards: every second digit from the right doubled, digit sums a multiple of ten."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, place: Column) -> Column:
        d = F.substring(digits, place, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((F.length(digits) - place) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """The checksum of international account numbers: first four moved to the end, letters as 10 to 35, remainder 1."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(rest: Column, place: Column) -> Column:
        code = F.ascii(F.substring(turned, place, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), step) == 1


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


@dataclass(frozen=True)
class Finder:
    """A pattern that never overlaps itself, the texts worth searching, a validator, and a score.

    `worth` must hold for every text with a match. `context` are words that raise the score of a span with one of them
    within 40 characters; a base span stays whatever its score.
    """

    kind: str
    pattern: str
    worth: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


# Each pattern finds what the plain form in the comment finds, without that form's repeated attempts inside a long run:
# a match can only begin where its first run of characters begins, or where the last match ended.
FINDERS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Finder("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda s: F.lit(True), 0.9, "mail|contact|write"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Finder("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", lambda s: s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.7, "ip|host|server|address"),
    # [0-9]([\x20-]?[0-9])+
    Finder("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", lambda s: let(_digits(s), lambda d: _between(F.length(d), 16, 19) & luhn(d)), 0.8, "card|visa|credit|pay"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Finder("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda s: _between(F.length(_digits(s)), 8, 15), 0.7, "phone|tel|call|mobile|fax"),
    # Spans beyond the base ones: shorter cards and national numbers need a context word, account numbers their checksum.
    Finder("card", r"(?<![A-Za-z0-9+.\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[A-Za-z0-9])|(?<=[a-z:,]\x20)[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9]|[A-Za-z])", "[0-9]", lambda s: luhn(_digits(s)), 0.5, "card|visa|amex|credit", False),
    Finder("phone", r"(?<![A-Za-z0-9+@.])(?<![0-9+][\x20().-]{1,4})\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9]|[A-Za-z@])", "[0-9]{4}", lambda s: F.lit(True), 0.4, "phone|tel|call|mobile|fax", False),
    Finder("iban", r"(?<![A-Za-z0-9._%+@-])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9@])", "[A-Z]{2}[0-9]{2}[A-Z0-9]", mod97, 0.9, "iban|account|bank", False),
)
KINDS = ("email", "ip", "card", "phone", "iban")
_ACCEPT, _RAISE = 0.75, 0.35
_SPAN = "array<struct<kind:int,start:bigint,stop:bigint,score:double,base:boolean>>"


def _pieces(text: Column, finder: Finder, body: Callable[[Column, Column, Column], Column], nothing: Column) -> Column:
    """`body` of the matches, the gaps around them and each match's verdict score (null: refused); `nothing` where none is possible."""
    hit = F.instr(text, finder.worth) > 0 if len(finder.worth) == 1 else text.rlike(finder.worth)
    found = F.regexp_extract_all(text, F.lit(finder.pattern), F.lit(0))

    def scored(matches: Column) -> Column:
        def score(gaps: Column) -> Column:
            def one(match: Column, k: Column) -> Column:
                near = F.lower(F.concat_ws(" ", F.right(F.get(gaps, k), F.lit(40)), F.left(F.get(gaps, k + 1), F.lit(40))))
                total = F.lit(finder.score) + F.when(near.rlike(rf"\b(?:{finder.context})"), _RAISE).otherwise(0.0)
                ok = finder.valid(match) if finder.base else finder.valid(match) & (total >= _ACCEPT)
                return F.when(ok, F.least(total, F.lit(1.0)))

            return let(F.transform(matches, one), lambda s: body(matches, gaps, s))

        return let(F.split(text, finder.pattern, -1), score)

    return F.when(hit, let(found, lambda m: F.when(F.size(m) > 0, scored(m)).otherwise(nothing))).otherwise(nothing)


def _spans(text: Column, finder: Finder) -> Column:
    nothing = F.array().cast(_SPAN)

    def body(matches: Column, gaps: Column, scores: Column) -> Column:
        lengths = F.transform(matches, lambda m, k: (F.length(F.get(gaps, k)) + F.length(m)).cast("long"))

        def spans(stops: Column) -> Column:
            rows = F.transform(
                matches,
                lambda m, k: F.struct(
                    F.lit(KINDS.index(finder.kind)).alias("kind"),
                    (F.get(stops, k) - F.length(m)).cast("long").alias("start"),
                    F.get(stops, k).alias("stop"),
                    F.get(scores, k).alias("score"),
                    F.lit(finder.base).alias("base"),
                ),
            )
            return F.filter(rows, lambda s: s["score"].isNotNull()).cast(_SPAN)

        return let(running_sums(lengths), spans)

    return _pieces(text, finder, body, nothing)


def spans(text: Column) -> Column:
    """All accepted spans of a text, by kind and start: array of (kind, start, stop, score, base) in code points, stop exclusive."""
    text = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_spans(text, f) for f in FINDERS]))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def _count(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame) -> DataFrame:
    """Personal data per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores.

    The counts and the hash hold the base spans; `spans` and `scores` hold also the spans that the method adds (cards of
    13 to 15 digits and national phone numbers near a context word, account numbers by mod-97). Null and empty texts
    have none. Repeated rows and rows without id all return; an empty table gives an empty result; extra columns are ignored.
    """
    def row(found: Column) -> Column:
        return let(
            F.filter(found, lambda s: s["base"]),
            lambda base: F.struct(
                *[_count(base, k).alias(f"n_{KINDS[k]}") for k in range(4)],
                F.sha2(_joined(base), 256).alias("base_sha256"),
                _joined(found).alias("spans"),
                F.array_join(F.transform(found, lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
            ),
        )

    return docs.select("doc_id", let(spans(docs["text"]), row).alias("r")).select("doc_id", "r.*")


def _masked(text: Column, finder: Finder) -> Column:
    label = F.lit(f"[{finder.kind.upper()}]")

    def rebuild(matches: Column, gaps: Column, scores: Column) -> Column:
        parts = F.transform(
            gaps, lambda g, k: F.concat(g, F.when(F.get(scores, k).isNotNull(), label).otherwise(F.coalesce(F.get(matches, k), F.lit(""))))
        )
        return F.array_join(parts, "")

    return F.when(text.isNotNull(), _pieces(text, finder, rebuild, text))


def masked(text: Column) -> Column:
    """The text with each accepted span replaced by [KIND]; null stays null. One kind after the other, in linear time."""
    for finder in FINDERS:
        text = _mask_next(text, finder)
    return text


def _mask_next(text: Column, finder: Finder) -> Column:
    return let(text, lambda t: _masked(t, finder))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked and n_chars, where there is such a column, the new length. Other columns and all rows stay."""
    text = masked(docs["text"])
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.when(docs["text"].isNotNull(), F.length(text)).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(docs[c])
    return docs.select(*columns)
