"""Text functions: normalisation, profile texts, levels, tags and templates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave import wording as w

# Fixed value: the characters that Python's str.strip and \s treat as blank.
BLANKS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANK_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Remove Unicode blanks at both ends (plain ``trim`` removes U+0020 only)."""
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def all_but(kept: str) -> str:
    """A character class of everything outside a list of characters and ranges.

    Written out as ranges: the same class as a negation takes the Java matcher several times longer.
    """
    ranges, i = [], 0
    while i < len(kept):
        last = i + 2 if kept[i + 1 : i + 2] == "-" and i + 2 < len(kept) else i
        ranges.append((ord(kept[i]), ord(kept[last])))
        i = last + 1
    gaps, start = [], 0
    for low, high in sorted(ranges):
        if low > start:
            gaps.append(rf"\x{{{start:x}}}-\x{{{low - 1:x}}}")
        start = max(start, high + 1)
    return f"[{''.join(gaps)}\\x{{{start:x}}}-\\x{{10ffff}}]"


def normalise_text(text: Column, kept: str = w.KEPT_CHARACTERS) -> Column:
    """Lower, strip, and make every run of anything but ``kept`` one blank; null gives ''.

    Stripping comes first, so a blank left by dropped punctuation may remain at an end.
    """
    return F.regexp_replace(strip(F.lower(F.coalesce(text, F.lit("")))), f"{all_but(kept)}+", " ")


def index_text(
    title: Column, company: Column, tags: Column, experience: Column, keywords: Column
) -> Column:
    """The normalised text an item is embedded by in the graph recommendation."""
    parts = [title, company, F.array_join(tags, ", "), experience, keywords]
    blank = F.lit(" ")
    pieces = [piece for part in parts for piece in (blank, F.coalesce(part, F.lit("")))][1:]
    return normalise_text(F.concat(*pieces))


def work_text(requirement: Column, responsibility: Column) -> Column:
    return F.concat_ws(
        " ", empty_to_null(F.lower(requirement)), empty_to_null(F.lower(responsibility))
    )


def profile_text(work: Column, tags: Column, level: Column) -> Column:
    """The text a profile is embedded by; the tag part is left out when there are no tags."""
    tag_part = F.when(
        F.size(tags) > 0, F.concat(F.lit(w.PROFILE_TAGS), F.array_join(tags, ", "))
    )
    return F.concat_ws(
        ". ",
        F.concat(F.lit(w.PROFILE_WORK), F.coalesce(work, F.lit(""))),
        tag_part,
        F.concat(F.lit(w.PROFILE_LEVEL), level),
    )


def level_from_label(label: Column) -> Column:
    """Experience level by the digits in a label."""
    text = F.lower(label)
    has = lambda part: F.contains(text, F.lit(part))
    return (
        F.when(has("1") & has("3"), w.ONE_TO_THREE)
        .when(has("3") & has("6"), w.THREE_TO_SIX)
        .when(has("6") | has(w.MORE_WORD), w.MORE_THAN_SIX)
        .otherwise(w.NO_EXPERIENCE)
    )


def year_digits(text: Column, units: Sequence[str] = w.YEAR_WORDS) -> Column:
    """Digits of the first "<number> <unit>"; null without a match."""
    pattern = rf"(\d+)[{BLANKS}]*(?:{'|'.join(units)})"
    return empty_to_null(F.regexp_extract(text, pattern, 1))


def level_from_years(digits: Column) -> Column:
    """Experience level of a digit string of any length."""
    short = F.regexp_replace(digits, "^0+", "")
    years = F.when(F.length(short) <= 1, F.concat(F.lit("0"), short).cast("int")).otherwise(10)
    return (
        F.when(digits.isNull() | (years <= 0), w.NO_EXPERIENCE)
        .when(years <= 3, w.ONE_TO_THREE)
        .when(years <= 6, w.THREE_TO_SIX)
        .otherwise(w.MORE_THAN_SIX)
    )


def split_tags(text: Column) -> Column:
    """Comma list to an array of stripped parts; null and '' give an empty array."""
    return F.when(text != "", F.transform(F.split(text, ","), strip)).otherwise(
        F.array().cast("array<string>")
    )


def extract_tags(
    text: Column,
    verbs: Sequence[str] = w.TAG_VERBS,
    labels: Sequence[str] = w.TAG_LABELS,
) -> Column:
    """Sorted distinct tags named after a verb or a label, up to the end of the sentence."""
    # The two patterns, in the order in which their finds are appended.
    patterns = (
        rf"(?iu)(?:{'|'.join(verbs)})[{BLANKS}]+([^.!?\n]+)",
        rf"(?iu)(?:{'|'.join(labels)})[{BLANKS}]*[:\-][{BLANKS}]*([^.!?\n]+)",
    )

    def parts(block: Column) -> Column:
        stripped = F.transform(F.split(block, "[;,]"), strip)
        return F.filter(stripped, lambda tag: (F.length(tag) > 1) & (F.length(tag) < 40))

    text = F.coalesce(text, F.lit(""))
    found = [
        F.flatten(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), parts))
        for p in patterns
    ]
    return F.sort_array(F.array_distinct(F.concat(*found)))


def fill(template: str, **holes: Column) -> Column:
    """A template with named holes as one concat; filled text is never scanned again."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(F.coalesce(holes[name], F.lit("")))
    return F.concat(*pieces)


def too_short(answer: Column) -> Column:
    return F.coalesce(F.length(strip(answer)) < 3, F.lit(True))


def says_yes(verdict: Column, yes: str = w.YES_WORD) -> Column:
    """Whether the first ten characters of a verdict hold the yes word."""
    head = F.substring(strip(F.lower(verdict)), 1, 10)
    return F.coalesce(F.contains(head, F.lit(yes)), F.lit(False))


def path_label(title: Column, company: Column, separator: str = w.PATH_SEPARATOR) -> Column:
    """"title in company"; null unless both are present and not empty."""
    return F.when((title != "") & (company != ""), F.concat(title, F.lit(separator), company))


def salary_text(salary_from: Column, salary_to: Column, currency: Column, missing: Column) -> Column:
    """"from-to currency"; zero and null print as nothing, a missing salary as a label."""
    amount = lambda c: F.when(c != 0, c.cast("string")).otherwise("")
    return F.when(missing, w.NO_SALARY).otherwise(
        F.concat(
            amount(salary_from),
            F.lit("-"),
            amount(salary_to),
            F.lit(" "),
            F.coalesce(currency, F.lit("")),
        )
    )


def all_equal(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Null-safe equality of every pair; true for no pairs."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs), F.lit(True))
