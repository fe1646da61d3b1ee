"""Numbers in model output: finding, normalising and comparing them, as Column builders."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns that decide what counts as a number and as an answer marker.
NUMBER = r"(?U)-?\$?\d[\d,]*(?:\.\d+)?(?:/\d[\d,]*)?"
SIMPLE_NUMBER = r"-?\d+(?:\.\d+)?"
# The last is the answer pattern of the baseline contract; the flags give \d and $ the meaning that it was written for.
STRICT_NUMBER = r"(?Ud)^-?(?:(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?|(?:\d+|\d{1,3}(?:,\d{3})+)/(?:\d+|\d{1,3}(?:,\d{3})+))$"
CANONICAL_INTEGER = r"\A-?(?:0|[1-9][0-9]*)\z"
MARKER = r"(?i)Final answer\s*:\s*"


_WHITE = r"[\s\x1C-\x1F]"


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)\A{_WHITE}+", ""), rf"(?U)(?<!{_WHITE}){_WHITE}+\z", "")


def numbers(text: Column, pattern: str = NUMBER) -> Column:
    """All number mentions of a text, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def last_number(text: Column, pattern: str = NUMBER) -> Column:
    """The last number mention, null without one."""
    return F.try_element_at(numbers(text, pattern), F.lit(-1))


def _value(text: str) -> Fraction | None:
    """The exact value that a text spells as a decimal or as a fraction of two plain integers, if it does."""
    try:
        whole = re.fullmatch(r"(-?\d+)/(\d+)", text)
        return Fraction(int(whole[1]), int(whole[2])) if whole else Fraction(Decimal(text))
    except (InvalidOperation, ValueError, ZeroDivisionError, OverflowError):
        return None


def _exact(text: str | None) -> str | None:
    if text is None:
        return None
    value = _value(text)
    if value is None:
        return None if re.fullmatch(r"[-+]?(?:inf(?:inity)?|s?nan\d*)", text, re.IGNORECASE) else text.casefold()
    if value.denominator == 1:
        return "-0" if not value and text.startswith("-") and "/" not in text else str(value.numerator)
    return str(value) if "/" in text else f"{Decimal(text).normalize():f}"


_JSON_NUMBER = r"\A-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?\z"


def number_key(text: Column) -> Column:
    """One spelling for JSON numbers of equal exact value: significant digits, e, power of ten; 0 for zero of either sign.

    Null for what is not a finite number. Native, so that it can stand inside functions over arrays.
    """
    low = F.lower(text)
    mantissa = F.ltrim(F.substring_index(low, "e", 1), F.lit("-"))
    fraction = F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise("")
    digits = F.ltrim(F.concat(F.substring_index(mantissa, ".", 1), fraction), F.lit("0"))
    bare = F.rtrim(digits, F.lit("0"))
    power = F.when(F.contains(low, F.lit("e")), F.substring_index(low, "e", -1).try_cast("int")).otherwise(0) - F.char_length(fraction) + F.char_length(digits) - F.char_length(bare)
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    return F.when(text.rlike(_JSON_NUMBER), F.when(bare == "", "0").otherwise(F.concat(sign, bare, F.lit("e"), power.cast("string"))))


def same_number(left: Column, right: Column) -> Column:
    """Whether two JSON numbers have one exact value; null or false for what is not finite.

    Up to 15 characters without an exponent are told apart by doubles; only longer ones need their keys.
    """
    short = lambda x: (F.char_length(x) <= 15) & ~x.rlike("[eEnN]")
    return F.when(short(left) & short(right), left.try_cast("double") == right.try_cast("double")).otherwise(number_key(left) == number_key(right))


def number_key_of(text: str) -> str | None:
    """number_key() of a text."""
    if not re.fullmatch(r"-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?", text, re.ASCII):
        return None
    sign, digits, power = Decimal(text).as_tuple()
    shown = "".join(map(str, digits)).lstrip("0")
    bare = shown.rstrip("0")
    return f"{'-' * sign}{bare}e{int(power) + len(shown) - len(bare)}" if bare else "0"


@F.pandas_udf(T.StringType())
def _exact_form(values: pd.Series) -> pd.Series:
    return values.map(_exact)


def canonical_number(value: Column) -> Column:
    """One spelling for equal numbers: no separators, lowest terms, no trailing zeros; other text in lower case.

    Plain integers take the native way; only the rest is handed to the exact decimal and fraction helper.
    Infinite values give null.
    """
    bare = F.regexp_replace(stripped(value), r"[,$]", "")
    bare = F.regexp_replace(bare, r"[. ]+$", "")
    plain = bare.rlike(r"\A-?(?:0|[1-9][0-9]*)\z")
    other = _exact_form(F.when(~plain & (bare != ""), bare))
    return F.when(bare == "", F.lit(None)).when(plain, bare).otherwise(other)


def free_answer(text: Column) -> Column:
    """Scores free text: answer, method, marker_present and marker_at_end.

    The first number after the last marker is the answer; with a marker but no number after it there is
    none. Without a marker it is the last number.
    """
    present = text.rlike(MARKER)
    tail = F.try_element_at(F.split(text, MARKER, -1), F.lit(-1))
    first = F.nullif(F.regexp_extract(tail, f"({NUMBER})", 1), F.lit(""))
    answer = F.when(present, first).otherwise(last_number(text))
    rest = stripped(F.regexp_extract(tail, rf"(?s)\A.*?{NUMBER}(.*)\z", 1))
    return F.struct(
        answer.alias("answer"),
        F.when(answer.isNull(), "not_found").when(present, "final_answer_marker").otherwise("last_number_fallback").alias("method"),
        present.alias("marker_present"),
        (present & first.isNotNull() & rest.isin("", ".")).alias("marker_at_end"),
    )


def strict_number(text: Column) -> Column:
    """The stripped text if it is nothing but a number, else null."""
    return F.when(stripped(text).rlike(STRICT_NUMBER), stripped(text))


def consistency(reasoning: Column, answer: Column) -> Column:
    """Whether the last number of the reasoning equals the answer: consistent, inconsistent or not_assessable."""
    mention, given = canonical_number(last_number(reasoning)), canonical_number(answer)
    return F.when(mention.isNull() | given.isNull(), "not_assessable").when(mention == given, "consistent").otherwise("inconsistent")


def sign_inverse(left: Column, right: Column) -> Column:
    return F.coalesce((right == F.concat(F.lit("-"), left)) | (left == F.concat(F.lit("-"), right)), F.lit(False))


def gold_answer(solution: Column) -> Column:
    """What follows the last ####, stripped; null without the mark or without a digit after it."""
    tail = stripped(F.substring_index(solution, "####", -1))
    return F.when(solution.contains("####") & tail.rlike(r"(?U)\d"), tail)


def id_index(value: Column, prefix: str) -> Column:
    """The number of an id such as prefix_12, or of a plain number; null otherwise."""
    return F.regexp_extract(value, rf"\A(?:{prefix}_)?(\d+)\z", 1).try_cast("bigint")


def tail_of(text: Column, length: int = 240) -> Column:
    """The last characters of the text, null for null."""
    return F.right(text, F.lit(length))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.1f%%", value * 100))


def table_cell(value: Column) -> Column:
    """Text that is safe inside a Markdown table."""
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
