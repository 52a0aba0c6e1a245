"""Scalar rules for blanks, gate answers, label sets and model names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean no value.
BLANK = ("", "nan", "none")
NULL_WORDS = ("", "nan", "none", "null")
#: Gate answers.
YES = ("1", "1.0", "true", "yes", "ja")
NO = ("0", "0.0", "false", "no", "nein")
#: Fixed value: the answer that is real but names no category.
SENTINEL = "insufficient_information"
#: Accents that stand apart before their letter.
APART = {"¨": "aäoöuüAÄOÖUÜ", "´": "aáeéiíoóuúAÁEÉIÍOÓUÚ", "`": "aàeèiìoòuùAÀEÈIÌOÒUÙ"}


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def is_blank(value: Column) -> Column:
    return value.isNull() | F.lower(strip(value)).isin(*BLANK)


def clean_cell(value: Column) -> Column:
    """The stripped value, or null where it is blank."""
    return F.when(~is_blank(value), strip(value))


def norm(value: Column) -> Column:
    """Lower case, runs of white space and hyphens as one underscore; null words become the empty string."""
    plain = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(plain.isin(*NULL_WORDS), "").otherwise(F.regexp_replace(plain, r"(?U)[\s-]+", "_"))


def bench_set(value: Column) -> Column:
    """Sorted distinct normalised labels, split at ; and , (the set that scores compare)."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), "[;,]"), norm)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def vote_list(value: Column) -> Column:
    """Distinct normalised labels in their order, split at ; only (what votes count)."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), norm), lambda x: x != ""))


def coder_set(value: Column) -> Column:
    """Sorted distinct labels as they are written, split at ; only."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), strip), lambda x: x != "")))


def icr_label(value: Column) -> Column:
    """The coder set as one label; nothing coded is the label ``nan``."""
    joined = F.array_join(coder_set(value), ";")
    return F.when(joined == "", "nan").otherwise(joined)


def gate_value(value: Column) -> Column:
    plain = F.lower(strip(value))
    return F.when(plain.isin(*YES), 1).when(plain.isin(*NO), 0)


def numeric_gate(value: Column) -> Column:
    """int(float(x)), null where that fails."""
    return strip(value).try_cast("double").try_cast("int")


def coded_gate(value: Column) -> Column:
    """1 for a number that is 1, 0 for another number, 1 for anything that is no number."""
    number = numeric_gate(value)
    return F.when(number.isNull() | (number == 1), 1).otherwise(0)


def as_float(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def model_family(name: Column) -> Column:
    return F.regexp_extract(F.split(F.lower(strip(name)), "-")[0], "^[a-z]+", 0)


def model_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clipped(text: Column, most: int) -> Column:
    rest = F.length(text) - most
    return F.when(rest > 0, F.concat(F.substring(text, 1, most), F.lit("… [+"), rest, F.lit(" chars clipped]"))).otherwise(text)


def collapsed(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def joined_accents(text: Column) -> Column:
    for accent, letters in APART.items():
        for plain, marked in zip(letters[::2], letters[1::2]):
            text = F.replace(text, F.lit(accent + plain), F.lit(marked))
    return text


def coder_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), r"(?U)\s", "_")


def ratio(part: Column, whole: Column) -> Column:
    """Share that is 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2 * tp + fp + fn)


def truncated(text: Column, most: int) -> Column:
    """The first characters of a text, as a prompt takes them."""
    return F.substring(text, 1, most)


def shown(number: Column, places: int = 3) -> Column:
    """A figure for a report: rounded, or ``-`` where there is none."""
    return F.coalesce(F.format_number(F.when(~F.isnan(number), number), places), F.lit("-"))


def same(left: Column, right: Column) -> Column:
    """Whether two nested values are equal in all parts, nulls included."""
    return F.coalesce(F.to_json(F.struct(left.alias("v"))), F.lit("")) == F.coalesce(F.to_json(F.struct(right.alias("v"))), F.lit(""))
