"""Scalar functions over names, numbers, dates and categories."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Age bands by their floors, oldest first.
AGE_BANDS = ((55, "55+"), (45, "45-54"), (35, "35-44"), (25, "25-34"), (18, "18-24"))
#: Formats of instants in exports.
INSTANT_FORMATS = ("MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy")


def case_number(raw: Column) -> Column:
    """Upper case, runs of other characters as one dash, none at the ends (FN1)."""
    return F.trim(F.regexp_replace(F.upper(F.trim(raw)), "[^A-Z0-9]+", "-"), F.lit("-"))


@F.pandas_udf(T.StringType())
def _fold_names(raw: pd.Series) -> pd.Series:
    def fold(name: str | None) -> str | None:
        if name is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        return " ".join(re.sub(r"[^\w\s]|_", " ", plain.casefold()).split())

    return raw.map(fold)


def person_name(raw: Column) -> Column:
    """Name for matching: no marks, case or punctuation, single spaces (FN2).

    ASCII names never leave the JVM; only others go through Python, in Arrow batches.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^\w\s]|_", " "), r"\s+", " "))
    return F.when(raw.isNull() | raw.rlike(r"^\p{ASCII}*$"), plain).otherwise(_fold_names(raw))


def display_name(first: Column, middle: Column, last: Column, suffix: Column) -> Column:
    """"First Middle Last, Suffix" from parts, empty ones skipped (FN3)."""
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.concat_ws(", ", F.nullif(F.concat_ws(" ", tidy(first), tidy(middle), tidy(last)), F.lit("")), tidy(suffix))


def age_band(age: Column) -> Column:
    """Band of an age; unknown without one or under 18 (FN4)."""
    out = F.when(age.isNull(), F.lit("unknown"))
    for floor, band in AGE_BANDS:
        out = out.when(age >= floor, F.lit(band))
    return out.otherwise(F.lit("unknown"))


def bounded_age(text: Column) -> Column:
    """Whole number from 0 to 130, else null (FN4)."""
    n = F.when(F.trim(text).rlike("^[0-9]{1,9}$"), F.trim(text).cast("int"))
    return F.when(n.between(0, 130), n)


def fold_space(text: Column) -> Column:
    """Lower case with single spaces: the key of a lookup (FN5, NO7)."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def require(value: Column, allowed: tuple[str, ...], unknown: str | None = None) -> Column:
    """The value if it is in the vocabulary, else ``unknown`` (null rejects the row) (FN6)."""
    return F.when(value.isin(list(allowed)), value).otherwise(F.lit(unknown))


def parse_instant(text: Column, formats: tuple[str, ...] = INSTANT_FORMATS) -> Column:
    """The first format that reads the text; null if none does (FN7, SC6)."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_bool(text: Column) -> Column:
    """true or false, any case; else null (FN7)."""
    return F.when(F.lower(F.trim(text)) == "true", F.lit(True)).when(F.lower(F.trim(text)) == "false", F.lit(False))


def parse_int(text: Column) -> Column:
    """A whole number, else null (FN7)."""
    return F.trim(text).try_cast("long")


def parse_decimal(text: Column) -> Column:
    """A decimal with two places, else null (FN7)."""
    return F.trim(text).try_cast("decimal(14,2)")


def parse_list(text: Column) -> Column:
    """Values between semicolons, trimmed, empty ones skipped (FN7)."""
    return F.filter(F.transform(F.split(text, ";"), F.trim), lambda x: x != "")


def statute_code(chapter: Column, act: Column, section: Column) -> Column:
    """Parts that are there, by dashes, at most 128 characters (FN8)."""
    tidy = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.left(F.concat_ws("-", tidy(chapter), tidy(act), tidy(section)), F.lit(128))


def money(text: Column, most: int = 10**11) -> Column:
    """A decimal amount from 0 up to a bound, else null (FN9)."""
    value = F.regexp_replace(F.trim(text), "[$,]", "").try_cast("decimal(14,2)")
    return F.when((value >= 0) & (value < most), value)


def birth_year(text: Column) -> Column:
    """The first four digits in a row (FN10)."""
    return F.nullif(F.regexp_extract(text, "([0-9]{4})", 1), F.lit("")).cast("int")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each with two spaces before and one after (FN14)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of the two (FN14)."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def word_similarity(query: Column, name: Column) -> Column:
    """The best similarity of the query with a run of the name's words (FN14)."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(i, F.size(words)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    best = F.array_max(F.transform(runs, lambda r: similarity(trigrams(query), trigrams(r))))
    return F.when(F.size(words) > 0, best).otherwise(F.lit(0.0))


def format_label(text: Column) -> Column:
    """Words of a code with the first letter in upper case (FN18)."""
    spaced = F.regexp_replace(text, "_", " ")
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substring(spaced, F.lit(2), F.length(spaced)))


def unknown_states(table: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Add state_code by a folded lookup in codes (name, code), a fixed small table (FN5)."""
    key = codes.select(fold_space(F.col("name")).alias("state_key"), F.col("code").alias("state_code"))
    return table.withColumn("state_key", fold_space(F.col(column))).join(F.broadcast(key), "state_key", "left").drop("state_key")
