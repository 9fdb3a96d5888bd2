"""Text cleaning with built-in string functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import ColumnLike, col

# Control characters, and those plus the C1 and bidirectional controls.
CONTROLS = r"[\x00-\x1F\x7F]"
UNSAFE = r"[\x00-\x1F\x7F-\x9F\u202A-\u202E\u2066-\u2069]"
PLACEHOLDER = r"(?i)^(not provided|unknown|n/a)$"


def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda text: unicodedata.normalize("NFKC", text), na_action="ignore")


def compatibility_form(value: ColumnLike) -> Column:
    """NFKC; the Python worker gets nulls in place of plain ASCII text, which is its own form."""
    text = col(value)
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(F.pandas_udf(_compose, "string")(F.when(~plain, text)))


def squeeze(value: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(col(value), r"\s+", " "))


def bounded_text(value: ColumnLike, limit: int = 500) -> Column:
    """Controls become spaces, runs of spaces collapse, then cut to the limit; empty is null."""
    text = squeeze(F.regexp_replace(col(value), CONTROLS, " "))
    return F.when(text != "", F.substring(text, 1, limit))


def trimmed_text(value: ColumnLike, limit: int) -> Column:
    """Trim, cut to the limit, empty is null."""
    text = F.substring(F.trim(col(value)), 1, limit)
    return F.when(text != "", text)


def provider_text(value: ColumnLike, limit: int, ascii_only: bool = False) -> Column:
    """Compatibility form, unsafe characters to spaces, squeezed; empty or too long is null."""
    composed = col(value) if ascii_only else compatibility_form(value)
    text = squeeze(F.regexp_replace(composed, UNSAFE, " "))
    return F.when((text != "") & (F.length(text) <= limit), text)


def place_query(value: ColumnLike, low: int = 3, high: int = 80) -> Column:
    """Normalised search text, null unless its length is inside the bounds."""
    text = squeeze(F.regexp_replace(compatibility_form(value), UNSAFE, " "))
    return F.when(F.length(text).between(low, high), text)


def kind_title(value: ColumnLike, fallback: str) -> Column:
    """Underscores to spaces, the first letter of every word upper case."""
    words = F.split(F.translate(provider_text(value, 60), "_", " "), " ")
    titled = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 60)))
    return F.coalesce(F.array_join(titled, " "), F.lit(fallback))


def usable_name(*values: ColumnLike, limit: int = 160) -> Column:
    """First candidate that is neither empty nor a placeholder."""
    cleaned = [squeeze(v) for v in values]
    return F.coalesce(*[
        F.when((text != "") & ~text.rlike(PLACEHOLDER) & (F.length(text) <= limit), text) for text in cleaned])


def spreadsheet_safe(value: ColumnLike, leading_space: bool = True) -> Column:
    """Apostrophe before text a spreadsheet would read as a formula."""
    pattern = r"^[\t\r ]*[=+\-@]" if leading_space else r"^[=+\-@]"
    return F.when(col(value).rlike(pattern), F.concat(F.lit("'"), col(value))).otherwise(col(value))


def opaque_id(prefix: str, source: ColumnLike) -> Column:
    """Short stable id for a provider record (32-bit FNV-1a over UTF-16 units, base 36)."""
    codes = F.transform(F.split(col(source), ""), lambda c: F.ascii(c).cast("bigint"))
    # The published offset basis and prime.
    folded = F.aggregate(
        codes, F.lit(2_166_136_261).cast("bigint"),
        lambda acc, code: (acc.bitwiseXOR(code) * F.lit(16_777_619).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    return F.concat(F.lit(prefix + "-"), F.lower(F.conv(folded.cast("string"), 10, 36)))
