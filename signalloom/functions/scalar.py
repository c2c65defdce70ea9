"""Scalar expressions on signal columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a CSV reader of the data-frame kind takes as missing.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def named(name: str) -> Column:
    """Column by its literal name, also when it holds dots, pipes or signs."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_text(text: Column, tokens: Sequence[str] = MISSING_TEXT) -> Column:
    """Text with missing-value tokens turned into NULL."""
    return F.when(~F.trim(text).isin(*tokens), text)


def null_nan(number: Column) -> Column:
    """Number with NaN turned into NULL."""
    return F.when(~F.isnan(number), number)


def residual(total: Column, part: Column) -> Column:
    """What `part` leaves of `total`; NULL if either is."""
    return total - part


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def exceeds(error: Column, threshold: float) -> Column:
    """Strictly over the threshold; a missing error (NULL or NaN) is not over."""
    return F.coalesce((error > F.lit(threshold)) & ~F.isnan(error), F.lit(False))


def parse_time(text: Column, fmt: str | None = None, strict: bool = True) -> Column:
    """Timestamp without zone from text; bad text fails the job unless `strict` is off."""
    args = [text] + ([F.lit(fmt)] if fmt else [])
    if strict:
        return F.to_timestamp_ntz(*args)
    return F.try_to_timestamp(*args).cast("timestamp_ntz")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def tag_matches(tag: Column, pattern: str, literal: bool = False, strict: bool = False) -> Column:
    """Search a tag for a pattern; a null tag is no match, or an error when `strict`."""
    hit = tag.contains(pattern) if literal else tag.rlike(pattern)
    if strict:
        return F.when(tag.isNull(), F.raise_error(F.lit("tag is null"))).otherwise(hit)
    return F.coalesce(hit, F.lit(False))


def stabilise(x: Column) -> Column:
    """sqrt(log(x)); NULL below 1, where the root has no real value."""
    return F.when(x >= 1, F.sqrt(F.log(x)))


def destabilise(z: Column) -> Column:
    """Inverse of `stabilise`."""
    return F.exp(z * z)
