"""Null-safe identity keys, digests and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapfold.schema import LOCATION_IDENTITY

K1 = ("BookNumber", "ChapterNumber", "KeySymbol", "MepsLanguage", "Type")
K2 = ("KeySymbol", "IssueTagNumber", "MepsLanguage", "DocumentId", "Track", "Type")


def key(*columns: str | Column) -> Column:
    """One narrow string for a tuple of columns in which null is a value of its own, unlike the empty string."""
    fields = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.sha2(F.to_json(F.struct(*(f.alias(f"k{i}") for i, f in enumerate(fields))), {"ignoreNullFields": "false"}), 256)


def location_identity() -> Column:
    return key(*LOCATION_IDENTITY)


def _all_set(columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def unique_key() -> Column:
    """The book key of a place; null if any part is null."""
    return F.when(_all_set(K1), key(*K1))


def media_key() -> Column:
    """The media key of a place; null if a part other than specialty or edition is null."""
    return F.when(_all_set(K2), key(*K2, F.coalesce("Specialty", F.lit("")), F.coalesce("Edition", F.lit(""))))


def short_hex(digest: Column) -> Column:
    """Lower-case hex in which no byte has a leading zero (00 is 0)."""
    return F.regexp_replace(digest, "0([0-9a-f])|([1-9a-f][0-9a-f])", "$1$2")


def media_hash(content: Column) -> Column:
    return short_hex(F.sha2(content, 256))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a name that starts with its only dot has none."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1)


def unique_name(path: Column, taken: Column) -> Column:
    """path, or the first of stem-2, stem-3, ... (up to 999) that is not in the array `taken`; an error if none is free."""
    free = lambda n: F.concat(stem(path), F.lit("-"), n.cast("string"), suffix(path))
    # of one candidate more than there are taken names, one is free
    others = F.filter(F.sequence(F.lit(2), F.least(F.lit(999), F.size(taken) + 2)), lambda n: ~F.array_contains(taken, free(n)))
    return F.when(~F.array_contains(taken, path), path).otherwise(F.coalesce(free(F.try_element_at(others, F.lit(1))), F.raise_error(F.concat(F.lit("no free name for "), path))))


def renamed_path(*parts: str | Column) -> Column:
    """A deterministic name, shaped like a UUID, with the suffix of the last part."""
    h = F.sha2(F.concat_ws("\u0001", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)
    last = F.col(parts[-1]) if isinstance(parts[-1], str) else parts[-1]
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), suffix(last))


def utc_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssZ")


def migration_version(identifier: Column) -> Column:
    """The number N of a migration called vN, else null."""
    return F.nullif(F.regexp_extract(identifier, "^v([0-9]+)$", 1), F.lit("")).cast("long")
