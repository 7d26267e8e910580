"""Column builders for selectors, names, routes and private text."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Forms of a selector, in the order they are tried.
FORMS = [
    ("opaque", r"^m[0-9]+$"),
    ("occurrence", r"^o[0-9]+(?:\.[0-9]+)*$"),
    ("entity", r"^o[0-9]+(?:\.[0-9]+)*\.[sfev][0-9]+$"),
    ("local", r"^[sfev][0-9]+$"),
    ("labelled", r"^[A-Za-z_][A-Za-z0-9_-]*\.[sfev][0-9]+$"),
]
#: What must not stand in a shared document.
PRIVATE = {
    "absolute_path": r"(?:^|[^A-Za-z0-9_/.:])/(?:home|Users|root|tmp|var)/|[A-Za-z]:\\",
    "network_location": r"https?://|(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "secret_value": r"AKIA[A-Z0-9]{12,}|(?i:password|secret|token)[\x20]*[:=]",
}


def selector_form(text: Column) -> Column:
    out = F.lit("label")
    for name, pattern in reversed(FORMS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.when(text != "", out)


def occurrence_path(text: Column) -> Column:
    """The numbers of an occurrence, to sort by."""
    return F.transform(F.split(F.regexp_extract(text, r"^o([0-9]+(?:\.[0-9]+)*)", 1), r"\."), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))


def private_codes(text: Column) -> Column:
    """Names of the patterns that a text holds."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in PRIVATE.items()]))


@F.pandas_udf(T.StringType())
def natural_key(names: pd.Series) -> pd.Series:
    """A string that sorts as names do for people: punctuation, then numbers by value, then letters without case."""

    def key(name: str | None) -> str | None:
        if name is None:
            return None
        out, i = [], 0
        while i < len(name):
            if name[i].isdigit():
                j = i
                while j < len(name) and name[j].isdigit():
                    j += 1
                digits = name[i:j].lstrip("0") or "0"
                out.append(f"1{len(digits):04d}{digits}")
                i = j
            else:
                out.append(("2" if name[i].isalnum() else "0") + name[i].casefold())
                i += 1
        return "\x01".join(out)

    return names.map(key)


@F.pandas_udf(T.StringType())
def canonical_json_sha256(docs: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text with sorted keys, no blanks and ASCII only; null for what is no JSON or repeats a key."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError
        return dict(pairs)

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text, object_pairs_hook=unique)
            return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()
        except (ValueError, TypeError):
            return None

    return docs.map(one)


def json_pointer(*parts: Column) -> Column:
    return F.concat(*[F.concat(F.lit("/"), F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for p in parts])


def strict_double(text: Column) -> Column:
    """A plain decimal that is finite and no underflow; else null."""
    n = F.when(text.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), text).try_cast("double")
    gone = (n == 0) & F.regexp_replace(text, r"[eE].*$", "").rlike("[1-9]")
    return F.when((F.abs(n) < float("inf")) & ~gone, n)


def bump_rank(message: Column) -> Column:
    """What a commit message asks of the next version: 2 major, 1 minor, 0 patch; blank and null messages 0."""
    body = F.regexp_replace(F.coalesce(message, F.lit("")), r"\A\s+|\s+\z", "")
    header = F.trim(F.substring_index(body, "\n", 1))
    # fixed values: the forms of breaking and feature messages
    breaking = body.rlike(r"(?md)^BREAKING(?: CHANGE|-CHANGE):(?:[ \t].*)?$") | header.rlike(r"^[A-Za-z][A-Za-z0-9-]*(?:\([^\r\n)]+\))?!:")
    feature = header.rlike(r"^feat(?:\([^\r\n)]+\))?:") | header.contains("[minor]")
    return F.when(breaking, 2).when(feature, 1).otherwise(0)


def bumped(version: Column, rank: Column) -> Column:
    """The next version after plain ``MAJOR.MINOR.PATCH``; null if the version has another form or there is no rank."""
    part = lambda i: F.split(version, r"\.")[i].try_cast("long")
    upper = F.concat_ws(".", (part(0) + 1).cast("string"), F.lit("0"), F.lit("0"))
    middle = F.concat_ws(".", part(0).cast("string"), (part(1) + 1).cast("string"), F.lit("0"))
    lower = F.concat_ws(".", part(0).cast("string"), part(1).cast("string"), (part(2) + 1).cast("string"))
    plain = version.rlike(r"\A(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\z")
    return F.when(plain & (rank == 2), upper).when(plain & (rank == 1), middle).when(plain & (rank == 0), lower)
