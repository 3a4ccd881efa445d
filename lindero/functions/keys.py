"""Validation and assembly of parcel keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two accepted key shapes and the lenient shape of the enrichment endpoint.
STRICT = r"^(?:[0-9]{7}[A-Z]{2}[0-9]{4}[A-Z]|[0-9]{7}[A-Z]{2}[0-9]{4}[A-Z][0-9]{4}[A-Z]{2})$"
LENIENT = r"^(?:[0-9A-Z]{14}|[0-9A-Z]{20})$"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def canonical(raw: Column) -> Column:
    return F.upper(strip(raw))


def key_error(raw: Column) -> Column:
    """Why a key is refused: `not_text`, `bad_length`, `bad_format`, or null when it is valid."""
    key = canonical(raw)
    return (
        F.when(raw.isNull(), F.lit("not_text"))
        .when(~F.length(key).isin(14, 20), F.lit("bad_length"))
        .when(~key.rlike(STRICT), F.lit("bad_format"))
    )


def strict_rc14(raw: Column) -> Column:
    """First 14 characters of a valid key, else null."""
    return F.when(key_error(raw).isNull(), F.left(canonical(raw), F.lit(14)))


def is_lenient(raw: Column) -> Column:
    """Accepts rural keys that the strict form refuses."""
    return F.coalesce(canonical(raw).rlike(LENIENT), F.lit(False))


KEY_PARTS = ("pc1", "pc2", "car", "cc1", "cc2")


def assemble_keys(candidates: DataFrame, request: str = "request", ord_col: str = "ord",
                  by_length: bool = False) -> DataFrame:
    """First complete key of each request, in candidate order; one row per request, null if none.

    Complete means that all five parts are filled, or with `by_length` that the whole has 20
    characters. The pick is a partial aggregate, so a request with very many candidates is
    reduced before the shuffle.
    """
    parts = [F.coalesce(F.col(p), F.lit("")) for p in KEY_PARTS]
    whole = F.concat(*parts)
    if by_length:
        complete = F.length(whole) == 20
    else:
        complete = F.lit(True)
        for p in parts:
            complete = complete & (p != "")
    pick = F.when(complete, F.struct(F.col(ord_col).alias("o"), whole.alias("k")))
    return candidates.groupBy(request).agg(F.min(pick)["k"].alias("rc"))
