"""Ranking of suggestions, on ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dictionary_first(options: Column, known: Column) -> Column:
    """Known options before the others, each part in its order."""
    pairs = F.arrays_zip(options.alias("o"), known.alias("k"))
    part = lambda keep: F.transform(F.filter(pairs, lambda p: p["k"] == keep), lambda p: p["o"])
    return F.concat(part(True), part(False))


def _without_first(options: Column, value: Column) -> Column:
    at = F.coalesce(F.array_position(options, value), F.lit(0)).cast("int")
    return F.when(at == 0, options).otherwise(F.concat(F.slice(options, 1, at - 1), F.slice(options, at + 1, F.size(options))))


def _insert(options: Column, value: Column, at: int) -> Column:
    return F.concat(F.slice(options, 1, at), F.array(value), F.slice(options, at + 1, F.size(options) + 1))


def insert_sound_candidate(options: Column, candidate: Column, english: Column, clash: Column) -> Column:
    """Where a sounded-out candidate goes: for an English word it moves first; if that clashes it is put second, and if the
    word isn't English fourth, unless it is in the first four already (one further down stays there as well)."""
    shown = F.array_contains(F.slice(options, 1, 4), candidate)
    return (
        F.when(candidate.isNull(), options)
        .when(english & ~clash, _insert(_without_first(options, candidate), candidate, 0))
        .when(shown, options)
        .when(english, _insert(options, candidate, 1))
        .otherwise(_insert(options, candidate, 3))
    )


def cap_options(options: Column, k: int = 4) -> Column:
    return F.slice(options, 1, k)
