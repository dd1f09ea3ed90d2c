"""Scalar expressions as functions of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_action(col: Column, known: Sequence[str]) -> Column:
    """Trimmed, in lower case, with - and spaces as _; a value that isn't known then fails the job, null stays null."""
    out = F.translate(F.lower(F.trim(col)), "- ", "__")
    return F.when(out.isNull() | out.isin(*known), out).otherwise(F.raise_error(F.concat(F.lit("unknown action "), out)))


def action_class(action: Column, amount: Column, to_call: Column) -> Column:
    """exit, hold, match or push; an all-in is a push only for more than what is to be called."""
    return (
        F.when(action == "fold", "exit").when(action == "check", "hold").when(action == "call", "match").when(action.isin("bet", "raise"), "push")
        .when((action == "all_in") & (amount > to_call), "push").when(action == "all_in", "match")
    )


def encode(col: Column, codes: Mapping[str, int]) -> Column:
    """The code of a value, null for others."""
    return F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[col]


def per_unit(col: Column, unit: Column) -> Column:
    return col / F.nullif(unit, F.lit(0))


def directed_transfer(net_a: Column, net_b: Column) -> Column:
    """What a lost and b won of it; never negative, and the other direction has it the other way round."""
    return F.least(F.greatest(-net_a, F.lit(0.0)), F.greatest(net_b, F.lit(0.0)))


def clipped_logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.log(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def surprisal(q: Column) -> Column:
    return -F.log(F.greatest(q, F.lit(1e-6)))
