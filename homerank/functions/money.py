"""Money as column expressions; whole tomans as 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C



def _rate() -> Column:
    return F.lit(C.TABDIL_RATE)


def tmc(deposit: Column, rent: Column) -> Column:
    """Total monthly cost: rent and the deposit's yield, truncated."""
    return rent + (deposit * _rate()).cast("bigint")


def fde(deposit: Column, rent: Column) -> Column:
    """The deposit that would replace all rent."""
    return (deposit + rent / _rate()).cast("bigint")


def budget_compatible(deposit: Column, rent: Column, max_deposit: Column, max_rent: Column) -> Column:
    """Whether the cost is within tolerance of the caps' cost; without caps everything is."""
    caps = tmc(F.coalesce(max_deposit, F.lit(0)), F.coalesce(max_rent, F.lit(0)))
    return F.when(max_deposit.isNull() & max_rent.isNull(), True).otherwise(tmc(deposit, rent) <= C.BUDGET_TOLERANCE * caps)


def is_full_deposit(rent: Column) -> Column:
    return rent <= C.FULL_DEPOSIT_RENT


def is_placeholder(deposit: Column, rent: Column, area: Column) -> Column:
    """A price too low to be meant: in all, or for its area."""
    cost = (rent + deposit * _rate()).cast("bigint")
    return (cost < C.PLACEHOLDER_TMC) | ((area > 0) & (F.try_divide(cost, area) < C.PLACEHOLDER_PER_SQM))


def band(deposit: Column, rent: Column, can_convert: Column, ceiling: Column) -> tuple[Column, Column]:
    """Between which deposits an advert converts; the advertised one when it does not."""
    whole = fde(deposit, rent)
    upper = F.greatest(F.coalesce(F.nullif(ceiling, F.lit(0)), whole), deposit)
    lower = F.least((C.MIN_DEPOSIT_FRACTION * whole).cast("bigint"), deposit)
    return F.when(can_convert, lower).otherwise(deposit), F.when(can_convert, upper).otherwise(deposit)


def resolve_split(deposit: Column, rent: Column, can_convert: Column, ceiling: Column, cap: Column, persona: Column) -> tuple[Column, Column]:
    """(deposit, rent) after conversion: down to a stated cash cap, else to the band's end that the searcher prefers
    (prefer_higher_rent, prefer_higher_deposit), else as advertised."""
    lower, upper = band(deposit, rent, can_convert, ceiling)
    stated = F.nullif(cap, F.lit(0))
    target = F.when(lower == upper, F.lit(None).cast("bigint")).when(stated.isNotNull() & (deposit > stated), F.greatest(lower, F.least(upper, stated)))
    target = target.when(persona == "prefer_higher_deposit", upper).when(persona == "prefer_higher_rent", lower)
    left = F.greatest(F.lit(0).cast("bigint"), ((fde(deposit, rent) - target) * _rate()).cast("bigint"))
    return F.coalesce(target, deposit), F.when(target.isNull(), rent).otherwise(left)


def budget_ratio(deposit: Column, rent: Column, max_deposit: Column, max_rent: Column) -> Column:
    """Cost over budget by the caps that are stated (zero is not); null without any."""
    d, r = F.nullif(max_deposit, F.lit(0)), F.nullif(max_rent, F.lit(0))
    return F.when(d.isNotNull() & r.isNotNull(), F.try_divide(tmc(deposit, rent), tmc(d, r))).when(r.isNotNull(), F.try_divide(rent, r)).when(d.isNotNull(), F.try_divide(deposit, d))
