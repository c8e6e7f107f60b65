"""Small column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Half-up on the decimal value. Binary rounding differs between engines on exact halves, decimals do not."""
    return F.round(x.cast("decimal(20,8)"), places).cast("double")


def truthy(x: Column) -> Column:
    """A flag that counts as true only where it is: null is false."""
    return F.coalesce(x.cast("boolean"), F.lit(False))


def filled(x: Column) -> Column:
    """The text, or null where it is empty, so that coalesce passes over both."""
    return F.nullif(x, F.lit(""))


def first_true(*rules: tuple[Column, str], default: str | None) -> Column:
    """The label of the first rule that holds."""
    return F.coalesce(*[F.when(test, F.lit(label)) for test, label in rules], F.lit(default))
