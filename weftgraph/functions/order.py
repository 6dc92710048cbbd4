"""Numbers that keep documents, text units and what they hold in order.

An order of documents is any bigint, as ids without a number are ordered by their hash. A unit's order is that number and the
place within the document, an entity's that of its unit and the place within the unit, as one decimal: with 64 bits times 10^9
places times 10^6 places it always fits 38 digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS, PLACES = 10**9, 10**6


def _after(order: Column, place: Column, slots: int, digits: int) -> Column:
    return (order.cast(f"decimal({digits},0)") * F.lit(slots).cast("decimal(10,0)") + place.cast("decimal(10,0)")).cast("decimal(38,0)")


def unit_order(document: Column, chunk: Column) -> Column:
    return _after(document, chunk, UNITS, 20)


def place_order(unit: Column, place: Column) -> Column:
    return _after(unit, place, PLACES, 28)
