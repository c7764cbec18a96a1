"""Quantities with units and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from statloom.functions.text import clean_text

# Factor to kilograms.
MASS_TO_KG = {
    "kg": 1.0, "kilogram": 1.0, "kilograms": 1.0,
    "g": 0.001, "gram": 0.001,
    "lb": 0.45359237, "lbs": 0.45359237, "pound": 0.45359237, "pounds": 0.45359237,
    "st": 6.35029318, "stone": 6.35029318,
    "tonne": 1000.0, "t": 1000.0,
}

# Factor to centimetres.
LENGTH_TO_CM = {
    "cm": 1.0, "mm": 0.1, "m": 100.0, "meter": 100.0, "metre": 100.0,
    "in": 2.54, "inch": 2.54, "inches": 2.54,
    "ft": 30.48, "foot": 30.48, "feet": 30.48,
}

MTOE_TO_PJ = 41.868

QUANTITY = r"^\s*([+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*([a-zA-Z°µ/²³%]+)\s*$"


def _double_map(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def quantity_parts(t: Column) -> dict[str, Column]:
    """number and unit of clean text such as '10 kg', NULL if it is not one.

    A comma is a decimal comma. No match is the empty text and NULL: casting it would raise and catch an error per cell.
    """
    digits = F.nullif(F.regexp_extract(t, QUANTITY, 1), F.lit(""))
    number = F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")
    return {"number": number, "unit_name": F.lower(F.regexp_extract(t, QUANTITY, 2))}


def quantity_kind(unit: Column) -> Column:
    """mass_kg, length_cm or NULL."""
    return F.when(unit.isin(*MASS_TO_KG), "mass_kg").when(unit.isin(*LENGTH_TO_CM), "length_cm")


def quantity_value(number: Column, unit: Column) -> Column:
    """Amount in kg or cm."""
    return number * F.try_element_at(_double_map({**MASS_TO_KG, **LENGTH_TO_CM}), unit)


def embedded_quantity(c: Column) -> Column:
    """struct(kind, value) of a cell such as '10 kg'; both NULL if it is not one."""
    parts = quantity_parts(clean_text(c))
    value = quantity_value(parts["number"], parts["unit_name"])
    return F.struct(quantity_kind(parts["unit_name"]).alias("kind"), value.alias("value"))


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32.0) * 5.0 / 9.0


def fahrenheit_cell(c: Column) -> Column:
    """Celsius value of a cell that says Fahrenheit, else NULL."""
    t = F.lower(clean_text(c))
    number = F.regexp_extract(t, r"([+-]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    says_f = t.rlike("°f|℉|fahrenheit")
    return F.when(says_f & (number.isNotNull()), fahrenheit_to_celsius(number))


def mtoe_to_pj(c: Column) -> Column:
    return c * MTOE_TO_PJ


def millions(c: Column) -> Column:
    return c * 1e6


def thousands(c: Column) -> Column:
    return c * 1000.0
