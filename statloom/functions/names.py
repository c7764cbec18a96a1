"""What a column name says about its content (decided when the plan is built)."""

from __future__ import annotations

# Name fragments.
CURRENCY_HINTS = ("price", "cost", "revenue", "gbp", "usd", "eur", "£", "fee")
TEMPERATURE_HINTS = ("temp",)
NON_NEGATIVE_HINTS = ("count", "number", "install", "price", "mw", "gwh")
DATE_HINTS = ("date", "year", "month", "quarter", "period")
METADATA_SHEET_HINTS = (
    "notes", "contents", "cover", "metadata", "table_of_contents", "about",
    "source", "commentary", "assumptions", "charts_data_hide", "chart_data_hide",
)

# Unit hint -> (lowest, highest plausible value, label).
UNIT_RANGES = {
    "_mw": (0.0, 5e6, "MW (national capacity rarely > 5e6 MW)"),
    "_gw": (0.0, 5e3, "GW"),
    "_kw": (0.0, 1e9, "kW"),
    "_mwh": (0.0, 5e10, "MWh"),
    "_gwh": (0.0, 5e7, "GWh"),
    "_twh": (0.0, 5e4, "TWh"),
    "_tj": (0.0, 1e10, "TJ"),
    "_pj": (0.0, 1e6, "PJ"),
    "_mtoe": (0.0, 1e4, "Mtoe"),
    "_gbp": (-1e12, 1e12, "GBP"),
    "_usd": (-1e13, 1e13, "USD"),
    "_eur": (-1e13, 1e13, "EUR"),
    "_pct": (-100.0, 100.0, "percent"),
    "_kg": (0.0, 1e9, "kg"),
    "year": (1500.0, 2100.0, "calendar year"),
}


def _has(name: str, hints: tuple[str, ...]) -> bool:
    low = name.lower()
    return any(h in low for h in hints)


def suggests_currency(name: str) -> bool:
    return _has(name, CURRENCY_HINTS)


def suggests_temperature(name: str) -> bool:
    return _has(name, TEMPERATURE_HINTS)


def suggests_non_negative(name: str) -> bool:
    return _has(name, NON_NEGATIVE_HINTS)


def suggests_date(name: str) -> bool:
    return _has(name, DATE_HINTS)


def unit_hint(name: str, longest: bool = True) -> str | None:
    """Unit hint in a column name.

    The longest hint wins, so that ``_gwh`` is not taken for ``_gw``;
    ``longest=False`` takes the first in table order instead.
    """
    found = [h for h in UNIT_RANGES if h in name.lower()]
    if not found:
        return None
    return max(found, key=len) if longest else found[0]


def is_shadow(name: str) -> bool:
    return name.startswith("raw__")


def is_flag(name: str) -> bool:
    return name.endswith("_flag")


def is_iso_date(name: str) -> bool:
    return name.endswith("_iso_date")


def is_housekeeping(name: str) -> bool:
    return is_shadow(name) or is_flag(name) or is_iso_date(name)


def data_columns(names: list[str]) -> list[str]:
    """Columns that carry data: no raw shadow, no flag, no ISO helper."""
    return [n for n in names if not is_housekeeping(n)]
