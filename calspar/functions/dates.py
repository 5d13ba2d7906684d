"""Month and day cells as dates."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they head columns, by number, and other spellings of them.
MONTHS = ["Sausio", "Vasario", "Kovo", "Balandžio", "Gegužės", "Birželio", "Liepos", "Rugpjūčio", "Rugsėjo", "Spalio", "Lapkričio", "Gruodžio"]
OTHER_SPELLINGS = {
    1: ["sausis"], 2: ["vasaris"], 3: ["kovas"], 4: ["balandis"], 5: ["gegužė", "gegužes"], 6: ["birželis", "birzelis"],
    7: ["liepa"], 8: ["rugpjūtis", "rugpjucio"], 9: ["rugsėjis", "rugsejo"], 10: ["spalis"], 11: ["lapkritis"], 12: ["gruodis"],
}


def spellings() -> dict[str, str]:
    """Every accepted lower-case spelling -> the canonical name."""
    out = {name.lower(): name for name in MONTHS}
    out |= {other: MONTHS[k - 1] for k, others in OTHER_SPELLINGS.items() for other in others}
    return out


def lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def month_name(header: Column) -> Column:
    """Canonical month name of a header cell, or null."""
    bare = F.regexp_replace(F.lower(F.trim(header)), r"(?U)[^\w]+", "")
    return F.try_element_at(lookup(spellings()), bare)


def month_number(name: Column) -> Column:
    return F.try_element_at(lookup({m: k + 1 for k, m in enumerate(MONTHS)}), name)


def cell_dates(cell: Column, month: Column, year: int = 2026, with_suffix: bool = False) -> Column:
    """Sorted distinct dates of the day numbers in a cell; month is a canonical name. Days that the month lacks are dropped.

    with_suffix: only numbers followed by "d." count.
    """
    pattern, group = (r"\b(\d{1,2})\s*d\.", 1) if with_suffix else (r"(\d+)", 1)
    tokens = F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(pattern), group)
    days = F.filter(F.transform(tokens, lambda t: t.try_cast("int")), lambda d: d.between(1, 31))
    number = month_number(month)
    dates = F.transform(days, lambda d: F.format_string(f"{year}-%02d-%02d", number, d).try_cast("date"))
    none = F.array().cast("array<date>")
    return F.when(number.isNull(), none).otherwise(F.array_sort(F.array_distinct(F.filter(dates, lambda d: d.isNotNull()))))


def day_list(days: Column) -> Column:
    """Day numbers as "2 d., 16 d."."""
    return F.array_join(F.transform(days, lambda d: F.concat(d.cast("string"), F.lit(" d."))), ", ")


def as_dates(values: Column) -> Column:
    """ISO strings as dates; anything else is dropped."""
    return F.filter(F.transform(values, lambda v: v.try_cast("date")), lambda d: d.isNotNull())


def load_dates(text: Column) -> Column:
    """A JSON array of ISO dates; broken JSON gives none."""
    return F.coalesce(as_dates(F.from_json(text, "array<string>")), F.array().cast("array<date>"))


def pending_until(now: Column) -> Column:
    return now + F.expr("INTERVAL 4 DAYS")


def grid_offset(day: Column) -> Column:
    """Cells before the first day of a month in a Monday-first grid."""
    return F.weekday(F.trunc(day, "month"))


def event_times(day: Column, zone: str = "Europe/Vilnius", first: int = 7, last: int = 9) -> tuple[Column, Column]:
    """An event's start and end, from the first to the last hour, local time; a pick-up's is 07:00 to 09:00."""

    def at(hour: int) -> Column:
        return F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.lit(hour), F.lit(0), F.lit(0), F.lit(zone))

    return at(first), at(last)
