"""Sections of tables with repeated, split or missing headings, as rows of schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from .store import in_files

# What headings and labels are known by, and sentences that aren't places.
LABELS, WASTE, PACK, GLASS = ["seniūn", "gyvenviet", "pavadinimas"], "atliek", "Pakuotė", "Stiklas"
MARKERS = [" sen.", " m.", " k.", " vs."]
HEADING_WORDS = ["Seniūnijos", "pavadinimas", "Atliekos"]
SENTENCES = ["Konteineriai tuštinimo dieną", "organizuojamas atliekų surinkimo maršrutas", "neaptarnautą konteinerį", "Parengė :"]
FIRST_HEADING = "Seniūnijos pavadinimas (gyvenvietės pavadinimas)"

KEY = ["doc", "t"]


def holds(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def has_months(line: Column) -> Column:
    return line.rlike("|".join(dates.spellings()))


def is_heading(line: Column) -> Column:
    return holds(line, LABELS) & (line.contains(WASTE) | has_months(line))


def parted(rows: DataFrame) -> DataFrame:
    """rows (doc, t, r, cells) with clean cells; a heading that swallowed its first row of data becomes two rows, told apart by `half`."""
    clean = rows.select(*KEY, "r", F.transform("cells", text.clean_cell).alias("cells"))
    line = text.strip(F.array_join(F.filter("cells", lambda c: c != ""), " "))
    fused = is_heading(F.lower(line)) & line.rlike(rf"(?U)\b({PACK}|{GLASS})\b") & line.rlike(r"\b\d{1,2}\s*d\.") & holds(line, MARKERS)
    words = rf"(?U)\b\d{{4}}\s*m\.|Seniūnijos pavadinimas\s*\(gyvenvietės pavadinimas\)|\b(Atliekos|{'|'.join(dates.MONTHS[:3])})\b"
    rest = text.clean_cell(F.regexp_replace(line, words, " "))
    heading = F.transform("cells", lambda c, i: F.when(i == 0, FIRST_HEADING).otherwise(c))
    data = F.transform("cells", lambda c, i: F.when(i == 0, rest).otherwise(""))
    halves = F.when(fused, F.array(heading, data)).otherwise(F.array(F.col("cells")))
    return clean.select(*KEY, "r", F.posexplode(halves).alias("half", "cells"))


def in_sections(rows: DataFrame) -> DataFrame:
    """parted rows -> (doc, t, section, r, half, cells, heading) of data rows.

    A heading row starts a section; rows above the first one form section 0 under its heading. A heading without month
    names takes those of the row below it where its own cells are blank. A table without a heading row goes on with the
    heading of the table before it if both are as wide, and else has the default one, or is left out if it is wider.
    """
    order = Window.partitionBy(*KEY).orderBy("r", "half")
    line = F.lower(F.array_join(F.filter("cells", lambda c: c != ""), " "))
    flagged = rows.withColumn("is_head", is_heading(line)).withColumn("has_months", has_months(line))
    below = F.when(~F.col("has_months") & F.coalesce(F.lead("has_months").over(order), F.lit(False)), F.lead("cells").over(order))
    bare = lambda c: text.strip(F.regexp_replace(c, r"\b\d{4}\s*m\.", ""))
    merged = F.zip_with("cells", F.coalesce(below, F.col("cells")), lambda a, b: F.when(bare(a) != "", bare(a)).otherwise(bare(b)))
    named = flagged.withColumn("heading", F.when(F.col("is_head"), merged)).withColumn("section", F.sum(F.col("is_head").cast("int")).over(order))
    named = in_files(named)  # read three times: pages are parsed once

    table = named.groupBy(*KEY).agg(F.max(F.size("cells")).alias("width"), F.min_by("heading", F.when(F.col("is_head"), F.struct("r", "half"))).alias("first"), F.max_by("heading", F.when(F.col("is_head"), F.struct("r", "half"))).alias("last"))
    tables = Window.partitionBy("doc").orderBy("t")
    starts = F.col("last").isNotNull() | ~F.lag("width").over(tables).eqNullSafe(F.col("width"))
    table = table.withColumn("run", F.sum(starts.cast("int")).over(tables))
    carried = F.first("last").over(Window.partitionBy("doc", "run").orderBy("t"))
    default = F.slice(F.array(F.lit(FIRST_HEADING), F.lit("Atliekos"), *map(F.lit, dates.MONTHS)), F.lit(1), F.col("width"))
    table = table.withColumn("base", F.coalesce("first", carried, F.when(F.col("width") <= 2 + len(dates.MONTHS), default)))
    joined = named.join(table.select(*KEY, "base"), KEY).filter("base is not null and not is_head")
    own = named.filter("is_head").select(*KEY, "section", F.col("heading").alias("own"))
    return joined.drop("heading").join(own, [*KEY, "section"], "left").select(*KEY, "section", "r", "half", "cells", F.coalesce("own", "base").alias("heading"))


def table_schedules(rows: DataFrame, year: int = 2026, file_label: Column | None = None) -> DataFrame:
    """rows (doc, t, r, cells) -> (doc, t, section, r, location, waste_type, dates, error).

    The first column is the place, the second the waste label if its heading says so, the others are months from January
    on, by their place. Rows that aren't places are left out; a missing label is the last one in the section, or the file's;
    a row without days is the start of the next one's place if that has days. error: month names where others belong.
    """
    data = in_sections(parted(rows))
    section = [*KEY, "section"]
    order = Window.partitionBy(*section).orderBy("r", "half")
    whole = Window.partitionBy(*section)
    cell = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    names = F.array(*map(F.lit, dates.MONTHS))
    width = F.size("heading")
    allowed = F.slice(names, F.lit(1), F.greatest(width - 2, F.lit(0)))
    found = F.array_compact(F.transform("cells", dates.month_name))
    has_label = F.lower(F.coalesce(F.get("heading", F.lit(1)), F.lit(""))).contains(WASTE)
    base = data.select(*section, "r", "half", width.alias("width"), cell(0).alias("location"), F.when(has_label, cell(1)).otherwise("").alias("label"), has_label.alias("labelled"),
        F.transform(F.slice("cells", F.lit(3), F.greatest(F.size("cells") - 2, F.lit(0))), lambda c: c).alias("months"), F.max(F.size(F.array_except(found, allowed))).over(whole).alias("odd"))
    month = lambda k: F.coalesce(F.get("months", F.lit(k)), F.lit(""))
    shift = (F.col("width") == 4) & (F.max(month(0) != "").over(whole)) & ~(F.max(month(1) != "").over(whole))
    base = base.withColumn("months", F.when(shift, F.array(F.lit(""), month(0))).otherwise(F.col("months")))

    place = F.col("location")
    other = (place == "") | holds(place, HEADING_WORDS) | place.isin(PACK, GLASS) | dates.month_name(place).isNotNull() | holds(place, SENTENCES)
    kept = base.filter(~other)
    inside = F.nullif(F.regexp_extract("location", rf"({PACK}|{GLASS})", 1), F.lit(""))
    own = F.nullif(text.waste_label(F.when(F.col("labelled"), F.col("label")).otherwise(F.coalesce(inside, F.lit("")))), F.lit(""))
    own = F.when(own.isin(PACK, GLASS), own)
    label = F.coalesce(F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), file_label if file_label is not None else F.lit(None).cast("string"))
    kept = kept.withColumn("waste", label).withColumn("location", F.when(F.col("labelled"), F.col("location")).otherwise(text.clean_cell(F.regexp_replace("location", rf"{PACK}|{GLASS}", " "))))

    blank = ~F.exists("months", lambda c: c != "")
    kept = kept.withColumn("blank", blank)
    before, after = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))
    joins = F.col("blank") & F.coalesce(~after("blank"), F.lit(False))
    kept = kept.select("*", joins.alias("joins"), (~F.col("blank") & F.coalesce(before("blank"), F.lit(False))).alias("joined"), after("location").alias("more"), after("months").alias("next"))
    kept = kept.filter("not joined")
    kept = kept.withColumn("location", F.when(F.col("joins"), F.concat_ws(" ", "location", "more")).otherwise(F.col("location"))).withColumn("months", F.when(F.col("joins"), F.col("next")).otherwise(F.col("months")))
    every = F.array_sort(F.array_distinct(F.concat(*[dates.cell_dates(F.coalesce(F.get("months", F.lit(k)), F.lit("")), F.lit(m), year) for k, m in enumerate(dates.MONTHS)])))
    error = F.when(F.col("odd") > 0, "unexpected month headers").when(~F.exists("months", lambda c: c != ""), "no month values")
    out = kept.select(*section, "r", "location", F.when(F.col("waste").isNotNull(), text.waste_type(F.col("waste"))).otherwise("bendros").alias("waste_type"), F.struct(every.alias("dates"), error.alias("error")).alias("x"))
    return out.select(*section, "r", "location", "waste_type", "x.dates", "x.error")
