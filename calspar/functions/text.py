"""Address text as Catalyst expressions: villages, streets, house numbers, labels, comparison forms."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

STREET = "struct<street:string,house_numbers:string>"
# Patterns on which results depend letter by letter. How a street carries house numbers, in the order they
# are tried; what tells house numbers; what makes a cell hard (the fifth unless the sixth holds, too; the eighth only
# beside brackets, the ninth only without); how a district is named.
STREET_FORMS = [
    r"^(.+?)\s*,\s*\((.+)\)\s*$",
    r"^(.+?)\s+\((.+)\)\s*$",
    r"^(.+?\s+g\.?)\s+(.+)$",
    r"^(.+?)\s*,\s*(nuo\s+.+)$",
]
HOUSE_NUMBERS = r"\d|nuo|iki|Nr"
HARD_FORMS = [
    r"\bnuo\b.*\biki\b",
    r"\bNr\.?\s*\d+",
    r"\d+-\d+[A-Z]?",
    r"[a-ząčęėįšųūž]+\.?\s+\d+[,\s]+\d+",
    r"[a-ząčęėįšųūž]+\.?\s+\d+",
    r"[a-ząčęėįšųūž]+\.?\s+\d+-oji",
    r"[a-ząčęėįšųūž]+\.\s+[A-ZĄČĘĖĮŠŲŪŽ]",
    r"\)\s+[A-ZĄČĘĖĮŠŲŪŽ]",
    r"[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+\s+[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+\.?\s+g\.",
]
ANY_CASE = [0, 1, 3, 4, 5]  # of HARD_FORMS
DISTRICT_SUFFIX = r"sen\.?|seniūnija|seniunija|seniūnijos"
DISTRICT_NAME = r"[A-ZĄČĘĖĮŠŲŪŽ][A-Za-zĄČĘĖĮŠŲŪŽąčęėįšųūž\-\s]{1,60}?"
# Villages whose names are written short.
SHORT_VILLAGES = {r"^D\.\s*Riešės\b": "Didžiosios Riešės", r"^M\.\s*Riešės\b": "Mažosios Riešės"}
# Endings that comparison strips, in the order they are tried.
ENDINGS = ["iai", "ai", "iu", "u", "es", "os", "as", "is", "ys", "us", "e", "a", "i", "o"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_cell(c: Column) -> Column:
    """Null as '', runs of white space as one space, trimmed."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def part(c: Column, pattern: str, group: int) -> Column:
    return strip(F.regexp_extract(c, pattern, group))


def street(c: Column) -> Column:
    """(street, house_numbers) of a street's text by the first of STREET_FORMS that it has; without one, all of it is the street. Blank: ('', null)."""
    s = strip(F.coalesce(c, F.lit("")))
    alone = F.struct(s.alias("street"), F.lit(None).cast("string").alias("house_numbers"))
    out = F.when(F.lit(False), alone)
    for k, form in enumerate(STREET_FORMS):
        form = f"(?iu){form}" if k == 3 else form
        holds = s.rlike(form) & (F.regexp_extract(s, form, 2).rlike(f"(?iu){HOUSE_NUMBERS}") if k == 2 else F.lit(True))
        out = out.when(holds, F.struct(part(s, form, 1).alias("street"), F.nullif(part(s, form, 2), F.lit("")).alias("house_numbers")))
    return out.otherwise(alone)


def top_level_parts(c: Column) -> Column:
    """Parts between commas outside brackets, trimmed, without blank ones. Brackets nest to any depth."""
    # fold over comma pieces: a piece joins the one before while brackets are open
    opened = lambda x: F.length(x) - F.length(F.replace(x, F.lit("("), F.lit("")))
    closed = lambda x: F.length(x) - F.length(F.replace(x, F.lit(")"), F.lit("")))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("depth"))

    def step(acc: Column, piece: Column) -> Column:
        text = F.when(acc["open"].isNull(), piece).otherwise(F.concat(acc["open"], F.lit(","), piece))
        depth = acc["depth"] + opened(piece) - closed(piece)
        ends = depth == 0
        return F.struct(
            F.when(ends, F.concat(acc["done"], F.array(text))).otherwise(acc["done"]).alias("done"),
            F.when(~ends, text).alias("open"),
            depth.cast("int").alias("depth"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    pieces = F.aggregate(F.split(c, ","), zero, step, finish)
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def location(c: Column) -> Column:
    """(village, streets) of a location cell: "village (street, street, ...)"; null for a blank cell."""
    s = strip(c)
    pattern = r"(?s)^([^\n]+?)\s*\(([^\n]+)\)\s*$"
    streets = F.filter(F.transform(top_level_parts(part(s, pattern, 2)), street), lambda x: x["street"] != "")
    listed = F.struct(part(s, pattern, 1).alias("village"), streets.alias("streets"))
    alone = F.struct(s.alias("village"), F.array().cast(f"array<{STREET}>").alias("streets"))
    return F.when(F.coalesce(c, F.lit("")) == "", None).when(s.rlike(pattern), listed).otherwise(alone)


def is_complex(c: Column) -> Column:
    """Whether a location cell needs more than the rules: house numbers, missing commas, streets outside brackets."""
    has = [c.rlike(f"(?iuU){p}" if k in ANY_CASE else p) for k, p in enumerate(HARD_FORMS)]
    brackets = c.contains("(")
    numbered = has[4] & ~has[5]
    return has[0] | has[1] | has[2] | has[3] | numbered | has[6] | F.when(brackets, has[7]).otherwise(has[8])


def suspicious_village(v: Column) -> Column:
    """Whether a village name looks like leftover street text."""
    streets = (F.length(v) - F.length(F.replace(v, F.lit("g."), F.lit("")))) / 2
    return v.contains("(") & v.contains("g.") | (streets > 1) | v.contains(",") & v.contains("g.") & ~v.startswith("(")


def house_numbers(c: Column) -> Column:
    """Compact form: "nuo A iki B" as A-B, "nuo A" as ≥A, "iki B" as ≤B, lists without spaces; null for nothing of use."""
    h = strip(F.coalesce(c, F.lit("")))

    def without(x: Column, *words: str) -> Column:
        for w in words:
            x = F.replace(x, F.lit(w), F.lit(""))
        return strip(x)

    def span(x: Column) -> Column:
        start = F.regexp_replace(without(F.substring_index(x, " iki ", 1), "nuo ", "Nr.", "Nr"), ", ", ",")
        end = strip(F.substring_index(F.substring(x, F.instr(x, " iki ") + 5, F.length(x)), ",", 1))
        return F.concat(start, F.lit("-"), end)

    parts = F.transform(F.filter(F.split(h, ", nuo "), lambda p: p.contains(" iki ")), span)
    ranges = F.when(F.size(parts) > 0, F.array_join(parts, ","))
    plain = F.regexp_replace(F.regexp_replace(without(h, "nuo ", "iki ", "Nr.", "Nr"), ", ", ","), " ,", ",")
    upto, onward = without(h, "iki ", "Nr.", "Nr"), without(h, "nuo ", "Nr.", "Nr")
    out = (
        F.when((F.length(h) <= 1) & ~h.rlike(r"(?U)^\d$"), None)
        .when(h.startswith("iki "), F.when(upto != "", F.concat(F.lit("≤"), upto)))
        .when(h.startswith("nuo ") & ~h.contains(" iki "), F.when(onward != "", F.concat(F.lit("≥"), onward)))
        .when(h.contains(" iki "), ranges)
        .otherwise(F.nullif(plain, F.lit("")))
    )
    return F.when(out.contains("≥") & out.contains("-"), F.replace(out, F.lit("≥"), F.lit(""))).otherwise(out)


def waste_type(c: Column) -> Column:
    s = F.lower(c)
    return F.when(s.contains("pak"), "plastikas").when(s.contains("stikl"), "stiklas").otherwise("bendros")


def waste_label(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(s.contains("pak"), "Pakuotė").when(s.contains("stikl"), "Stiklas").otherwise(strip(F.coalesce(c, F.lit(""))))


def label_of_file(name: Column) -> Column:
    s = F.lower(name)
    return F.when(s.rlike("glass|stiklas"), "Stiklas").when(s.rlike("plast|pakuot"), "Pakuotė").otherwise("")


def village_name(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    for short, full in SHORT_VILLAGES.items():
        s = F.regexp_replace(s, f"(?U){short}", full)
    return strip(F.regexp_replace(s, r"\s{2,}", " "))


def district_base(c: Column) -> Column:
    """A district label without its suffix, in lower case."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\s{2,}", " ")
    s = F.regexp_replace(s, rf"(?iu)\s+({DISTRICT_SUFFIX})\s*\.?$", "")
    return F.lower(F.regexp_replace(s, r"^[ ,:\t\n]+|[ ,:\t\n]+$", ""))


def district_labels(c: Column) -> Column:
    """Districts that a cell names, as "<name> sen.", in order, each base once."""
    name = DISTRICT_NAME
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?iu)({name})\s+(?:{DISTRICT_SUFFIX})(?=\s|$|:)"), 1)
    names = F.filter(F.transform(found, lambda n: F.regexp_replace(n, r"^[ ,:\n\t]+|[ ,:\n\t]+$", "")), lambda n: n != "")
    labels = F.transform(names, lambda n: F.concat(n, F.lit(" sen.")))
    bases = F.transform(labels, district_base)
    return F.filter(labels, lambda _, i: F.array_position(bases, F.get(bases, i)) == i + 1)


@cache
def unmarked() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the same without, by their Unicode decomposition."""
    pairs = [(chr(k), unicodedata.normalize("NFKD", chr(k))) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for k in range(a, b)]
    found = [(c, d[0]) for c, d in pairs if c == c.lower() and len(d) > 1 and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in found) + "\u00a0", "".join(d for _, d in found) + " "


def fold(c: Column) -> Column:
    """Lower case without the marks of Latin letters, punctuation as spaces, trimmed: the form in which names are compared."""
    s = F.regexp_replace(F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), *unmarked()), r"\p{M}+", "")
    return strip(F.regexp_replace(s, r'[.,;()"]', " "))


def compared(c: Column, suffixes: list[str], strict: bool) -> Column:
    """fold() and, unless strict, without the given words and with single spaces."""
    s = fold(c)
    if strict:
        return s
    words = "|".join(sorted(suffixes, key=len, reverse=True))
    return strip(F.regexp_replace(F.regexp_replace(s, rf"(?U)\b({words})\b", " "), r"\s+", " "))


def compared_houses(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(s.isin("all", "all."), "").otherwise(F.replace(s, F.lit(" "), F.lit("")))


def stem(c: Column) -> Column:
    """fold() without the first ending of ENDINGS that it has, if more than one letter is left."""
    return F.regexp_replace(fold(c), rf"(?s)^(.{{2,}}?)({'|'.join(ENDINGS)})$", "$1")


def like_ascii(c: Column, query: Column) -> Column:
    """Substring search that folds ASCII case only and leaves % and _ of the query active."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.like(F.translate(c, up, low), F.concat(F.lit("%"), F.translate(query, up, low), F.lit("%")))


def unfenced(c: Column) -> Column:
    """JSON text without a Markdown code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
