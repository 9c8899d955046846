"""Text columns: sizes, slugs, titles, prices and paths. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of units, with the millilitres (grams, for weights) of one. Blanks in them may be missing.
UNITS = {
    "ml": 1.0, "milliliter": 1.0, "milliliters": 1.0, "millilitre": 1.0, "millilitres": 1.0,
    "l": 1000.0, "liter": 1000.0, "liters": 1000.0, "litre": 1000.0, "litres": 1000.0,
    "oz": 29.5735, "fl oz": 29.5735, "fl oz.": 29.5735, "fl. oz": 29.5735, "fl. oz.": 29.5735,
    "fluid oz": 29.5735, "fluid oz.": 29.5735, "fluid ounce": 29.5735, "fluid ounces": 29.5735,
    "g": 1.0, "gm": 1.0, "gr": 1.0, "gram": 1.0, "grams": 1.0,
    "kg": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0,
}
NUMBER = r"(\d+(?:[.,]\d+)?)"
#: The longest spelling that fits counts.
UNIT = "(" + "|".join(s.replace(".", r"\.").replace(" ", r"\s*") for s in sorted(UNITS, key=lambda s: (-len(s), s))) + ")"
ARCHETYPES = [("/p/", "product"), ("/ingredient/", "ingredient"), ("/dupes/", "dupe"), ("/dupe/", "dupe"), ("/best/", "best"), ("/vs/", "vs"), ("/conflict/", "conflict"), ("/under/", "under")]


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounds a double half away from zero."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def number(x: Column) -> Column:
    return F.regexp_replace(x, ",", ".").cast("double")


def volume_ml(raw: Column, strict: bool = False) -> Column:
    """`2 x 50 ml`, else the first `1.7 fl oz`; a comma is a decimal point; null without a size. strict: the unit must
    end at a word's end."""
    tail = r"\b" if strict else ""
    text = F.regexp_replace(F.trim(raw), r"\s+", " ")
    multi, single = rf"(?i){NUMBER}\s*[x×]\s*{NUMBER}\s*{UNIT}{tail}", rf"(?i){NUMBER}\s*{UNIT}{tail}"

    def part(pattern, group):
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))

    def factor(unit):
        bare = {s.replace(" ", "").replace(".", ""): ml for s, ml in UNITS.items()}
        return F.try_element_at(F.create_map(*[F.lit(v) for pair in bare.items() for v in pair]), F.lower(F.regexp_replace(unit, r"[\s.]", "")))

    packs = number(part(multi, 1)) * number(part(multi, 2)) * factor(part(multi, 3))
    return half_up(F.coalesce(packs, number(part(single, 1)) * factor(part(single, 2))))


def slug_a(x: Column, collapse: bool = True) -> Column:
    """Letters and digits of any script stay; blanks and underscores become hyphens."""
    out = F.regexp_replace(F.regexp_replace(F.trim(F.lower(x)), r"(?U)[^\w\s-]", ""), r"(?U)[\s_]+", "-")
    return F.btrim(F.regexp_replace(out, "-+", "-") if collapse else out, F.lit("-"))


def slug_b(x: Column) -> Column:
    """ASCII slug of at most 100 characters; `product` if nothing is left."""
    return F.coalesce(F.nullif(F.left(F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(100)), F.lit("")), F.lit("product"))


def slug_c(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"\s+", "-")


def clean_title(title: Column, brand: Column) -> Column:
    """Drops a leading brand name, sizes and percentages."""
    has = F.coalesce(F.startswith(F.lower(F.trim(title)), F.lower(brand)), F.lit(False))
    text = F.when(has, F.substring(F.trim(title), F.length(brand) + 1, F.length(title))).otherwise(F.trim(title))
    text = F.regexp_replace(text, rf"(?i){NUMBER}\s*{UNIT}", "")
    text = F.regexp_replace(text, r"\d+(?:\.\d+)?\s*%", "")
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" ,;-+"))


def price_and_mrp(raw: Column) -> Column:
    """struct(price, mrp): the first number; the one after `mrp`, else a larger second number, else the price.
    599.00 for both where nothing can be read."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(low, ",", ""), F.lit(r"(\d+(?:\.\d+)?)")), lambda v: v.cast("double"))
    first, second = F.get(numbers, 0), F.get(numbers, 1)
    marked = F.nullif(F.regexp_extract(F.regexp_replace(low, ",", ""), r"mrp\D*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    unknown = first.isNull() | F.contains(low, F.lit("not confirmed")) | F.contains(low, F.lit("discontinued"))
    mrp = F.coalesce(marked, F.when(second > first, second), first)
    return F.struct(F.when(unknown, 599.0).otherwise(first).alias("price"), F.when(unknown, 599.0).otherwise(mrp).alias("mrp"))


def sheet_size_ml(raw: Column) -> Column:
    """The first number, times 29.57 for fluid ounces; 50 without one."""
    n = F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    return F.coalesce(half_up(n * F.when(F.contains(F.lower(raw), F.lit("fl oz")), 29.57).otherwise(1.0)), F.lit(50.0))


def relative_path(url: Column) -> Column:
    """Path and query of a URL, without its fragment; null for text that is none."""
    path, query = F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY"))
    return F.concat(path, F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""))


def archetype_from_path(path: Column) -> Column:
    out = F.lit("other")
    for prefix, name in reversed(ARCHETYPES):
        out = F.when(F.startswith(F.lower(path), F.lit(prefix)), name).otherwise(out)
    return out


def robots(score: Column, open_: Column) -> Column:
    return F.when((score >= 70) & open_, "index, follow").otherwise("noindex, follow")
