"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def in_reading_order(name: Column | str) -> Column:
    """A name as a sort key in the order of the Unicode collation: letters first, then accents, then case, so that "éa" stands between "ea" and "eb"."""
    return F.collate(col(name), "UNICODE")


def canonical_zone(name: Column | str) -> Column:
    """A zone's name without a trailing "County"."""
    return F.trim(F.regexp_replace(col(name), r"(?i)\s*County$", ""))


def loose_key(name: Column | str) -> Column:
    """Joins names that differ in case, dashes, apostrophes and spaces."""
    return F.regexp_replace(F.lower(col(name)), r"[-–—'’\s]+", "")


def alnum_key(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(name)), r"[^a-z0-9]", "")


def normalised(s: Column | str) -> Column:
    """Lower case; other characters than a-z, digits and white space become spaces; single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(s)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def title_key(title: Column | str) -> Column:
    return F.substring(alnum_key(title), 1, 90)


def slug(s: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(s)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stem(word: Column) -> Column:
    """Without one of the suffixes ed, es, s, ion, ing."""
    return F.regexp_replace(word, "(ed|es|s|ion|ing)$", "")


def tokens(s: Column | str) -> Column:
    """Words of letters and apostrophes, case kept."""
    spaced = F.trim(F.regexp_replace(F.coalesce(col(s), F.lit("")), "[^A-Za-z']+", " "))
    return F.filter(F.split(spaced, " +"), lambda x: x != "")


def without(words: Column, stop: list[str]) -> Column:
    held = F.array(*(F.lit(x) for x in stop)) if stop else F.array().cast("array<string>")
    return F.filter(words, lambda x: ~F.array_contains(held, x))


def bigram_set(words: Column) -> Column:
    """Distinct pairs of successive words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def set_cosine(a: Column, b: Column) -> Column:
    product = F.size(a) * F.size(b)
    return F.size(F.array_intersect(a, b)) / F.sqrt(F.when(product == 0, F.lit(1)).otherwise(product).cast("double"))


def strip_outlet(title: Column | str) -> Column:
    """A headline without the " - Outlet" that feeds append."""
    return F.trim(F.regexp_replace(col(title), r"\s+[-–—]\s+[^-–—]{2,40}$", ""))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms that a text contains, in the order given."""
    low = F.lower(text)
    return F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(low, t))


def decode_entities(s: Column | str) -> Column:
    """The named entities of feeds, and numeric ones of the basic plane."""
    out = col(s)
    out = _numeric(out, r"&#(\d{1,7});", 10)
    out = _numeric(out, r"&#x([0-9a-fA-F]{1,6});", 16)
    for name, plain in (("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(name), F.lit(plain))
    return out


def _numeric(s: Column, pattern: str, base: int) -> Column:
    """Each distinct numeric entity of a text is replaced in turn; texts without one are not touched."""
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)))
    prefix = "&#" if base == 10 else "&#x"

    def one(acc: Column, code: Column) -> Column:
        point = F.conv(code, base, 10).cast("long")
        utf32 = F.lpad(F.hex(point), 8, "0")
        return F.replace(acc, F.concat(F.lit(prefix), code, F.lit(";")), F.coalesce(F.decode(F.unhex(utf32), "UTF-32"), F.lit("")))

    return F.when(s.rlike(pattern), F.aggregate(found, s, one)).otherwise(s)


def strip_tags(s: Column | str) -> Column:
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(col(s), "<[^>]+>", "")), r"\s+", " "))
