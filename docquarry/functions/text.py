"""Text expressions: normal forms, tokens, numbers, dates and list markers. All are built-in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of Lucene's English analyzer.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these "
    "they this to was will with"
).split()

# Words that a keyword query leaves out.
KEYWORD_STOP_WORDS = (
    "what when how who whom whose which where why whether is are was were be been being does do did can could must "
    "should will would may might shall has have had a an the of to in on at for by with from into about and or if then "
    "than that this these those it its they them their there i we you my our your any some such say says said tell me "
    "please also"
).split()

# Typographic ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

# Letters that some exports of one font show in place of ligatures.
BROKEN_LIGATURES = {"Ɵ": "ti", "Ō": "ft", "ƞ": "tf", "Ʃ": "tt"}

# Private-use code points, those of them that are bullets, and characters without ink.
PRIVATE_USE = r"[\uE000-\uF8FF]"
ICON_BULLETS = "\uf0a7\uf0b7"
ZERO_WIDTH = r"[\u200B-\u200D\u2060\uFEFF\u00AD]"
SPACE_LIKE = r"[\u00A0\u2000-\u200A\u202F\u205F\u3000\t]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once for each row: a lambda would else make it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_form(text: Column) -> Column:
    """Lower case, with each run of what is neither a-z nor 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def token_count(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def join_thousands(text: Column) -> Column:
    """1,234,567 -> 1234567."""
    return F.regexp_replace(text, r",(?<=\d,)(?=\d{3}\b)", "")


def analyzed(text: Column) -> Column:
    """Terms in order: lower case, thousands joined, runs of a-z and 0-9 with inner dots, without stop words."""
    terms = F.regexp_extract_all(join_thousands(F.lower(text)), F.lit(r"[a-z0-9]+(?:\.[a-z0-9]+)*"), F.lit(0))
    return F.filter(terms, lambda t: ~t.isin(STOP_WORDS))


def repaired(text: Column) -> Column:
    """struct(text, repairs): ligatures as letters, icons and zero-width characters dropped, spaces made plain."""
    out = text
    notes = []
    for bad, good in LIGATURES.items():
        notes.append(F.when(F.contains(text, F.lit(bad)), F.lit(f"ligature:{bad}->{good}")))
        out = F.replace(out, F.lit(bad), F.lit(good))
    bulleted = F.translate(out, ICON_BULLETS, "••")
    notes.append(F.when(bulleted.rlike(PRIVATE_USE), F.lit("private_use_glyphs_removed")))
    plain = F.regexp_replace(F.regexp_replace(bulleted, PRIVATE_USE, ""), ZERO_WIDTH, "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, SPACE_LIKE, " "), " {2,}", " "))
    return F.struct(plain.alias("text"), F.array_compact(F.array(*notes)).alias("repairs"))


def font_repaired(text: Column) -> Column:
    """struct(text, n): letters that stand for broken ligatures are replaced and counted."""
    out, n = text, F.lit(0)
    for bad, good in BROKEN_LIGATURES.items():
        n = n + F.regexp_count(text, F.lit(bad))
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.struct(out.alias("text"), n.alias("n"))


def without_tracking(url: Column) -> Column:
    """The URL without its utm_ parameters; an empty query loses its question mark, the fragment stays."""
    head, rest = F.substring_index(url, "#", 1), F.when(F.contains(url, F.lit("#")), F.substring(url, F.instr(url, "#"), F.length(url))).otherwise("")
    base = F.substring_index(head, "?", 1)
    query = F.when(F.instr(head, "?") > 0, F.substring(head, F.instr(head, "?") + 1, F.length(head)))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.startswith(p, F.lit("utm_"))), "&")
    return F.concat(base, F.when(query.isNull() | (kept == ""), F.lit("")).otherwise(F.concat(F.lit("?"), kept)), rest)


def numbers(text: Column) -> Column:
    """Distinct canonical numbers: no thousands separators, no .00, no leading zeros."""
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))

    def canonical(n: Column) -> Column:
        n = F.regexp_replace(n, ",", "")
        n = F.regexp_replace(n, r"^(\d+)\.0+$", "$1")
        return F.when(n.rlike(r"^\d+$"), F.regexp_replace(n, r"^0+(?=\d)", "")).otherwise(n)

    return F.array_distinct(F.transform(found, canonical))


def keyword_query(text: Column) -> Column:
    """Words without punctuation at their edges and without function words."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    # fixed values: punctuation at the edges of words
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"^[\"'“”‘’(\[]+", ""), r"[\"'“”‘’)\],.;:?!]+$", ""))
    return F.array_join(F.filter(bare, lambda w: (w != "") & ~F.lower(w).isin(KEYWORD_STOP_WORDS)), " ")


def slug(text: Column, most: int = 48) -> Column:
    """a-z, 0-9 and single hyphens, cut at the last hyphen within so many characters."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.substring(plain, 1, most)
    return F.when(F.length(plain) <= most, plain).otherwise(F.when(F.instr(cut, "-") > 0, F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut))


def list_marker(text: Column) -> Column:
    """bullet, ordered or null: how a line begins, if something follows the marker."""
    # fixed values: bullets, and enumerators
    rest = [r"^([•◦▪▫●○■□‣⁃∙·*]|[-–](?=\s))\s*(?=.)", r"^(\d{1,4}(\.\d{1,3})+\.?)\s+(?=.)|^\d{1,3}[.)]\s+(?=.)|^\(\d{1,3}\)\s*(?=.)|^\(?[ivxlc]{1,5}[.)]\s+(?=.)|^\(?[a-z][.)]\s+(?=.)|^[A-Z]{1,3}\d{1,3}(\.\d{1,3})*\.?\s+(?=.)"]
    return F.when(text.rlike(rest[0]), "bullet").when(text.rlike(rest[1]), "ordered")


def clause_number(number: Column, marker: Column | None = None) -> Column:
    """struct(parts, kind) of an enumerator: decimal, integer or prefixed; null for anything else, and for what is marked by
    brackets, which numbers a list. A trailing .0 goes."""
    if marker is not None:
        number = F.when(~F.startswith(F.coalesce(marker, F.lit("")), F.lit("(")), number)
    # fixed values: patterns of clause numbers
    n = F.regexp_replace(number, r"\.+$", "")
    parts = F.split(F.regexp_replace(n, r"(\.0)+$", ""), r"\.")
    decimal, prefixed, integer = n.rlike(r"^\d{1,4}(\.([1-9]\d?|0))+$"), n.rlike(r"^[A-Z]{1,3}\d{1,3}(\.[1-9]\d?)*$"), n.rlike(r"^\d{1,4}$")
    kind = F.when(decimal, F.when(F.size(parts) > 1, "decimal").otherwise("integer")).when(prefixed, "prefixed").when(integer, "integer")
    return F.when(decimal, F.struct(parts.alias("parts"), kind.alias("kind"))).when(prefixed | integer, F.struct(F.split(n, r"\.").alias("parts"), kind.alias("kind")))


def iso_day(text: Column) -> Column:
    """The date of a whole ISO day; null for a month, a year or anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
