"""Text normalisation as Column expressions: locale-aware case, comparison keys, white space and mis-decoded characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a plain counterpart, in order.
ACCENTED, PLAIN = "çğıöşüÇĞİÖŞÜâîûÂÎÛ", "cgiosuCGIOSUaiuAIU"
#: What stands for a missing value, lower-cased.
PLACEHOLDERS = ["", "null", "none", "nan", "-", "--", "yok", "n/a", "na", "?", "bilinmiyor", "0000-00-00", "#n/a"]
#: Invisible characters that are deleted; white space of any kind becomes one space.
INVISIBLE, WHITE = "[​‌‍⁠﻿]", r"(?U)[\s ]+"

# The bytes 0x80-0x9F of two code pages, by Python's codecs; bytes that a page leaves open stay out.
_HIGH = range(0x80, 0xA0)


def _page(name: str) -> dict[int, str]:
    return {b: c for b in _HIGH if (c := bytes([b]).decode(name, "ignore"))}


_CP1252, _CP1254 = _page("cp1252"), _page("cp1254")
_LATIN_ONLY = "ÞþÐðÝý"
_TURKISH = bytes(ord(c) for c in _LATIN_ONLY).decode("cp1254")


def upper(s: Column) -> Column:
    return F.upper(F.translate(s, "iı", "İI"))


def lower(s: Column) -> Column:
    return F.lower(F.translate(s, "Iİ", "ıi"))


def title(s: Column) -> Column:
    """Every run without white space, hyphens and apostrophes gets a capital first letter."""
    runs = F.regexp_extract_all(s, F.lit(r"(?U)([^\s\-']+|[\s\-']+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(upper(F.substring(w, 1, 1)), lower(F.substr(w, F.lit(2))))), "")


def fold(s: Column) -> Column:
    return F.translate(s, ACCENTED, PLAIN)


def key(s: Column) -> Column:
    """Comparison key: lower-cased, folded, letters and digits only."""
    return F.regexp_replace(fold(lower(s)), "[^a-z0-9]", "")


def wildcard_key(s: Column) -> Column:
    """key() that keeps question marks."""
    return F.regexp_replace(fold(lower(s)), "[^a-z0-9?]", "")


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, INVISIBLE, ""), WHITE, " "))


def degarble(s: Column) -> Column:
    """Undoes UTF-8 that was read as cp1252, else cp1254 that was read as Latin-1; all or nothing, else unchanged."""
    specials = "".join(_CP1252.values())
    controls = "".join(chr(b) for b in _CP1252)
    suspect = s.rlike("[ÃÄÅ][\u0080-¿" + specials + "]")
    encodable = ~s.rlike("[^\u0000-\u007f\u0080-ÿ" + specials + "]")
    undone = F.try_validate_utf8(F.encode(F.translate(s, specials, controls), "ISO-8859-1").cast("string"))
    one = F.when(suspect & encodable, undone)
    single = s.rlike(f"[{_LATIN_ONLY}]") & ~s.rlike("[^\u0000-ÿ]")
    decodable = ~s.rlike("[" + "".join(chr(b) for b in _HIGH if b not in _CP1254) + "]")
    two = F.when(single & decodable, F.translate(s, _LATIN_ONLY + "".join(chr(b) for b in _CP1254), _TURKISH + "".join(_CP1254.values())))
    return F.coalesce(one, two, s)


def clean(s: Column) -> Column:
    """What every cell goes through first; null becomes the empty text."""
    return degarble(squeeze(F.coalesce(s, F.lit(""))))


def is_placeholder(s: Column) -> Column:
    return lower(F.trim(F.coalesce(s, F.lit("")))).isin(PLACEHOLDERS)


def is_garbled(s: Column) -> Column:
    return degarble(s) != s
