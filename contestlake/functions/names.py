"""Name keys used by the exact and blocked joins."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

def _plain_letters() -> dict[str, str]:
    """Every lower-case letter that decomposes into a plain one and marks."""
    out = {}
    for code in range(0x80, 0x2100):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if chr(code).islower() and base.isascii() and base.isalpha():
            out[chr(code)] = base.lower()
    return out


ACCENTED, PLAIN = map("".join, zip(*_plain_letters().items()))
#: The same key as SQL text, for SQL functions; combining marks vanish, other characters separate words.
KEY_SQL = (rf"trim(regexp_replace(translate(regexp_replace(lower({{0}}), '\\p{{{{M}}}}+', ''), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' '))")


def name_key(name: Column) -> Column:
    """Accent-, case- and punctuation-insensitive key; letters without a plain form (such as ø) separate words."""
    flat = F.translate(F.regexp_replace(F.lower(name), r"\p{M}+", ""), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(flat, "[^a-z0-9]+", " "))


def name_slug(name: Column) -> Column:
    return F.regexp_replace(name_key(name), " ", "-")


def last_token(name: Column) -> Column:
    """Last word of the key; names of plain letters, digits and blanks need no patterns for it."""
    plain = F.substring_index(F.trim(F.lower(name)), " ", -1)
    return F.when(name.rlike(r"^[A-Za-z0-9 ]*\z"), plain).otherwise(F.element_at(F.split(name_key(name), " "), -1))


def surname_initial(name: Column) -> Column:
    """Last token and first initial, the loose key of a person name."""
    return F.concat_ws("|", last_token(name), F.substring(name_key(name), 1, 1))


def side_by_containment(text: Column, first: Column, second: Column) -> Column:
    """'1' or '2' by whose last name the text contains, the first one winning."""
    t = F.lower(text)
    a, b = last_token(first), last_token(second)
    return (F.when((a != "") & t.contains(a), "1").when((b != "") & t.contains(b), "2"))
