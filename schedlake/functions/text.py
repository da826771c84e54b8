"""Text expressions: single-byte decoding, trigrams, tokens, slugs, query strings."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes 80-9F that the code page defines, as Latin-1 controls and as the characters they mean.
_DEFINED = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
C1_CHARS = "".join(map(chr, _DEFINED))
CP1252_CHARS = bytes(_DEFINED).decode("cp1252")
#: The bytes the code page leaves undefined.
UNDEFINED_CHARS = "\x81\x8d\x8f\x90\x9d"
#: Byte runs counted as UTF-8, written over Latin-1 characters. Leads F5-FF count as three bytes.
UTF8_RUN = r"[Â-ß][\u0080-¿]|[à-ïõ-ÿ][\u0080-¿]{2}|[ð-ô][\u0080-¿]{3}"
#: Accented Latin small letters and the plain letter each is built on.
_BASE = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xDF, 0x180) if unicodedata.normalize("NFKD", chr(c))[0] in "abcdefghijklmnopqrstuvwxyz"}


def decode_cp1252(content: Column) -> Column:
    """Text of code-page 1252 bytes; undefined bytes become their C1 controls, nothing fails."""
    return F.translate(F.decode(content, "iso-8859-1"), C1_CHARS, CP1252_CHARS)


def byte_text(text: Column) -> Column:
    """A decoded text's bytes as Latin-1 characters."""
    return F.translate(text, CP1252_CHARS, C1_CHARS)


def decode_report(latin: Column) -> dict[str, Column]:
    """Undefined bytes, UTF-8 runs and high bytes of a text of bytes as Latin-1 characters."""
    return {
        "undefined_byte_count": F.length(latin) - F.length(F.translate(latin, UNDEFINED_CHARS, "")),
        "utf8_sequence_count": F.regexp_count(latin, F.lit(UTF8_RUN)),
        "high_byte_count": F.regexp_count(latin, F.lit(r"[\u0080-ÿ]")),
    }


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.flatten(
        F.transform(
            words,
            lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
        )
    )
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two trigram arrays, 0 where both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0)), F.lit(0.0))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def search_match(words: Column, query: str) -> Column:
    """Web-style search over a token array: words all needed, ``or`` between two, ``-word`` forbidden, "a phrase" in order.

    A documented subset: no stemming. An empty query matches everything.
    """
    clauses: list[Column] = []
    pending_or = False
    for negative, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not negative:
            pending_or = bool(clauses)
            continue
        parts = re.findall(r"[^\W_]+", phrase or word)
        if not parts:
            continue
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        has = F.contains(joined, F.lit(" " + " ".join(parts) + " "))
        has = ~has if negative else has
        if pending_or:
            clauses[-1] = clauses[-1] | has
            pending_or = False
        else:
            clauses.append(has)
    out = F.lit(True)
    for clause in clauses:
        out = out & clause
    return out


def slugify(title: Column) -> Column:
    """Lower-case URL part: quotes dropped, other runs to one dash, at most 80 characters, never empty."""
    plain = F.translate(F.lower(title), "".join(_BASE), "".join(_BASE.values()))
    dashed = F.regexp_replace(F.regexp_replace(plain, "['’‘\"“”]", ""), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("programme")).otherwise(cut)


def canonical_list(value: Column) -> Column:
    """A comma list of a URL as sorted distinct items: at most 24 items of at most 40 characters."""
    items = F.transform(F.split(F.lower(value), ","), lambda x: F.trim(x))
    kept = F.filter(items, lambda x: (x != "") & (F.length(x) <= 40))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, 24)
