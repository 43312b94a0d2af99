"""Text functions as columns, with the string semantics of UTF-16 hosts (lengths, slices, hashes)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware trimming knows it, for a Java character class.
SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
ASTRAL = r"[\x{10000}-\x{10ffff}]"
CJK = r"\x{2e81}-\x{9ffe}"
#: A noncharacter that stands for the second unit of a character beyond the basic plane.
_SECOND_UNIT = "﷐"
SEED, PRIME, MASK = 2166136261, 16777619, 4294967295


def trim(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(F.regexp_replace(text, ASTRAL, "xx"))


def widen(text: Column) -> Column:
    """One character for each UTF-16 unit, so that lengths and positions count units; see :func:`narrow`."""
    return F.regexp_replace(text, f"({ASTRAL})", f"$1{_SECOND_UNIT}")


def narrow(text: Column) -> Column:
    """Undo :func:`widen`, also of a part (a pair cut in two stays whole in the first part)."""
    return F.replace(text, F.lit(_SECOND_UNIT), F.lit(""))


def utf16_slice(text: Column, start: int, end: int) -> Column:
    """Units ``start`` to ``end`` (0-based, exclusive)."""
    return narrow(F.substring(widen(text), start + 1, end - start))


def normalize_text(text: Column) -> Column:
    """NFKC, then lower case."""

    @F.pandas_udf("string")
    def normalized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: t if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).lower())

    return normalized(text)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units."""

    def units(c: Column) -> Column:
        cp = F.ascii(c)
        over = cp - 65536
        return F.when(cp > 65535, F.array((F.shiftright(over, 10) + 55296), (over.bitwiseAND(1023) + 56320))).otherwise(F.array(cp))

    points = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(
        F.flatten(F.transform(points, units)),
        F.lit(SEED).cast("bigint"),
        lambda h, u: (h.bitwiseXOR(u.cast("bigint")) * F.lit(PRIME).cast("bigint")).bitwiseAND(F.lit(MASK).cast("bigint")),
    )


def hash_sign(text: Column) -> Column:
    """+1 for an even hash, else -1: the salted hash that the sign is defined by has the same parity."""
    return F.when(fnv1a(text) % 2 == 0, 1).otherwise(-1)


def word_tokens(normalized: Column) -> Column:
    """Runs of three or more of a-z, 0-9 and _."""
    return F.regexp_extract_all(normalized, F.lit("([a-z0-9_]{3,})"), 1)


def word_bigrams(words: Column) -> Column:
    """Adjacent words, joined by a space."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def char_ngrams(normalized: Column, longest: int = 4) -> Column:
    """All runs of 1 to ``longest`` code points."""
    n = F.length(normalized)

    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
        return F.when(n >= k, F.transform(starts, lambda i: F.substring(normalized, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*map(runs, range(1, longest + 1))))


def estimate_tokens(text: Column) -> Column:
    """Rough tokens: 0.6 for each CJK character, a quarter for any other that isn't white space."""
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    other = F.length(F.regexp_replace(text, f"[{CJK}{SPACE}]", ""))
    return F.ceil(F.lit(0.6) * cjk + other / F.lit(4.0)).cast("bigint")


def slugify(path: Column) -> Column:
    """A workspace path as a folder name between double hyphens."""
    clean = F.regexp_replace(F.regexp_replace(path, "[^A-Za-z0-9._-]", "-"), "-+", "-")
    return F.concat(F.lit("--"), F.regexp_replace(clean, "^-|-$", ""), F.lit("--"))


def message_text(content: Column) -> Column:
    """Texts of all blocks that have one, joined by a space; empty without blocks."""
    texts = F.transform(F.filter(content, lambda b: b["text"].isNotNull()), lambda b: b["text"])
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


def is_human(role: Column, source_kind: Column) -> Column:
    """A user's own message, not one that a plugin wrote."""
    return F.coalesce(role == "user", F.lit(False)) & F.coalesce(source_kind != "plugin", F.lit(True))
