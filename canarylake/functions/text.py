"""Text idioms as Column expressions: offsets of matches, entropy, splicing, encodings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,hit:string>>"


def once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once a row. A column that a function inside of an array function names is put there whole, and computed for each entry."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def quote(text: str) -> str:
    """A pattern that matches ``text`` itself."""
    return re.sub(r"([^A-Za-z0-9_ \u0080-\U0010ffff])", r"\\\1", text)


def quote_col(text: Column) -> Column:
    """The same for a column."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_ ])", r"\\$1")


def spans(text: Column, pattern: str | Column) -> Column:
    """All non-overlapping matches as ``array<struct<start, end, hit>>``, half-open, in code points.

    What lies between the matches comes from ``split``, so that offsets are sums of lengths.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(hits.alias("hit"), F.split(text, pattern, -1).alias("gap"))  # the last gap has no hit
    first = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("out"))

    def step(a, p):
        start = a["pos"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        found = F.struct(end.alias("pos"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit")))).alias("out"))
        return F.when(p["hit"].isNull(), a).otherwise(found)

    return F.aggregate(pairs, first, step)["out"]


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def splice(text: Column, edits: Column) -> Column:
    """Replace the spans of ``array<struct<start, end, value>>``, which must be sorted and disjoint."""
    first = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(edits, first, lambda a, e: F.struct(e["end"].alias("pos"), F.concat(a["out"], F.substring(text, a["pos"] + 1, e["start"] - a["pos"]), e["value"]).alias("out")))
    return F.concat(done["out"], F.substring(text, done["pos"] + 1, F.length(text)))


LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Digits and the letters they stand for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
LEET_FROM, LEET_TO = "".join(LEET), "".join(LEET.values())


def rot(text: Column, shift: int) -> Column:
    """Letters moved ``shift`` places on in the alphabet."""
    turned = LOWER[shift % 26 :] + LOWER[: shift % 26]
    return F.translate(text, LOWER + LOWER.upper(), turned + turned.upper())


def leet_fold(text: Column) -> Column:
    """Lower case, with digits that stand for letters as those letters."""
    return F.translate(F.lower(text), LEET_FROM, LEET_TO)


def leet_spell(text: Column) -> Column:
    """Letters as the digits that stand for them."""
    return F.translate(F.lower(text), LEET_TO, LEET_FROM)


def leet_pattern(token: Column) -> Column:
    """A pattern for a token whose letters may be in either case or be digits; digits stand for themselves."""
    pairs = dict(zip(LEET_TO, LEET_FROM))

    def one(c):
        out = F.when(c.rlike("[A-Za-z]"), F.concat(F.lit("["), F.lower(c), F.upper(c), F.lit("]")))
        for letter, digit in pairs.items():
            out = F.when(F.lower(c) == letter, f"[{letter}{letter.upper()}{digit}]").otherwise(out)
        return F.coalesce(out, quote_col(c))

    return F.array_join(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), one), "")


def alnum(text: Column, lower: bool = False) -> Column:
    """Only ASCII letters and digits, in lower case if asked for."""
    kept = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    return F.lower(kept) if lower else kept


def decode_text(value: Column, kind: str) -> Column:
    """Text of a base64 or hex run; null if invalid. Invalid UTF-8 is left out."""
    padded = value
    if kind == "base64":
        bare = F.rtrim(value, F.lit("="))
        padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)).cast("int")))
    return F.replace(F.make_valid_utf8(F.try_to_binary(padded, F.lit(kind)).cast("string")), F.lit("�"), F.lit(""))


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(value: Column) -> Column:
    """Base32 of a text's UTF-8 bytes with padding, by whole groups of five bytes in hex."""
    raw = F.hex(value.cast("binary"))
    groups = F.ceil(F.length(raw) / 10).cast("int")

    def letters(number):
        digit = lambda k: F.substring(F.lit(_B32), (F.shiftright(number, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
        return F.concat(*[digit(k) for k in range(8)])

    numbers = once(F.rpad(raw, groups * 10, "0"), lambda full: F.transform(F.sequence(F.lit(0), F.greatest(F.length(full) / 10 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substring(full, i * 10 + 1, 10), 16, 10).cast("long")))
    text = F.array_join(F.transform(numbers, letters), "")
    size = F.ceil(F.length(raw) * 4 / 5).cast("int")
    return F.when(F.length(raw) == 0, "").otherwise(F.rpad(F.substring(text, F.lit(1), size), groups * 8, "="))


def base32_decode(value: Column) -> Column:
    """Text of a base32 run in either case; null where characters or length are wrong. Invalid UTF-8 is left out."""
    bare = F.upper(F.rtrim(value, F.lit("=")))
    # eight letters are five bytes; what the last group lacks is filled up, and its bytes left out
    group = lambda full, i: F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0).cast("long"), lambda a, k: a * 32 + F.instr(F.lit(_B32), F.substring(full, i * 8 + k, F.lit(1))) - 1)
    groups = F.ceil(F.length(bare) / 8).cast("int")
    full = F.rpad(bare, groups * 8, "A")
    n_bytes = F.floor(F.length(bare) * 5 / 8).cast("int")
    hexed = once(full, lambda f: F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(f) / 8 - 1, F.lit(0)).cast("int")), lambda i: F.lpad(F.hex(group(f, i)), 10, "0")), ""))
    hexed = F.substring(hexed, F.lit(1), n_bytes * 2)
    good = bare.rlike("^[A-Z2-7]+$") & (F.length(bare) % 8).isin(0, 2, 4, 5, 7)
    text = F.replace(F.make_valid_utf8(F.try_to_binary(hexed, F.lit("hex")).cast("string")), F.lit("�"), F.lit(""))
    return F.when(good, text)
