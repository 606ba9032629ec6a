"""Secret-shaped tokens in texts: registered formats, unknown tokens, overlaps, decoys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import AFTER, BEFORE, CHECKSUM, DIGITS, FORMATS, LOWER, UPPER, github_checksum, is_valid
from ..functions.text import entropy, spans, splice

FINDING = "array<struct<format:string,start:int,end:int,confidence:string>>"
UNKNOWN = "unknown-token"
#: What an unknown token looks like.
_UNKNOWN_PATTERN = BEFORE + r"[A-Za-z0-9][A-Za-z0-9._~+/\-]{23,}={0,2}" + AFTER
#: Runs of the characters that tokens and what may not stand beside them consist of, and such runs within them that a
#: token can only begin. But for formats with other characters, a token lies in one run, and there it matches as it does in the text.
_RUN, _HEAD = r"(?<![A-Za-z0-9._~+/=\-])[A-Za-z0-9._~+/=\-]{20,}", BEFORE + r"[A-Za-z0-9_./+\-]{20,}"


def _finding(fmt: str, confidence: str):
    return lambda s: F.struct(F.lit(fmt).alias("format"), s["start"].alias("start"), s["end"].alias("end"), F.lit(confidence).alias("confidence"))


def _parts() -> tuple[list, list]:
    """Scannable formats that lie in a run, and the others."""
    every = [f for f in FORMATS if f.scannable]
    loose = [f for f in every if any(isinstance(s, str) and s is not CHECKSUM and re.search(r"[^A-Za-z0-9_./+-]", s) for s in f.segments)]
    return [f for f in every if f not in loose], loose


def _at_head(head: Column, formats) -> Column:
    """Findings of ``formats`` at the start of a run, where alone they can be; ``head`` is a span."""

    def one(f):
        hit = head["hit"].rlike("^(?:" + f.pattern + ")" + AFTER)
        if f.checksummed:
            hit = hit & is_valid(F.substring(head["hit"], 1, f.length), f)
        return F.when(hit, F.struct(F.lit(f.slug).alias("format"), head["start"].alias("start"), (head["start"] + f.length).alias("end"), F.lit("high" if f.checksummed else "medium").alias("confidence")))

    return F.array_compact(F.array(*[one(f) for f in formats])).cast(FINDING)


def _tight(run: Column) -> Column:
    formats, _ = _parts()
    return F.flatten(F.transform(spans(run, _HEAD), lambda h: _at_head(h, formats)))


def _loose(text: Column) -> list[Column]:
    """Findings of each of the formats that do not lie in a run; a text without the prefix skips the pattern."""
    return [F.when(text.contains(f.prefix), F.transform(spans(text, BEFORE + f.pattern + AFTER), _finding(f.slug, "medium"))).otherwise(F.array().cast(FINDING)) for f in _parts()[1]]


def _in_runs(text: Column, find) -> Column:
    """What ``find`` finds in the runs of a text, at its places in the text."""

    def moved(run):
        return F.transform(find(run["hit"]), lambda f: F.struct(f["format"].alias("format"), (run["start"] + f["start"]).alias("start"), (run["start"] + f["end"]).alias("end"), f["confidence"].alias("confidence")))

    return F.flatten(F.transform(spans(text, _RUN), moved))


def registered_findings(text: Column) -> Column:
    """Findings of the scannable formats, run by run; within a run format by format."""
    return F.coalesce(F.concat(_in_runs(text, _tight), *_loose(text)), F.array().cast(FINDING))


def prefix_length(token: Column) -> Column:
    """Length of a visible prefix: up to the last ``_`` or ``-`` of the first 24 characters, with 16 or more after it."""
    n = F.length(F.regexp_extract(F.substring(token, 1, 24), r"^.*[_-]", 0))
    head = F.substring(token, F.lit(1), n)
    return F.when((n >= 2) & (F.length(token) - n >= 16) & head.rlike("[A-Za-z]"), n).otherwise(0)


def is_secret_like(token: Column) -> Column:
    """Long, of two character classes or more, and of high entropy; lower bounds apply after a visible prefix."""
    core = F.rtrim(token, F.lit("="))
    classes = sum((F.when(core.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[._~+/\-]")), F.lit(0))
    bits, n = entropy(core), F.length(core)
    prefixed = (prefix_length(core) > 0) & (classes >= 2)
    return (n >= 24) & F.when(prefixed, bits >= 3.0).otherwise((n >= 32) & (classes >= 2) & (bits >= 3.3))


def _unknown(run: Column) -> Column:
    return F.transform(F.filter(spans(run, _UNKNOWN_PATTERN), lambda s: is_secret_like(s["hit"])), _finding(UNKNOWN, "low"))


def unknown_findings(text: Column) -> Column:
    """Findings of token-like strings of no registered format."""
    return F.coalesce(_in_runs(text, _unknown), F.array().cast(FINDING))


def resolve_overlaps(findings: Column) -> Column:
    """Surer first, then longer, then earlier; each is kept if it meets none kept before. Sorted by start."""
    rank = F.transform(findings, lambda f, i: F.struct(
        F.when(f["confidence"] == "high", 0).when(f["confidence"] == "medium", 1).otherwise(2).alias("c"),
        (f["start"] - f["end"]).alias("l"), f["start"].alias("start"), i.alias("i"), f["end"].alias("end"), f["format"].alias("format"), f["confidence"].alias("confidence")))
    plain = F.transform(F.array_sort(rank), lambda r: F.struct(r["format"].alias("format"), r["start"].alias("start"), r["end"].alias("end"), r["confidence"].alias("confidence")))
    kept = F.aggregate(plain, F.array().cast(FINDING), lambda a, f: F.when(F.exists(a, lambda k: (f["start"] < k["end"]) & (k["start"] < f["end"])), a).otherwise(F.concat(a, F.array(f))))
    by_start = F.array_sort(F.transform(kept, lambda f: F.struct(f["start"].alias("start"), f["format"].alias("format"), f["end"].alias("end"), f["confidence"].alias("confidence"))))
    return F.transform(by_start, lambda f: F.struct(f["format"].alias("format"), f["start"].alias("start"), f["end"].alias("end"), f["confidence"].alias("confidence")))


def findings(text: Column) -> Column:
    """All findings of a text, without the matched text."""
    in_runs = _in_runs(text, lambda run: F.concat(_tight(run), _unknown(run)))
    return resolve_overlaps(F.coalesce(F.concat(in_runs, *_loose(text)), F.array().cast(FINDING)))


def _long(df: DataFrame, id_col: str, found: Column) -> DataFrame:
    each = df.select(id_col, F.explode(found).alias("f"))
    return each.select(id_col, "f.format", "f.start", "f.end", "f.confidence")


def scan_registered(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, format, start, end, confidence)`` of every registered match; they may overlap."""
    return _long(df, id_col, registered_findings(F.col(text_col)))


def scan_unknown(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The same for token-like strings of no registered format."""
    return _long(df, id_col, unknown_findings(F.col(text_col)))


def scan_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The findings that remain where they overlap."""
    return _long(df, id_col, findings(F.col(text_col)))


def shape_detector(outputs: DataFrame, text_col: str = "text", include_low: bool = True) -> DataFrame:
    """``outputs`` with a detector result: score of the surest finding, ``sanitize`` if there is one, spans and count."""
    found = findings(F.col(text_col)) if include_low else F.filter(findings(F.col(text_col)), lambda f: f["confidence"] != "low")
    df = outputs.withColumn("findings", found)
    score = F.array_max(F.transform("findings", lambda f: F.when(f["confidence"] == "high", 0.95).when(f["confidence"] == "medium", 0.65).otherwise(0.35)))
    return df.withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn("match_count", F.size("findings")).withColumn("recommended_action", F.when(F.size("findings") > 0, "sanitize").otherwise("allow")).withColumn("detector_name", F.lit("secret_shape"))


def _pick(alphabet: str, *key) -> Column:
    return F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(*key), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mask(fmt) -> str:
    """1 for each character of a format that is always the same, 0 for the others."""
    return "".join("0" * 6 if s is CHECKSUM else "1" * len(s) if isinstance(s, str) else "0" * s[1] for s in fmt.segments)


def decoy(original: Column, fmt: Column, key: Column) -> Column:
    """A fake of the same shape: letters and digits of a token's variable parts drawn anew by hash, checksums recomputed.

    Fixed parts of registered formats and visible prefixes and separators of unknown tokens stay.
    """
    masks = F.create_map(*[F.lit(x) for f in FORMATS for x in (f.slug, _mask(f))])
    mask = F.when(fmt == UNKNOWN, F.repeat(F.lit("1"), prefix_length(F.rtrim(original, F.lit("="))))).otherwise(F.coalesce(F.element_at(masks, fmt), F.lit("")))
    known = F.struct(mask.alias("mask"), fmt.isin("twilio-account-sid", "twilio-api-key-sid").alias("hex"), key.alias("key"))

    def drawn(p):
        def draw(c, i):
            lower = F.when(p["hex"], _pick("abcdef", p["key"], i)).otherwise(_pick(LOWER, p["key"], i))
            new = F.when(c.between("a", "z"), lower).when(c.between("A", "Z"), _pick(UPPER, p["key"], i)).when(c.between("0", "9"), _pick(DIGITS, p["key"], i)).otherwise(c)
            return F.when(F.substring(p["mask"], i + 1, F.lit(1)) == "1", c).otherwise(new)

        return F.array_join(F.transform(F.filter(F.split(original, ""), lambda c: c != ""), draw), "")

    summed = [f.slug for f in FORMATS if f.checksummed]
    return _let(_let(known, drawn), lambda out: F.when(fmt.isin(*summed), F.concat(F.substring(out, 1, 34), github_checksum(F.substring(out, 5, 30)))).otherwise(out))


def auto_decoy(df: DataFrame, seed: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with ``findings`` and ``swapped_text``, where each finding is a decoy that differs from it.

    Decoys follow from the seed, the row's id and the place; a draw equal to the original is drawn again.
    """
    text = F.col(text_col)
    found = df.withColumn("findings", findings(text))

    def edit(f):
        def tried(k, original):
            return decoy(original, f["format"], F.xxhash64(F.lit(seed), F.col(id_col), f["start"], F.lit(k)))

        value = _let(F.substring(text, f["start"] + 1, f["end"] - f["start"]), lambda original: _let(tried(0, original), lambda first: F.when(first != original, first).otherwise(tried(1, original))))
        return F.struct(f["start"].alias("start"), f["end"].alias("end"), value.alias("value"))

    return found.withColumn("swapped_text", F.coalesce(splice(text, F.transform("findings", edit)), text))


def policy_gated_decoy(outputs: DataFrame, decisions: DataFrame, results: DataFrame, key: list[str], seed: int = 0, text_col: str = "text") -> DataFrame:
    """Decoys only where the final action is ``sanitize`` and a triggered shape detector asked for it.

    Others stay, with the reason: ``not_sanitize`` or ``not_shape``.
    """
    asked = results.where((F.col("detector_name") == "secret_shape") & (F.col("recommended_action") == "sanitize")).select(*key).distinct().withColumn("asked", F.lit(True))
    met = outputs.join(decisions.select(*key, F.col("action").alias("final_action")), key, "left").join(asked, key, "left")
    swapped = auto_decoy(met.withColumn("__key", F.xxhash64(*key)), seed, text_col, "__key")
    go = (F.col("final_action") == "sanitize") & F.coalesce("asked", F.lit(False))
    reason = F.when(go, "decoyed").when(F.col("final_action") == "sanitize", "not_shape").otherwise("not_sanitize")
    return swapped.withColumn("reason", reason).withColumn("released_text", F.when(go, F.col("swapped_text")).otherwise(F.col(text_col))).drop("__key", "asked", "swapped_text")
