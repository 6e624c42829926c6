"""Scalar functions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r]+"


def words(text: Column, lower: bool = True) -> Column:
    """The words between white space; none for null or blank text."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.split(F.lower(t) if lower else t, SPACE), lambda w: w != "")


def tokens(text: Column, punctuation: str = r"[!-/:-@\[-`{-~।॥]") -> Column:
    """Words and marks: marks of ``punctuation`` stand alone."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"({punctuation})", " $1 "), SPACE), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces; none if there are fewer. Each gram is a shorter one and a token."""
    out = tokens
    for k in range(1, n):
        rest = lambda x, m: F.slice(x, m, F.greatest(F.size(x) - (m - 1), F.lit(0)))
        out = F.zip_with(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), rest(tokens, F.lit(k + 1)), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def pair_key(source: Column, target: Column) -> Column:
    return F.md5(F.concat(source, F.lit("|||"), target).cast("binary"))


def script_language(text: Column, script: str = r"[ऀ-ॿ]", name: str = "hi", latin: str = "[a-zA-Z]", other: str = "en", share: float = 0.3) -> Column:
    """``name`` if more than ``share`` of the letters are of the script; ``other`` if not or without letters."""
    own, rest = F.regexp_count(text, F.lit(script)), F.regexp_count(text, F.lit(latin))
    return F.when(own / F.nullif(own + rest, F.lit(0)) > share, name).otherwise(other)


def bias_3bin(frequency: Column, top: float = 5.0) -> Column:
    return F.when(frequency < 1e-5, top).when(frequency < 1e-4, 0.5 * top).otherwise(0.1 * top)


def bias_4bin(frequency: Column) -> Column:
    # fixed values: the four weights
    return F.when(frequency < 1e-5, 5.0).when(frequency < 1e-4, 3.0).when(frequency < 1e-3, 2.0).otherwise(1.0)


def combine_scores(score: Column, lm: Column, bias: Column, alpha: float = 0.3, beta: float = 3.0) -> Column:
    """``score + alpha lm + beta bias``; a part is left out if its weight isn't positive or it is null."""
    for part, weight in ((lm, alpha), (bias, beta)):
        if weight > 0:
            score = score + F.coalesce(part * weight, F.lit(0.0))
    return score


def restore_placeholders(text: Column, targets: Column) -> Column:
    """``⟦n⟧`` becomes element n of ``targets``; marks without one go."""
    at = F.sequence(F.lit(0), F.greatest(F.size(targets) - 1, F.lit(0)))
    filled = F.aggregate(at, text, lambda t, i: F.when(F.get(targets, i).isNotNull(), F.replace(t, F.concat(F.lit("⟦"), i.cast("string"), F.lit("⟧")), F.get(targets, i))).otherwise(t))
    return F.regexp_replace(filled, "⟦[0-9]+⟧", "")


def translation_method(text: Column, used_terms: Column, used_model: Column, same_language: Column) -> Column:
    """The parts of a translation joined by ``+``; ``empty``, ``passthrough`` or ``none`` without any."""
    parts = F.concat_ws("+", F.when(used_terms, "dictionary"), F.when(used_model, "model"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(same_language, "passthrough").otherwise(F.when(parts == "", "none").otherwise(parts))


def stub(term: Column, needed: bool = False) -> Column:
    return F.format_string("[NEEDS_TRANSLATION:%s]" if needed else "[TRANSLATE:%s]", term)


def is_stub(value: Column) -> Column:
    return value.startswith("[TRANSLATE:")


def usable(value: Column, stubs: bool = False) -> Column:
    kept = (value != "") & ~value.startswith("[NEEDS_")
    return kept if stubs else kept & ~is_stub(value)


def scrub_ipa(ipa: Column) -> Column:
    return F.trim(F.replace(ipa, F.lit("*"), F.lit("")))


def apply_overrides(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replace substrings, longest first."""
    for old, new in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def pick_key(*columns: Column) -> Column:
    return F.coalesce(*columns)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def route_language(tag: Column, unknown: str = "other") -> Column:
    t = F.lower(F.trim(tag))
    # fixed values: the tags of each language
    return F.when(t.isin("en", "eng", "english"), "en").when(t.isin("hi", "hin", "hindi"), "hi").when(t.isin("mai", "maithili"), "mai").otherwise(unknown)
