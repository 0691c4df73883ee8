"""Text expressions: counting, normalising, hashing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the range of Han characters that the rules count.
HAN = "一-鿿"


def count_of(text: Column | str, pattern: str) -> Column:
    """Matches of a pattern; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def letters_and_digits(text: Column | str) -> Column:
    return count_of(text, r"[\p{L}\p{N}]")


def round_to(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


#: Scripts written without spaces; their characters that alone tell nothing; full-width forms of ASCII.
CJK = "[\u0e00-\u0e7f\u1100-\u11ff\u1780-\u17ff\u2e80-\u30ff\u3130-\u318f\u31a0-\u31bf\u3400-\u4dbf\u4e00-\u9fff\ua960-\ua97f\uac00-\ud7af\uf900-\ufaff]"
CJK_STOPS = "的了是在与及或而且于以为之其我你他她它们这那有没不也都就还但对从到向被把让给等个上下并将会能要很太最该各"
SCRIPTS = {"cjk": CJK, "latin": "[A-Za-z]", "cyrillic": "[\u0400-\u04ff]", "greek": "[\u0370-\u03ff]", "arabic": "[\u0600-\u06ff]", "hebrew": "[\u0590-\u05ff]"}
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def _script(char: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in SCRIPTS.items():
        out = out.when(char.rlike(pattern), name)
    return out.otherwise("other")


def _unspaced(run: Column) -> Column:
    """Terms of a run without spaces: its characters but for the commonest, and its pairs of one script."""
    chars = F.regexp_extract_all(run, F.lit("(?s)."), F.lit(0))
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.when(b.isNotNull() & (_script(a) == _script(b)), F.concat(a, b)))
    return F.concat(F.filter(chars, lambda c: ~F.contains(F.lit(CJK_STOPS), c)), F.array_compact(pairs))


def _terms(low: Column, of_runs: Callable[[Column], Column]) -> Column:
    runs = of_runs(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    ascii_runs = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w).between(2, 64))
    return F.array_distinct(F.concat(runs, ascii_runs))


def words(text: Column | str, most: int | None = None) -> Column:
    """Distinct index terms of a text, the first ``most`` if that is given: letter-digit runs of 2 to 128 characters (of runs that
    hold scripts without spaces, characters and pairs), then their ASCII parts of 2 to 64. Full-width ASCII counts as ASCII."""
    plain = _terms(F.lower(text), lambda runs: F.filter(runs, lambda w: F.length(w).between(2, 128)))
    mixed = lambda runs: F.flatten(F.transform(runs, lambda w: F.when(w.rlike(CJK), _unspaced(w)).when(F.length(w).between(2, 128), F.array(w)).otherwise(F.array().cast("array<string>"))))
    # Texts of ASCII alone need one pattern, and nearly all others have neither full-width characters nor such scripts.
    only_ascii = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w).between(2, 128)))
    other = F.rlike(text, F.lit(CJK.replace("]", "\uff01-\uff5e]")))
    found = F.when(~F.rlike(text, F.lit(r"[^\x00-\x7F]")), only_ascii).when(other, _terms(F.lower(F.translate(text, WIDE, NARROW)), mixed)).otherwise(plain)
    return found if most is None else F.slice(found, 1, most)


def word_sequence(text: Column | str) -> Column:
    """Index terms of a text in their order, repeats included, without the ASCII parts of mixed runs: what stands at each position."""
    runs = F.regexp_extract_all(F.lower(F.translate(text, WIDE, NARROW)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    plain = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w).between(2, 128))
    mixed = F.flatten(F.transform(runs, lambda w: F.when(w.rlike(CJK), _unspaced(w)).when(F.length(w).between(2, 128), F.array(w)).otherwise(F.array().cast("array<string>"))))
    return F.when(F.rlike(text, F.lit(CJK.replace("]", "\uff01-\uff5e]"))), mixed).otherwise(plain)


def grams(s: Column, n: int) -> Column:
    """Distinct character n-grams of a string, in order of appearance."""
    last = F.length(s) - n + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(s, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint elements of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def evidence_key(text: Column | str) -> Column:
    """Identity of a passage: sha256 without comments, escapes and white space; empty for an empty one."""
    raw = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"\\([#*_])", "$1"), r"\s+", "")
    return F.when(raw == "", F.lit("")).otherwise(F.sha2(raw.cast("binary"), 256))


def family_key(title: Column | str) -> Column:
    """Title without suffix, version marks and white space: editions of one document share it."""
    t = F.regexp_replace(title, r"(?i)\.[a-z0-9]+$", "")
    t = F.regexp_replace(t, r"[(_\-\s]*[vV]\d+(?:\.\d+)*[)\]_\-\s]*", "")
    t = F.regexp_replace(t, r"第[一二三四五六七八九十0-9]+版", "")
    return F.regexp_replace(F.regexp_replace(t, r"(（修订版）|\(修订版\)|修订版|最终版|最新版|征求意见稿|试行|初稿)", ""), r"\s+", "")
