"""PII (operator 7): patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. For each kind, ``regexp_extract_all`` gives the matches and ``split`` the text between
them; running sums of their lengths give each match's place. Sums run over blocks of ``BLOCK`` matches and then
over the blocks, so a text with very many matches costs no square of their number. The patterns take each run of
their characters once (possessive quantifiers; a match starts where a run starts or the last match ended), so
their time follows the text's length also where nothing matches.

Base kinds: email; ip (parts at most 255); card (16 to 19 digits, Luhn); phone (8 to 15 digits).
Added kinds: iban (mod-97), national (18 characters with the ISO 7064 mod 11-2 check, as of Chinese resident ids),
mobile (11 digits 1[3-9]..., no digits beside it), secret (a value of 20 or more letters, digits and ``_-/+=`` with a digit
and a letter among them that a word like token names, or that has a known prefix), ssn (nine digits as 3-2-4, of ranges in use).
An added span's score starts at its validator's weight; words near it (``CONTEXT`` characters before and after it, those of a
neighbouring match of its kind not counted) raise or lower the score; spans of ``MIN_SCORE`` and more that overlap no base
span are reported. A base span's score is 1: context never drops one.

Cases: a null text counts as empty and has no spans (``base_sha256`` is that of the empty string); repeated rows
give repeated results; offsets are code points, ends exclusive; spans of one kind never overlap, of two added kinds at
the same place both are told; a null id is kept; an empty table gives an empty result; very long texts are read whole;
only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import text_or_empty

#: Matches in a block of running sums; characters of context before a span; score from which added spans count.
BLOCK, CONTEXT, MIN_SCORE = 256, 40, 0.5

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mobile": r"(?<![0-9+])1[3-9][0-9]{9}(?![0-9])",
    "national": r"(?<![0-9A-Za-z])[1-9][0-9]{16}[0-9Xx](?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{20,}+={0,2}(?![0-9A-Za-z_/+=-])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "mobile", "national", "secret", "ssn")
#: Of each added kind: the validator's weight, and what words nearby add.
WEIGHTS = {"iban": (0.7, 0.3), "national": (0.6, 0.4), "mobile": (0.2, 0.4), "secret": (0.2, 0.4), "ssn": (0.3, 0.4)}
WORDS = {
    "iban": "iban|account|konto|compte|cuenta|bank|swift|bic",
    "national": "id|identity|passport|ausweis|identité|identidad|身份证",
    "mobile": "phone|mobile|cell|call|tel|telefon|handy|téléphone|teléfono|手机|电话",
    "secret": "token|secret|key|password|passwd|pwd|api|bearer|auth|authorization|credential|credentials|apikey|api_key|access_key|secret_key|private_key|client_secret",
    "ssn": "ssn|social security|tax id|taxpayer",
}
#: Fixed prefixes of issued keys; a value that begins with one needs no word near it.
PREFIXES = r"^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_|github_pat_|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|glpat-|npm_|eyJ)"
#: Words that speak of examples or checksums lower a score.
AGAINST, PENALTY = "example only|sample value|checksum|sha256|sha1|md5|commit|digest|order no|isbn", 0.4
#: Letters of scripts that are written with spaces, and digits: what may not stand beside a word of such a script. Marks like _ and - may.
_SPACED = r"[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]"
_HAN = re.compile("[\u4e00-\u9fff]")


def _words(alternatives: str) -> str:
    """A pattern for any of some words; those of a script without spaces need no border."""
    every = alternatives.split("|")
    spaced, unspaced = ([w for w in every if bool(_HAN.search(w)) == own] for own in (False, True))
    return "|".join([f"(?<!{_SPACED})(?:{'|'.join(spaced)})(?!{_SPACED})"] * bool(spaced) + unspaced)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _ip_ok(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def _mod97(match: Column) -> Column:
    """IBAN check: the first four characters move to the end, letters count 10 to 35, the number modulo 97 is 1."""
    s = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(s, 5, 99), F.substring(s, 1, 4)), "")
    rest = F.aggregate(
        turned,
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(s).between(15, 34) & (rest == 1)


def _mod11(match: Column) -> Column:
    """ISO 7064 mod 11-2: weights are the powers of two modulo 11, the last character X counts 10."""
    total = F.aggregate(
        F.split(F.upper(match), ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).otherwise((acc * 2 + F.when(c == "X", 10).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)))) % 11),
    )
    return total == 1


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _ip_ok,
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    "iban": _mod97,
    "mobile": lambda m: F.lit(True),
    "national": _mod11,
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
    "ssn": lambda m: F.lit(True),
}


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one, by blocks."""
    n = F.size(lengths)
    parts = F.transform(F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    def before(xs: Column, start: Column) -> Column:
        init = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, init, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all")), lambda acc: acc["all"])

    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
    spread = F.flatten(F.zip_with(parts, before(totals, F.lit(0)), lambda p, start: before(p, start)))
    return F.when(n > 0, spread).otherwise(F.array().cast("array<int>"))


def _near(between: Column, i: Column) -> Column:
    """The CONTEXT characters before and after match i, a neighbouring match of its kind left out."""
    part = lambda k: F.coalesce(F.get(between, k), F.lit(""))
    before, after = F.concat(part(i - 1), F.lit(" "), part(i)), F.concat(part(i + 1), F.lit(" "), part(i + 2))
    return F.lower(F.concat_ws(" | ", F.right(before, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT))))


def _located(kind: str, matches: Column, between: Column, starts: Column) -> Column:
    """Array of struct(kind, start, stop, score) of the confirmed matches of a kind, by start."""
    one = F.transform(
        F.filter(F.arrays_zip(matches.alias("m"), between.alias("b"), starts.alias("s"), F.sequence(F.lit(0), F.size(between)).alias("i")), lambda x: x["m"].isNotNull() & VALID[kind](x["m"])),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            (x["s"] + F.length(x["b"])).cast("int").alias("start"),
            (x["s"] + F.length(x["b"]) + F.length(x["m"])).cast("int").alias("stop"),
            _score(kind, x["m"], _near(between, x["i"])).alias("score"),
        ),
    )
    return F.filter(one, lambda x: x["score"] >= MIN_SCORE)


def _score(kind: str, match: Column, near: Column) -> Column:
    if kind in BASE:
        return F.lit(1.0)
    base, plus = WEIGHTS[kind]
    found = F.lit(base) + F.when(near.rlike(_words(WORDS[kind])), plus).otherwise(0.0) - F.when(near.rlike(_words(AGAINST)), PENALTY).otherwise(0.0)
    return F.when(match.rlike(PREFIXES), F.lit(1.0)).otherwise(found) if kind == "secret" else found


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: its id and, for each kind, an array column of spans: struct(kind, start, stop, score)."""
    none = F.array().cast("array<string>")
    found = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
    match = {k: F.regexp_extract_all("_text", F.lit(PATTERNS[k]), F.lit(0)) for k in PATTERNS}
    match |= {k: F.when(F.contains(F.col("_text"), F.lit(mark)), match[k]).otherwise(none) for k, mark in (("email", "@"), ("phone", "+"))}
    found = found.select("*", *(match[k].alias(f"{k}_m") for k in PATTERNS))
    # The text between matches is cut only where there are matches.
    found = found.select("*", *(F.when(F.size(f"{k}_m") > 0, F.split("_text", PATTERNS[k], -1)).otherwise(none).alias(f"{k}_b") for k in PATTERNS)).drop("_text")
    steps = {k: F.zip_with(f"{k}_b", f"{k}_m", lambda b, m: F.coalesce(F.length(b), F.lit(0)) + F.coalesce(F.length(m), F.lit(0))) for k in PATTERNS}
    found = found.select("*", *(steps[k].alias(f"{k}_n") for k in PATTERNS))
    found = found.select("*", *(_running(F.col(f"{k}_n")).alias(f"{k}_s") for k in PATTERNS))
    found = found.select(id_col, *(_located(k, F.col(f"{k}_m"), F.col(f"{k}_b"), F.col(f"{k}_s")).alias(k) for k in PATTERNS))
    found = found.withColumn("_base", F.concat(*BASE))
    clear = lambda x: ~F.exists("_base", lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"]))
    return found.select(id_col, *BASE, *(F.filter(k, clear).alias(k) for k in ADDED))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(F.concat(*BASE)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(*BASE, *ADDED)).alias("spans"),
    )
