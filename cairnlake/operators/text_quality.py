"""Text quality, language, token estimates and personal data (TQ1-TQ11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import HAN, count_of, letters_and_digits, round_to, safe_ratio

COMMENT, IMAGE = r"(?s)<!--.*?-->", r"!\[[^\]]*\]\([^)]*\)"
PLACEHOLDER = r"(?i)<!--\s*(?:image|picture|figure)(?:[^\n>]*)\s*-->"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
SUPPLEMENT = r"[\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{3400}-\x{9fff}]"


def assess_quality(
    docs: DataFrame, text: str = "text", confidence: str | None = None, han_and_ascii_only: bool = False, native: str | None = None, upstream: str | None = None, failed: str | None = None, skipped: str | None = None, ocr_error: str | None = None
) -> DataFrame:
    """TQ1 (TQ2 with han_and_ascii_only): adds characters, meaningful, replacement_ratio, control_ratio, placeholders,
    quality_score, quality_status and quality_issues. Only a text without meaningful characters, or one that a step before
    rejected, is rejected; a null text is empty. The other names are columns of what a parser found: its own count of
    characters (in place of the one made here), its status, units that failed or were skipped, an error of recognition."""
    t = F.coalesce(F.col(text), F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(t, COMMENT, ""), IMAGE, "")
    meaningful = count_of(visible, f"[A-Za-z0-9{HAN}]") if han_and_ascii_only else letters_and_digits(visible)
    if native:
        meaningful = F.when(F.col(native).isNull(), meaningful).otherwise(F.greatest(F.col(native), F.lit(0))).cast("long")
    n = F.length(t).cast("long")
    fact = lambda name, other: F.coalesce(F.col(name), other) if name else other
    uncovered = (fact(failed, F.lit(0)) > 0) | (fact(skipped, F.lit(0)) > 0)
    replaced, control = safe_ratio(count_of(t, "�"), n), safe_ratio(count_of(t, CONTROL), n)
    score = 1 - F.least(replaced * 4, F.lit(0.45)) - F.least(control * 2, F.lit(0.2))
    if confidence:
        score = F.when(F.col(confidence).between(0, 1), F.least(score, F.col(confidence))).otherwise(score)
    return docs.select(
        "*",
        n.alias("characters"),
        meaningful.alias("meaningful"),
        round_to(replaced).alias("replacement_ratio"),
        round_to(control).alias("control_ratio"),
        count_of(t, PLACEHOLDER).alias("placeholders"),
        round_to(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("quality_score"),
        F.when((meaningful == 0) | (fact(upstream, F.lit("")) == "rejected"), "rejected").otherwise("passed").alias("quality_status"),
        F.array_compact(
            F.array(
                F.when(meaningful == 0, "no text"),
                F.when(uncovered, "units not covered"),
                F.when(replaced > 0, "replacement characters"),
                F.when(count_of(t, PLACEHOLDER) > 0, "image placeholders"),
                F.when(fact(ocr_error, F.lit("")) != "", "recognition failed"),
            )
        ).alias("quality_issues"),
    )


def detect_language(text: Column | str) -> Column:
    """TQ3: zh, en, mixed or unknown from the first 2000 characters (a fixed bound of the rule)."""
    head = F.substring(text, 1, 2000)
    han, latin = count_of(head, f"[{HAN}]"), count_of(head, "[A-Za-z]")
    ratio = han / (han + latin)
    return F.when(han + latin < 10, "unknown").when(ratio > 0.7, "zh").when(ratio < 0.15, "en").otherwise("mixed")


def gb_checksum_ok(number: Column) -> Column:
    """Check character of 18-digit resident ids: powers of two modulo 11 (ISO 7064 mod 11-2), X counts ten."""
    digits = F.filter(F.split(F.upper(number), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0), lambda acc, c: (acc * 2 + F.when(c == "X", 10).otherwise(c.try_cast("int"))) % 11) == 1


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone_cn": r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])",
    "id_cn": r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])",
    "bank_card": r"(?<![0-9])[0-9]{16,19}(?![0-9])",
}


#: Checks of kinds whose pattern alone matches too much.
CHECKS = {"id_cn": gb_checksum_ok, "bank_card": lambda m: F.call_function("luhn_check", m)}


def _valid(kind: str):
    return CHECKS.get(kind, lambda m: F.lit(True))


def scan_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """TQ4: adds for each kind an array of its confirmed matches, in order, and as ``<kind>_at`` the place of each (code points)."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs
    for kind, pattern in PII.items():
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        before = F.transform(F.split(body, pattern, -1), F.length)
        # Texts between matches and matches in turn: a match begins after all that stands before it.
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,at:int>>").alias("all"))
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + F.length(x["m"])).alias("at"), F.concat(acc["all"], F.array(F.struct(x["m"].alias("m"), (acc["at"] + x["gap"]).alias("at")))).alias("all"))
        placed = F.aggregate(F.arrays_zip(found.alias("m"), F.slice(before, F.lit(1), F.size(found)).alias("gap")), start, step, lambda acc: acc["all"])
        check = _valid(kind)
        good = F.filter(placed, lambda x: check(x["m"]))  # noqa: B023
        out = out.withColumn(f"_{kind}", F.when(F.size(found) > 0, good).otherwise(F.array().cast("array<struct<m:string,at:int>>")))
        out = out.withColumn(kind, F.transform(f"_{kind}", lambda x: x["m"])).withColumn(f"{kind}_at", F.transform(f"_{kind}", lambda x: x["at"])).drop(f"_{kind}")
    return out


def _masker(kind: str):
    check, mask = _valid(kind), F.lit(f"[REDACTED:{kind}]")
    return lambda between, match: F.concat(between, F.when(match.isNull(), "").when(check(match), mask).otherwise(match))


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """TQ5: adds ``redacted``: every confirmed match replaced by [REDACTED:kind]. Matches and the text between them
    are laid side by side, so only confirmed ones change. Kinds follow one another, as listed."""
    out = docs.withColumn("redacted", F.coalesce(F.col(text), F.lit("")))
    for kind, pattern in PII.items():
        out = out.withColumn("_m", F.regexp_extract_all("redacted", F.lit(pattern), F.lit(0))).withColumn("_b", F.split("redacted", pattern, -1))
        masked = F.zip_with("_b", "_m", _masker(kind))
        out = out.withColumn("redacted", F.when(F.size("_m") > 0, F.array_join(masked, "")).otherwise(F.col("redacted"))).drop("_m", "_b")
    return out


def simhash_tokens(text: Column | str) -> Column:
    """TQ6: ASCII words of two and more characters, then pairs of adjacent Han characters of each run."""
    latin = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    runs = F.filter(F.regexp_extract_all(text, F.lit(f"[{HAN}]+"), F.lit(0)), lambda r: F.length(r) >= 2)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.concat(latin, pairs)


def estimate_tokens(text: Column | str) -> Column:
    """TQ11: characters of Han, Kana and Hangul count one, four others count one."""
    dense = count_of(text, r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")
    return dense + F.ceil((F.coalesce(F.length(text), F.lit(0)) - dense) / 4).cast("long")


#: TQ7: patterns of text that speaks about itself instead of its subject (fixed values, English part).
DISCOURSE = {
    "meta": r"(?i)\b(as an? (ai|assistant|language model)|i cannot browse|my training data)\b",
    "echo": r"(?i)^\s*(the question (asks|is)|you (asked|are asking))",
    "planning": r"(?i)^\s*(let me|i will|i'll|first,? i)\b",
    "provider_error": r"(?i)(rate limit exceeded|internal server error|service unavailable|timeout exceeded)",
}


def discourse_flags(text: Column | str) -> list[Column]:
    return [F.coalesce(F.col(text).rlike(p) if isinstance(text, str) else text.rlike(p), F.lit(False)).alias(f"is_{k}") for k, p in DISCOURSE.items()]


def unit_coverage(units: DataFrame, keys: list[str]) -> DataFrame:
    """TQ10: for each document of (keys, status, native_chars, generated_chars): units by status and characters."""
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("processed", "failed", "skipped")),
        F.sum("native_chars").alias("native_chars"),
        F.sum("generated_chars").alias("generated_chars"),
        (F.count_if(F.col("status") != "processed") == 0).alias("complete"),
    )


def page_class(pages: Column, text_pages: Column, native_chars: Column, good: Column) -> Column:
    """SRC5: text, scanned or mixed, from page coverage."""
    ratio, average = text_pages / F.greatest(pages, F.lit(1)), native_chars / F.greatest(pages, F.lit(1))
    return (
        F.when(good & (native_chars >= 80) & ((pages == 1) | (ratio >= 0.65)) & (average >= 80), "text")
        .when((ratio <= 0.2) | ((native_chars < 40) & ~good), "scanned")
        .otherwise("mixed")
    )


def confusion(found: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """Counts of a rule against labels, with precision and recall."""
    tp, fp = F.count_if(predicted & truth), F.count_if(predicted & ~truth)
    fn, tn = F.count_if(~predicted & truth), F.count_if(~predicted & ~truth)
    out = found.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    return out.select("*", round_to(safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), round_to(safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"))
