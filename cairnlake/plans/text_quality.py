"""Queries on text quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import text_quality as q
from cairnlake.plans.registry import Plan
from cairnlake.session import read_table as t

_RATIO = "CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"


def _assess_sql(meaningful: str) -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 7 AS k FROM documents),
m AS (SELECT *, length(t) AS n, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g') AS v FROM d),
c AS (SELECT *, len(regexp_extract_all(v, '{meaningful}')) AS meaningful,
      CASE WHEN n = 0 THEN 0.0 ELSE len(regexp_extract_all(t, '\x{{fffd}}')) / CAST(n AS DOUBLE) END AS r,
      CASE WHEN n = 0 THEN 0.0 ELSE len(regexp_extract_all(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) / CAST(n AS DOUBLE) END AS ctl FROM m)
SELECT doc_id, n AS characters, CAST(meaningful AS BIGINT) AS meaningful, round(r, 6) AS replacement_ratio, round(ctl, 6) AS control_ratio,
  CAST(len(regexp_extract_all(t, '(?i)<!--\s*(?:image|picture|figure)(?:[^\n>]*)\s*-->')) AS BIGINT) AS placeholders,
  round(greatest(0.0, least(1.0, 1 - least(r * 4, 0.45) - least(ctl * 2, 0.2))), 4) AS quality_score,
  CASE WHEN meaningful = 0 THEN 'rejected' ELSE 'passed' END AS quality_status FROM c
"""


_LANG_SQL = r"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text[1:2000], '[\x{4e00}-\x{9fff}]')) AS h, len(regexp_extract_all(text[1:2000], '[A-Za-z]')) AS l FROM documents)
SELECT doc_id, CASE WHEN h + l < 10 THEN 'unknown' WHEN h / (h + l) > 0.7 THEN 'zh' WHEN h / (h + l) < 0.15 THEN 'en' ELSE 'mixed' END AS language FROM c
"""
_TOKENS_SQL = r"""
WITH c AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]')) AS d FROM documents)
SELECT doc_id, CAST(d + ceil((n - d) / 4.0) AS BIGINT) AS tokens FROM c
"""
_UNITS = """
SELECT doc_id, count(*) AS units, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'failed') AS failed,
 count(*) FILTER (status = 'skipped') AS skipped, CAST(sum(native_chars) AS BIGINT) AS native_chars, CAST(sum(generated_chars) AS BIGINT) AS generated_chars,
 count(*) FILTER (status <> 'processed') = 0 AS complete
FROM (SELECT doc_id, CASE WHEN length(u) = 0 THEN 'skipped' WHEN length(u) < 40 THEN 'failed' ELSE 'processed' END AS status,
      CASE WHEN length(u) >= 40 THEN length(u) ELSE 0 END AS native_chars, CASE WHEN length(u) < 40 THEN length(u) ELSE 0 END AS generated_chars
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents)) GROUP BY doc_id
"""


def _lines(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("u"))


def _units(spark, d):
    n = F.length("u")
    units = _lines(spark, d).select(
        "doc_id",
        F.when(n == 0, "skipped").when(n < 40, "failed").otherwise("processed").alias("status"),
        F.when(n >= 40, n).otherwise(0).alias("native_chars"),
        F.when(n < 40, n).otherwise(0).alias("generated_chars"),
    )
    return q.unit_coverage(units, ["doc_id"])


def _page_class(spark, d):
    pages = _lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.length("u") >= 40).alias("text_pages"), F.sum(F.length("u")).alias("chars"))
    return pages.select("doc_id", q.page_class(F.col("pages"), F.col("text_pages"), F.col("chars"), F.col("chars") > 0).alias("page_class"))


def _labels(spark, d):
    docs = q.assess_quality(t(spark, d, "documents"))
    found = docs.withColumn("bad", q.count_of("text", "[#*$%&|<>]") * 20 > F.col("characters")).join(t(spark, d, "labels"), "doc_id")
    return q.confusion(found, F.col("bad"), F.col("quality") == 0)


#: A digit run is a phone number of 11 digits, an id of 18 with its check character, or a card of 16 to 19 with Luhn's sum.
_ID_OK = "list_sum(list_transform(range(1, 19), lambda i: CASE WHEN upper(n[i:i]) = 'X' THEN 10 ELSE CAST(n[i:i] AS BIGINT) END * CAST(pow(2, 18 - i) AS BIGINT))) % 11 = 1"
_CARD_OK = "list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN (len(n) - i) % 2 = 0 THEN CAST(n[i:i] AS INTEGER) ELSE (CAST(n[i:i] AS INTEGER) * 2) // 10 + (CAST(n[i:i] AS INTEGER) * 2) % 10 END)) % 10 = 0"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_RUNS = rf"""d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_EMAIL}', '[REDACTED:email]', 'g') AS t FROM documents),
p AS (SELECT doc_id, unnest(list_zip(l, range(1, len(l) + 1)), recursive := true) FROM (SELECT doc_id, list_concat([''], regexp_extract_all(t, '[0-9]+[Xx]?|[^0-9]+')) AS l FROM d)),
k AS (SELECT doc_id, element2 AS i, element1 AS token, regexp_extract(element1, '^[0-9]+') AS digits, regexp_extract(element1, '^[0-9]+([Xx]?)', 1) AS x FROM p),
n AS (SELECT *, CASE WHEN length(digits) = 17 THEN digits || x ELSE digits END AS id FROM k),
v AS (SELECT * EXCLUDE (id), CASE WHEN regexp_matches(digits, '^1[3-9][0-9]{{9}}$') THEN 'phone_cn' WHEN length(id) = 18 AND {_ID_OK.replace("n[", "id[")} THEN 'id_cn' WHEN length(digits) BETWEEN 16 AND 19 AND {_CARD_OK.replace("n[", "digits[").replace("len(n)", "len(digits)")} THEN 'bank_card' END AS kind, id FROM n)"""
_SCAN_SQL = rf"""WITH {_RUNS}, c AS (SELECT doc_id, count(*) FILTER (kind = 'phone_cn') AS phones, count(*) FILTER (kind = 'id_cn') AS ids FROM v GROUP BY 1),
b AS (SELECT doc_id, count(*) FILTER (kind = 'bank_card' OR kind = 'id_cn' AND length(digits) BETWEEN 16 AND 19 AND {_CARD_OK.replace("n[", "digits[").replace("len(n)", "len(digits)")}) AS cards FROM v GROUP BY 1),
e AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_EMAIL}') AS l FROM documents)
SELECT doc_id, len(l) AS emails, array_to_string(l, ',') AS email, phones, ids, cards FROM e JOIN c USING (doc_id) JOIN b USING (doc_id)"""
_REDACT_SQL = rf"""WITH {_RUNS}
SELECT doc_id, sha256(string_agg(CASE WHEN kind IS NULL THEN token ELSE '[REDACTED:' || kind || ']' || CASE WHEN kind = 'id_cn' AND length(digits) = 17 THEN '' ELSE x END END, '' ORDER BY i)) AS redacted_sha256 FROM v GROUP BY 1"""


def _with_facts(s, d):
    """Texts with marks of every kind, and a parser's facts."""
    k = F.col("doc_id")
    marks = F.concat(F.when(k % 3 == 0, "\ufffd").otherwise(""), F.when(k % 4 == 0, "<!-- image -->").otherwise(""))
    docs = t(s, d, "documents").select(
        "doc_id", F.concat(marks, F.coalesce("text", F.lit(""))).alias("text"), F.when(k % 5 == 0, k % 10 - 5).alias("native"), F.when(k % 7 == 0, "rejected").alias("upstream"),
        (k % 11 == 0).cast("int").alias("failed"), (k % 13 == 0).cast("int").alias("skipped"), F.when(k % 17 == 0, "late").alias("ocr"), F.when(k % 6 == 0, 0.5).alias("sure"),
    )
    found = q.assess_quality(docs, confidence="sure", native="native", upstream="upstream", failed="failed", skipped="skipped", ocr_error="ocr")
    return found.select("doc_id", "meaningful", "quality_score", "quality_status", F.array_join("quality_issues", "; ").alias("issues"))


_FACTS_SQL = r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '<!-- image -->' ELSE '' END || coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, length(t) AS n, CASE WHEN doc_id % 5 = 0 THEN greatest(doc_id % 10 - 5, 0) ELSE len(regexp_extract_all(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '[\p{L}\p{N}]')) END AS m,
 len(regexp_extract_all(t, '\x{fffd}')) / greatest(length(t), 1) AS r, len(regexp_extract_all(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) / greatest(length(t), 1) AS k, len(regexp_extract_all(t, '(?i)<!--\s*(?:image|picture|figure)(?:[^\n>]*)\s*-->')) AS p FROM d),
s AS (SELECT *, 1 - least(4 * r, 0.45) - least(2 * k, 0.2) AS score FROM c)
SELECT doc_id, CAST(m AS BIGINT) AS meaningful, round(CASE WHEN doc_id % 6 = 0 THEN least(score, 0.5) ELSE score END, 4) AS quality_score, CASE WHEN m = 0 OR doc_id % 7 = 0 THEN 'rejected' ELSE 'passed' END AS quality_status,
 array_to_string(list_filter([CASE WHEN m = 0 THEN 'no text' END, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'units not covered' END, CASE WHEN r > 0 THEN 'replacement characters' END, CASE WHEN p > 0 THEN 'image placeholders' END, CASE WHEN doc_id % 17 = 0 THEN 'recognition failed' END], lambda x: x IS NOT NULL), '; ') AS issues FROM s"""


PLANS = [
    Plan("tq1_with_facts", _with_facts, _FACTS_SQL),
    Plan("tq1_content_quality", lambda s, d: q.assess_quality(t(s, d, "documents").select("doc_id", "text")).drop("text", "quality_issues"), _assess_sql(r"[\p{L}\p{N}]")),
    Plan("tq2_worker_quality", lambda s, d: q.assess_quality(t(s, d, "documents").select("doc_id", "text"), han_and_ascii_only=True).drop("text", "quality_issues"), _assess_sql(r"[A-Za-z0-9\x{4e00}-\x{9fff}]")),
    Plan("tq3_detect_language", lambda s, d: t(s, d, "documents").select("doc_id", q.detect_language("text").alias("language")), _LANG_SQL),
    Plan(
        "tq4_scan_pii",
        lambda s, d: q.scan_pii(t(s, d, "documents").select("doc_id", "text")).select("doc_id", F.size("email").cast("long").alias("emails"), F.array_join("email", ",").alias("email"), F.size("phone_cn").cast("long").alias("phones"), F.size("id_cn").cast("long").alias("ids"), F.size("bank_card").cast("long").alias("cards")),
        _SCAN_SQL,
    ),
    Plan("tq5_redact_pii", lambda s, d: q.redact_pii(t(s, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256")), _REDACT_SQL),
    Plan(
        "tq6_simhash_tokens",
        lambda s, d: t(s, d, "documents").select("doc_id", q.simhash_tokens("text").alias("tokens")).select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5")),
        r"WITH k AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS l FROM documents) SELECT doc_id, CAST(len(l) AS BIGINT) AS n, md5(array_to_string(l, ' ')) AS tokens_md5 FROM k",
    ),
    Plan(
        "tq7_discourse_flags",
        lambda s, d: t(s, d, "conversations").select("conv_id", "turn", *q.discourse_flags("text")),
        "SELECT conv_id, turn, " + ", ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') AS is_{k}" for k, p in q.DISCOURSE.items()) + " FROM conversations",
    ),
    Plan("tq10_unit_coverage", _units, _UNITS),
    Plan("tq11_estimate_tokens", lambda s, d: t(s, d, "documents").select("doc_id", q.estimate_tokens("text").alias("tokens")), _TOKENS_SQL),
    Plan(
        "src5_page_class",
        _page_class,
        """WITH p AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (length(u) >= 40) AS tp, sum(length(u)) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents) GROUP BY 1)
SELECT doc_id, CASE WHEN c > 0 AND c >= 80 AND (pages = 1 OR tp / pages >= 0.65) AND c / pages >= 80 THEN 'text' WHEN tp / pages <= 0.2 OR (c < 40 AND c = 0) THEN 'scanned' ELSE 'mixed' END AS page_class FROM p""",
    ),
    Plan(
        "tq_rule_against_labels",
        _labels,
        r"""WITH f AS (SELECT len(regexp_extract_all(text, '[#*$%&|<>]')) * 20 > length(text) AS p, quality = 0 AS y FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn FROM f)
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall FROM c""",
    ),
]
