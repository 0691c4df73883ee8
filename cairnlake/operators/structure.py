"""Chunking and document structure, history and grounding in text (CH1-CH22, RP1-RP5, GD1-GD11, DD8)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.operators.vector import is_finite, soft_clusters
from cairnlake.session import bounded_batches, written

#: Fixed values of the chunker: most characters, overlap, shortest tail, clause documents.
MAX_CHARS, OVERLAP, MIN_TAIL, CLAUSES, CLAUSE_MAX = 1800, 200, 150, 3, 5000
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)
CLAUSE = re.compile(r"^\s*(?:第[一二三四五六七八九十百千0-9]+条|Article\s+\d+|§\s*\d+)", re.M)
_ATOMS = re.compile(r"^(```|~~~).*?^\1[^\n]*$|^\$\$.*?\$\$|^\\\[.*?\\\]|(?:^[ \t]*\|[^\n]*(?:\n|\Z)){2,}|(?:^[ \t]*(?:[-*+]|\d+[.)])[ \t]+[^\n]*(?:\n|\Z)){2,}", re.M | re.S)


def atomic_ranges(text: str) -> list[tuple[int, int]]:
    """CH1: ranges of fences, formulas, pipe tables and lists, which a cut avoids."""
    return [m.span() for m in _ATOMS.finditer(text)]


def sections(text: str) -> list[tuple[int, int, list[str]]]:
    """CH2, CH6: (start, end, heading path) of the parts between headings outside atomic ranges."""
    atoms = [r for r in atomic_ranges(text) if text[r[0] : r[0] + 3] in ("```", "~~~")]
    heads = [m for m in HEADING.finditer(text) if not any(a <= m.start() < b for a, b in atoms)]
    out, path = [], []
    if not heads or heads[0].start() > 0:
        out.append((0, heads[0].start() if heads else len(text), []))
    for m, nxt in zip(heads, [*heads[1:], None], strict=False):
        level = len(m.group(1))
        path = [*[h for h in path if h[0] < level], (level, m.group(2))]
        out.append((m.start(), nxt.start() if nxt else len(text), [h[1] for h in path]))
    return [s for s in out if text[s[0] : s[1]].strip()]


def boundary(text: str, start: int, limit: int, atoms: list[tuple[int, int]]) -> int:
    """CH3: where a chunk from ``start`` ends, at ``limit`` at most if possible: before an atomic range that it would cut, else after a
    paragraph or line in its last 45 %, else after a sentence in its last half, else hard."""
    for a, b in atoms:
        if a < limit < b:
            if a > start:
                return a
            if b - start <= 2 * (limit - start):
                return b
    span = limit - start
    for mark, share in (("\n\n", 0.55), ("\n", 0.55)):
        at = text.rfind(mark, start, limit)
        if at >= start + share * span:
            return at + len(mark)
    ends = [m.end() for m in re.finditer(r"[.!?。！？](?=\s|$|[一-鿿])", text[start:limit])]
    return start + ends[-1] if ends and ends[-1] >= 0.5 * span else limit


def chunk_markdown(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, str, int, int, str]]:
    """CH4, CH5: (ord, content, start, end, breadcrumb). Documents of several clauses keep their sections whole up to a longer bound;
    a short rest joins its chunk; chunks of one section overlap."""
    out: list[tuple[int, str, int, int, str]] = []
    if not text.strip():
        return out
    whole = len(CLAUSE.findall(text)) >= CLAUSES
    atoms = atomic_ranges(text)
    for lo, hi, path in sections(text):
        bound, at = (CLAUSE_MAX if whole else most), lo
        while at < hi:
            end = hi if hi - at <= bound + MIN_TAIL else max(at + 1, boundary(text, at, at + bound, atoms))
            if text[at:end].strip():
                out.append((len(out), text[at:end], at, end, " > ".join(path)))
            if end >= hi:
                break
            at = end if end - overlap <= at or any(a < end - overlap < b for a, b in atoms) else end - overlap
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """CH4: a row for each chunk: (id, ord, content, token_count, char_start, char_end, breadcrumb)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, o, c, (len(c) + 3) // 4, a, b, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for o, c, a, b, p in chunk_markdown(t or "", most, overlap)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[id_col, "ord", "content", "token_count", "char_start", "char_end", "breadcrumb"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, ord long, content string, token_count long, char_start long, char_end long, breadcrumb string")


def chinese_number(s: str) -> int:
    """CH7: value of a Chinese numeral up to 10**8, plain digits included."""
    if s.isascii() and s.isdigit():
        return int(s)
    digits = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
    total = part = now = 0
    for c in s:
        if c in digits:
            now = digits[c]
        elif c in "十百千":
            unit = 10 ** ("十百千".index(c) + 1)
            part, now = part + (now or (1 if unit == 10 else 0)) * unit, 0
        elif c == "万":
            total, part, now = total + (part + now) * 10000, 0, 0
    return total + part + now


def indexable(text: Column | str) -> Column:
    """CH9: what the index sees of a chunk: the question of a question record, else the text without rendering comments."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    question = F.regexp_extract(t, r"^<!-- qa-question:([A-Za-z0-9+/=]+) -->", 1)
    plain = t
    for mark in ("大纲层级", "bbox", "表格结构摘要"):
        plain = F.regexp_replace(plain, rf"(?s)<!--\s*{mark}:.*?-->", "")
    plain = F.regexp_replace(plain, r"(?s)<!--\s*表格结构化行语义:\s*(.*?)-->", "$1")
    plain = F.trim(F.regexp_replace(plain, r"\n{3,}", "\n\n"))
    return F.when(question != "", F.decode(F.unbase64(question), "utf-8")).otherwise(plain)


def canonical_block(docs: DataFrame) -> DataFrame:
    """CH10: (doc_id, ord, kind, content_hash) of chunks: table, mixed or text by its share of pipe lines."""
    lines = F.split("content", "\n")
    pipes, n = F.size(F.filter(lines, lambda x: F.trim(x).startswith("|"))), F.size(F.filter(lines, lambda x: F.trim(x) != ""))
    kind = F.when((pipes > 0) & (pipes == n), "table").when(pipes > 0, "mixed").otherwise("text")
    return docs.select("doc_id", "ord", kind.alias("kind"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


def table_role(rows: Column, header: Column, section: Column) -> Column:
    """CH11: summary, detail or unknown, by words of header and section, else by the number of rows."""
    text = F.concat_ws("\n", header, section)
    summary, detail = text.rlike("汇总|合计|统计|总计|总览|摘要"), text.rlike("明细|清单|逐条|逐项")
    return F.when(detail & ~summary, "detail").when(summary, "summary").when((rows > 0) & (rows <= 8), "summary").when(rows > 20, "detail").otherwise("unknown")


def outline(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """CH12: distinct headings of each document with level and first line, lines in fences skipped."""
    # A line is in a fence if an odd number of fence lines stands before it.
    fences = F.transform(F.split(text, "\n"), lambda x: F.trim(x).startswith("```").cast("int"))
    marked = docs.select(id_col, F.split(text, "\n").alias("l"), fences.alias("f")).withColumn("open", F.aggregate("f", F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))))
    lines = marked.select(id_col, F.posexplode(F.arrays_zip("l", "open")).alias("line_no", "z")).select(id_col, "line_no", F.col("z.l").alias("line"), F.col("z.open").alias("open"))
    heads = lines.where((F.col("open") % 2 == 0) & F.col("line").rlike(r"^#{1,6}\s+\S"))
    heads = heads.select(id_col, F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+\s+", "")).alias("heading"), "line_no")
    return heads.groupBy(id_col, "level", "heading").agg(F.min("line_no").alias("line_no"))


def section_multiplier(mentioned: Column, body: Column, role: Column, asked_summary: Column, evidence_chars: Column) -> Column:
    """CH13: 1.35 where the section is named, 1.15 where the body is, times 1.25 for a summary table that was asked for; a detail
    table counts 0.85 only if a summary was asked for, the evidence is over 800 characters and nothing matched."""
    base = F.when(mentioned, 1.35).when(body, 1.15).otherwise(1.0)
    return base * F.when(asked_summary & (role == "summary"), 1.25).when(asked_summary & (role == "detail") & (evidence_chars > 800) & ~mentioned & ~body, 0.85).otherwise(1.0)


def pack_windows(blocks: DataFrame, doc: str, order: str, length: str, most: int) -> DataFrame:
    """CH15, RP4: blocks of a document in windows of at most ``most`` characters by running sums: the window of a block is where its end falls."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("window", F.floor((F.sum(length).over(w) - 1) / most).cast("int"))


def sibling_ranges(hits: DataFrame, all_chunks: DataFrame, span: int) -> DataFrame:
    """CH17, JN10: chunks of each hit document from ``span`` before its first to ``span`` after its last hit."""
    ranges = hits.groupBy("doc_id").agg((F.min("ord") - span).alias("lo"), (F.max("ord") + span).alias("hi"))
    return all_chunks.join(ranges, "doc_id").where(F.col("ord").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def stitch(hits: DataFrame, most: int = 12000) -> DataFrame:
    """CH18, WN8: runs of adjacent chunks of a document become one passage, cut where it would pass ``most`` characters."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    islands = hits.withColumn("island", F.col("ord") - F.row_number().over(w))
    own = Window.partitionBy("doc_id", "island").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    parts = islands.withColumn("part", F.floor((F.sum(F.length("content")).over(own) - 1) / most))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n")
    return parts.groupBy("doc_id", "island", "part").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), text.alias("content")).drop("island", "part")


def rebuild(parts: DataFrame) -> DataFrame:
    """CH21: a document from overlapping chunks (doc_id, char_start, char_end, content): what earlier chunks cover is cut off."""
    w = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    seen = F.coalesce(F.max("char_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = parts.withColumn("_seen", seen).where(F.col("char_end") > F.col("_seen")).withColumn("_skip", F.greatest(F.lit(0), F.col("_seen") - F.col("char_start")))
    cut = cut.withColumn("_t", F.expr("substring(content, cast(_skip + 1 as int))"))
    return cut.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "_t"))), lambda x: x["_t"]), "").alias("text"))


def merge_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """CH22: units (doc_id, unit, text) with retried ones replaced, and the offset of each in the joined text."""
    both = old.join(new.select("doc_id", "unit", F.col("text").alias("_new")), ["doc_id", "unit"], "left").withColumn("text", F.coalesce("_new", "text")).withColumn("retried", F.col("_new").isNotNull()).drop("_new")
    w = Window.partitionBy("doc_id").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))


def group_sections(parts: DataFrame) -> DataFrame:
    """RP2: chunk ids of each chapter of a document, in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"])
    return parts.groupBy("doc_id", "section").agg(ids.alias("chunk_ids"), F.min("ord").alias("first_ord"))


def extractive_summary(text: Column | str, sentences: int = 4, least: int = 10, most: int = 1800) -> Column:
    """RP3: the first sentences of ten and more characters, 1800 characters at most (the summary's own bound)."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?。！？\n]+[.!?。！？]?"), F.lit(0)), lambda s: F.length(F.trim(s)) >= least)
    return F.substring(F.array_join(F.transform(F.slice(parts, 1, sentences), lambda s: F.trim(s)), " "), 1, most)


def numeric_claims(text: Column | str) -> Column:
    """GD1: distinct numbers of an answer, citation marks left out, thousands separators dropped."""
    bare = F.regexp_replace(text, r"\[\d+(?:\s*[,，]\s*\d+)*\]", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"\d+(?:,\d{3})*(?:\.\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(""))))


#: GD2: fixed values: units, what they measure and their factor.
UNITS = {"mm": ("m", 0.001), "cm": ("m", 0.01), "m": ("m", 1.0), "km": ("m", 1000.0), "g": ("kg", 0.001), "kg": ("kg", 1.0), "t": ("kg", 1000.0), "s": ("s", 1.0), "min": ("s", 60.0), "h": ("s", 3600.0), "%": ("1", 0.01)}


def quantities(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """GD2: (id, measure, value in the base unit) of numbers with a known unit."""
    marks = "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(rf"\d+(?:\.\d+)?\s?(?:{marks})(?![A-Za-z])"), F.lit(0))
    rows = docs.select(id_col, F.explode(found).alias("q")).select(id_col, F.regexp_extract("q", r"^([\d.]+)", 1).cast("double").alias("n"), F.regexp_extract("q", rf"({marks})$", 1).alias("u"))
    measure, factor = (F.create_map(*(F.lit(x) for k, v in UNITS.items() for x in (k, v[i]))) for i in (0, 1))
    return rows.select(id_col, measure[F.col("u")].alias("measure"), (F.col("n") * factor[F.col("u")]).alias("value"))


def supported_quantities(claims: DataFrame, evidence: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """GD2: for each answer claimed and supported quantities: one of the same measure and value, to a relative tolerance, is in its evidence."""
    # Values are compared in logarithmic cells as wide as the tolerance, each with its two neighbours.
    cell = lambda v: F.floor(F.log(F.greatest(v, F.lit(1e-300))) / tolerance)
    c = claims.select("answer_id", "measure", "value").distinct().withColumn("cell", cell(F.col("value")))
    e = evidence.select("answer_id", "measure", F.col("value").alias("v")).distinct().withColumn("cell", F.explode(F.array(*(cell(F.col("v")) + i for i in (-1, 0, 1)))))
    hit = c.join(e, ["answer_id", "measure", "cell"]).where(F.abs(F.col("value") - F.col("v")) <= tolerance * F.greatest(F.abs("value"), F.abs("v"))).select("answer_id", "measure", "value").distinct().withColumn("hit", F.lit(1))
    return c.join(hit, ["answer_id", "measure", "value"], "left").groupBy("answer_id").agg(F.count(F.lit(1)).alias("claims"), F.count("hit").alias("supported"))


def char_overlap(statement: Column, evidence: Column) -> Column:
    """GD4: share of a statement's distinct letters and digits that the evidence holds."""
    letters = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), ""), lambda c: c.rlike(r"[\p{L}\p{N}]")))
    a = letters(statement)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, letters(evidence))) / F.size(a))


def valid_markers(text: Column, citations: Column) -> Column:
    """GD6: an answer without citation marks [n] that name no citation: the marks and the text between them side by side."""
    marks, between = F.regexp_extract_all(text, F.lit(r"\[\d+\]"), F.lit(0)), F.split(text, r"\[\d+\]", -1)
    number = lambda m: F.regexp_extract(m, r"(\d+)", 1).cast("int")
    return F.array_join(F.zip_with(between, marks, lambda b, m: F.concat(b, F.when(m.isNull() | ~number(m).between(1, citations), "").otherwise(m))), "")


def compress_history(turns: DataFrame, conv: str, turn: str, text: str, verbatim: int = 6, digest: int = 200, cap: int = 6000) -> DataFrame:
    """GD7: turns that stay: the last ``verbatim`` whole, older ones as 60 % head and 40 % tail of a digest, the oldest dropped where
    the characters of all newer ones pass the cap."""
    last = Window.partitionBy(conv).orderBy(F.desc(turn))
    n = F.row_number().over(last)
    head, tail = int(digest * 0.6), digest - int(digest * 0.6)
    short = F.when(F.length(text) <= digest, F.col(text)).otherwise(F.concat(F.substring(text, 1, head), F.lit(" … "), F.right(text, F.lit(tail))))
    out = turns.withColumn("age", n).withColumn("kept_text", F.when(n <= verbatim, F.col(text)).otherwise(short))
    size = F.sum(F.length("kept_text")).over(last.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_size", size).where((F.col("_size") <= cap) | (F.col("age") == 1)).drop("_size")


#: GD8: words that carry no aspect (fixed values).
STOP = ("what", "when", "where", "which", "with", "that", "this", "from", "have", "does", "about", "between", "there", "their", "were", "been", "would", "could", "should")


def aspects(question: Column | str) -> Column:
    """GD8: words of four and more letters that are no stop words, and pairs of adjacent Han characters."""
    from cairnlake.functions.text import HAN

    words = F.filter(F.regexp_extract_all(F.lower(question), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*STOP))
    runs = F.filter(F.regexp_extract_all(question, F.lit(f"[{HAN}]+"), F.lit(0)), lambda r: F.length(r) >= 2)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def aspect_coverage(question: Column, text: Column) -> Column:
    a = aspects(question)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.filter(a, lambda w: F.contains(F.lower(text), w))) / F.size(a))


def complexity(question: Column | str) -> Column:
    """GD9: comparative, multi_hop, global or simple, the first rule that matches."""
    q = F.lower(question)
    return (
        F.when(q.rlike(r"\b(compare|versus|vs\.?|difference between)\b|对比|区别|相比"), "comparative")
        .when(q.rlike(r"\b(whose|of the \w+ (that|who|which))\b|的.*的"), "multi_hop")
        .when(q.rlike(r"\b(overall|summari[sz]e|overview|in general)\b|总体|概述|总结"), "global")
        .otherwise("simple")
    )


def relation_of(question: Column | str) -> Column:
    """GD10: the asked relation and its subject: "what is the X of Y"."""
    pattern = r"(?i)(?:what|who) (?:is|was|are|were) the ([\w ]{2,40}?) of ([\w ]{2,60})"
    return F.struct(F.regexp_extract(question, pattern, 1).alias("relation"), F.trim(F.regexp_extract(question, pattern, 2)).alias("subject"))


def coverage_sufficient(terms: DataFrame, hits: DataFrame, top: int = 8, share: float = 0.8, docs: int = 2) -> DataFrame:
    """GD11: for each query whether its best ``top`` hits hold at least a share of its terms and come from at least two documents."""
    first = hits.where(F.col("rank") <= top)
    found = terms.join(first, "query_id").where(F.contains(F.lower("text"), F.col("term"))).select("query_id", "term").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    n = terms.groupBy("query_id").agg(F.countDistinct("term").alias("terms"))
    d = first.groupBy("query_id").agg(F.countDistinct("doc_id").alias("docs"))
    out = n.join(found, "query_id", "left").join(d, "query_id", "left")
    return out.select("query_id", (F.coalesce("n", F.lit(0)) / F.col("terms")).alias("coverage"), ((F.coalesce("n", F.lit(0)) >= share * F.col("terms")) & (F.coalesce("docs", F.lit(0)) >= docs)).alias("sufficient"))


def join_overlap(left: str, right: str, most: int = 4096, least: int = 12) -> str:
    """DD8: two texts as one, without the longest suffix of the left that begins the right (over 12 characters)."""
    for n in range(min(most, len(left), len(right)), least, -1):
        if left.endswith(right[:n]):
            return left + right[n:]
    return f"{left}\n{right}"


#: CH8: a row of a pipe table, the row under its header, rows of which the meaning is written out.
TABLE_ROW, TABLE_RULE, TABLE_HEAD, MAX_MEANT = r"^[ \t]*\|.*\|[ \t]*$", r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$", r"(?m)^([ \t]*\|[^\n]*\|)[ \t]*\n[ \t]*\|?[ \t]*:?-{3,}[-:| \t]*$", 40


def _cells(row: Column) -> Column:
    inner = F.regexp_replace(F.trim(row), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("**"), F.lit("")))


def carry_table_headers(chunks: DataFrame, doc: str = "doc_id", order: str = "ord", text: str = "content") -> DataFrame:
    """CH8: adds ``with_header`` (a chunk that goes on with a table begins its rows with the header of the last one before it, if
    their columns differ by one at most) and ``row_meanings`` (for up to ``MAX_MEANT`` rows "header: cell" of its cells)."""
    head = F.regexp_extract(text, TABLE_HEAD, 0)
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = chunks.withColumn("_own", F.nullif(head, F.lit(""))).withColumn("_last", F.last("_own", True).over(before)).withColumn("_lines", F.split(text, "\n"))
    rows = F.filter("_lines", lambda x: x.rlike(TABLE_ROW) & ~x.rlike(TABLE_RULE))
    fits = F.col("_own").isNull() & F.col("_last").isNotNull() & (F.size(rows) > 0) & (F.abs(F.size(_cells(F.get(rows, F.lit(0)))) - F.size(_cells(F.split("_last", "\n")[0]))) <= 1)
    at = F.array_position("_lines", F.get(rows, F.lit(0))).cast("int")
    joined = F.array_join(F.concat(F.slice("_lines", F.lit(1), at - 1), F.array("_last"), F.slice("_lines", at, F.size("_lines"))), "\n")
    out = out.withColumn("with_header", F.when(fits, joined).otherwise(F.col(text)))
    header = _cells(F.split(F.coalesce("_own", F.when(fits, F.col("_last"))), "\n")[0])
    own_at = F.array_position("_lines", F.split("_own", "\n")[0])
    body = F.filter(F.when(fits, F.col("_lines")).otherwise(F.slice("_lines", (own_at + 2).cast("int"), F.size("_lines"))), lambda x: x.rlike(TABLE_ROW) & ~x.rlike(TABLE_RULE))
    named = lambda row: F.array_join(F.array_compact(F.zip_with(header, _cells(row), lambda h, c: F.when((h != "") & (c != ""), F.concat_ws(": ", h, c)))), " | ")
    meant = F.filter(F.transform(body, named), lambda x: x != "")
    return out.withColumn("row_meanings", F.coalesce(F.slice(meant, 1, MAX_MEANT), F.array().cast("array<string>"))).drop("_own", "_last", "_lines")


def cluster_members(parts: DataFrame, window: int = 250, most_groups: int = 6, least: int = 3) -> DataFrame:
    """RP1: the membership of chunks (kb_id, doc_id, section, ord, embedding): (kb_id, doc_id, ord, node). Contiguous windows of a document's
    chunks are clustered softly by their vectors, so a chunk may be in several nodes; chunks without a finite vector, and windows
    with fewer than ``least`` of them, go by section: no chunk is left out."""
    numbered = parts.withColumn("_w", F.floor((F.row_number().over(Window.partitionBy("kb_id", "doc_id").orderBy("ord")) - 1) / window).cast("int"))
    ok = is_finite("embedding") & F.exists("embedding", lambda x: x != 0)
    own = Window.partitionBy("kb_id", "doc_id", "_w")
    told = numbered.withColumn("_ok", ok).withColumn("_n", F.count_if("_ok").over(own)).withColumn("_own", F.col("_ok") & (F.col("_n") >= least))
    kind = {c: parts.schema[c].dataType.simpleString() for c in ("kb_id", "doc_id", "ord")}

    def clustered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        k = min(most_groups, min(8, max(2, math.ceil(math.sqrt(len(group))))))
        found = soft_clusters(np.array(group["embedding"].tolist(), np.float64), k)
        at = [(i, c) for i, cs in enumerate(found) for c in cs]
        out = group[["kb_id", "doc_id", "ord"]].iloc[[i for i, _ in at]].reset_index(drop=True)
        return out.assign(node=[f"w{group['_w'].iloc[0]}-c{c}" for _, c in at])

    by_vector = told.where("_own").select("kb_id", "doc_id", "ord", "embedding", "_w").groupBy("kb_id", "doc_id", "_w").applyInPandas(clustered, ", ".join(f"{c} {k}" for c, k in kind.items()) + ", node string")
    by_section = told.where("NOT _own").select("kb_id", "doc_id", "ord", F.concat(F.lit("s-"), F.coalesce(F.col("section").cast("string"), F.lit(""))).alias("node"))
    return by_vector.unionByName(by_section)


def cluster_tree(parts: DataFrame, vectors: DataFrame | None = None, window: int = 250, sentences: int = 4, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """RP1: the summary tree over windowed clusters, and its membership: chunks (kb_id, doc_id, section, ord, content), ord unique in a document,
    with their vectors (doc_id, ord, embedding), or with a column embedding. Sources of the levels above count memberships."""
    short = parts.drop("content") if vectors is None else parts.select("kb_id", "doc_id", "section", "ord").join(vectors, ["doc_id", "ord"], "left")
    members = written(cluster_members(short, window), "members")
    grouped = parts.select("kb_id", "doc_id", "ord", "content").join(members, ["kb_id", "doc_id", "ord"]).withColumnRenamed("node", "section")
    return summary_tree(grouped, sentences, group), members


def summary_tree(parts: DataFrame, sentences: int = 4, group: int = 20) -> DataFrame:
    """RP1, RP4, RP5: summary nodes (kb_id, doc_id, level, node, content, sources) of chunks (kb_id, doc_id, section, ord, content):
    level 0 for each section, level 1 for each document from its sections' summaries, level 2 for each knowledge base from its
    documents'. A level's texts are summarised ``group`` at a time, in order, until one is left, so no summary reads more than that."""

    def shortened(rows: DataFrame, keys: list[str]) -> DataFrame:
        """One row for each of keys: content, sources, of rows (keys, nth, content, sources)."""
        while True:
            parts_ = rows.withColumn("_g", F.floor(F.col("nth") / group))
            text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "content"))), lambda x: x["content"]), "\n")
            rows = parts_.groupBy(*keys, "_g").agg(extractive_summary(text, sentences).alias("content"), F.sum("sources").alias("sources")).withColumnRenamed("_g", "nth")
            if not rows.where("nth > 0").limit(1).count():
                return rows.drop("nth")
            rows = written(rows, "summaries")

    def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)

    own = ["kb_id", "doc_id", "section"]
    first = parts.groupBy(*own).agg(F.min("ord").alias("first_ord"))
    zero = written(shortened(numbered(parts.withColumn("sources", F.lit(1)), own, ["ord"]).select(*own, "nth", "content", "sources"), own).join(first, own), "level-0")
    one = written(shortened(numbered(zero, own[:2], ["first_ord", "section"]).select(*own[:2], "nth", "content", "sources"), own[:2]), "level-1")
    # A knowledge base may hold a third of all documents: they are dealt by hash, not numbered in one task.
    sizes = one.groupBy("kb_id").agg(F.ceil(F.count(F.lit(1)) / group).alias("groups"))
    dealt = one.join(sizes, "kb_id").withColumn("nth", F.pmod(F.xxhash64("doc_id"), "groups") * group)
    two = shortened(dealt.select("kb_id", "nth", "content", "sources"), own[:1])
    nothing = lambda kind: F.lit(None).cast(kind)
    kind = parts.schema["doc_id"].dataType
    levels = [
        zero.select("kb_id", "doc_id", F.lit(0).alias("level"), F.col("section").alias("node"), "content", "sources"),
        one.select("kb_id", "doc_id", F.lit(1).alias("level"), F.lit("document").alias("node"), "content", "sources"),
        two.select("kb_id", nothing(kind).alias("doc_id"), F.lit(2).alias("level"), F.lit("kb-global").alias("node"), "content", "sources"),
    ]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])
