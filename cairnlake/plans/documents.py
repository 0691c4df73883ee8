"""Queries on raw files, tables in chunks, summary trees and communities. Files are made from the given tables by Spark."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

from cairnlake.functions.text import round_to
from cairnlake.operators import graph as gr
from cairnlake.operators import lexical as lx
from cairnlake.operators import rank as rk
from cairnlake.operators import structure as st
from cairnlake.plans.registry import Plan
from cairnlake.session import bounded_batches, fresh_path
from cairnlake.session import read_table as t
from cairnlake.sources import readers as rd
from cairnlake.sources.archives import ArchiveSource
from cairnlake.sources.workbooks import WorkbookSource, place, regions
from cairnlake.streaming import jobs


def _decoded(s, d):
    """Every third text as UTF-16 with its mark, the others as UTF-8."""
    bounded_batches(s)
    body = F.coalesce("text", F.lit(""))
    raw = F.when(F.col("doc_id") % 3 == 1, F.encode(body, "UTF-16")).otherwise(body.cast("binary"))
    return t(s, d, "documents").select("doc_id", rd.decoded(raw).alias("text")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _qa_csv(s, d):
    docs = t(s, d, "documents")
    text = F.coalesce("text", F.lit(""))
    question = F.concat(F.lit('Say "'), F.col("source"), F.lit('",\nwhich?'))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), question.alias("question"), F.concat(F.lit("A: "), F.regexp_replace(text, r"\r", " "), F.lit(".")).alias("answer"),
        *(F.lit(None).cast("string").alias(c) for c in ("aliases", "scope", "language", "effectiveFrom", "effectiveTo", "sourceDocumentId", "sourceVersionId")),
    )
    path = fresh_path(s, "qa")
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    got = rd.read_qa_csv(s, path)
    return got.select(F.col("id").cast("long").alias("doc_id"), F.md5(F.col("question").cast("binary")).alias("question_md5"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


def _artifact(s, d):
    path = fresh_path(s, "artifact")
    # An artifact holds a million rows of about 80 bytes at most, under half its budget; there are as many as the table needs.
    t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").write.option("maxRecordsPerFile", 1_000_000).json(path)
    got = rd.read_table_artifact(s, path, "o_orderkey long, o_totalprice double, o_orderpriority string")
    return got.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), round_to(F.sum("o_totalprice"), 2).alias("price"), F.min("o_orderkey").alias("least"))


@F.pandas_udf(BinaryType())
def _zipped(ids: pd.Series, texts: pd.Series) -> pd.Series:
    def one(i: int, text: str | None) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in ((f"d{i}/a.md", text or ""), (f"d{i}/b/c.txt", "second"), (f"d{i}/.hidden.md", "x"), (f"d{i}/x.exe", "x"), (f"d{i}/../e.md", "x")):
                z.writestr(name, body)
        return out.getvalue()

    return pd.Series(one(i, x) for i, x in zip(ids, texts, strict=True))


def _archives(s, d):
    files = t(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), _zipped("doc_id", "text").alias("content"))
    return rd.expand_archives(files).select(F.col("path").cast("long").alias("doc_id"), "title", "status", "size")


def _zip_writer(folder: str):
    """Writes the archives of a stretch of documents, named by their number; every seventh is cut in half, every eleventh has too many files."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("archive")[0].as_py()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, text in sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)):
                z.writestr(f"a{number}/d{i}.md", text or "")
            for n in range(501 if number % 11 == 5 else 0):
                z.writestr(f"a{number}/{n}.txt", "")
            z.writestr(f"a{number}/.hidden.md", "x")
        data = out.getvalue()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{number:09d}.zip") as f:
            f.write(data[: len(data) // 2] if number % 7 == 3 else data)
        return pa.table({"archive": pa.array([number], pa.int64())})

    return run


def _archive_source(s, d):
    """Documents in archives of about forty, read back by the data source."""
    folder = fresh_path(s, "zips")
    docs = t(s, d, "documents").where("doc_id IS NOT NULL").select(F.floor(F.col("doc_id") / 40).cast("long").alias("archive"), "doc_id", "text")
    docs.groupBy("archive").applyInArrow(_zip_writer(folder), "archive long").write.format("noop").mode("overwrite").save()
    s.dataSource.register(ArchiveSource)
    found = s.read.format("archives").load(folder)
    return found.select(F.regexp_extract("archive", r"(\d+)", 1).cast("long").alias("archive"), "title", "status", "size", F.sha2("content", 256).alias("sha256"))


ARCHIVE_SOURCE_SQL = """WITH d AS (SELECT doc_id // 40 AS archive, doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL), a AS (SELECT DISTINCT archive, archive % 7 = 3 AS cut, archive % 11 = 5 AS packed FROM d)
SELECT archive, NULL AS title, CASE WHEN cut THEN 'broken' ELSE 'too_many_files' END AS status, NULL::BIGINT AS size, NULL AS sha256 FROM a WHERE cut OR packed
UNION ALL SELECT archive, 'd' || doc_id || '.md', 'ok', octet_length(encode(text)), sha256(text) FROM d JOIN a USING (archive) WHERE NOT cut AND NOT packed
UNION ALL SELECT archive, 'a' || archive || '/.hidden.md', 'hidden', 1, NULL FROM a WHERE NOT cut AND NOT packed"""


def workbook(sheets: dict[str, tuple[dict[str, object], list[str]]]) -> bytes:
    """A workbook as its zipped XML. Sheets: cells by reference (text, a number, (number, format) or (formula, stored number or None)),
    and merged areas. Texts are shared strings; format 10 is a share with two places."""
    strings: dict[str, int] = {}
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    refs = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(ref: str, value: object) -> str:
        if isinstance(value, str):
            return f'<c r="{ref}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
        if isinstance(value, tuple) and isinstance(value[0], str):
            return f'<c r="{ref}"><f>{value[0]}</f>' + (f"<v>{value[1]}</v>" if value[1] is not None else "") + "</c>"
        number, style = value if isinstance(value, tuple) else (value, 0)
        return f'<c r="{ref}" s="{int(style == 10)}"><v>{number!r}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, (cells, merges) in enumerate(sheets.values(), 1):
            rows: dict[int, list] = {}
            for ref, value in cells.items():
                at = place(ref)
                rows.setdefault(at[0], []).append((at[1], cell(ref, value)))
            data = "".join(f'<row r="{r}">{"".join(x for _, x in sorted(cs))}</row>' for r, cs in sorted(rows.items()))
            merged = f"<mergeCells>{''.join(f'<mergeCell ref="{m}"/>' for m in merges)}</mergeCells>" if merges else ""
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {main}><sheetData>{data}</sheetData>{merged}</worksheet>")
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{refs}"><sheets>{"".join(f"<sheet name={quoteattr(name)} sheetId=\'{n}\' r:id=\'r{n}\'/>" for n, name in enumerate(sheets, 1))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"<Relationship Id=\'r{n}\' Type=\'{refs}/worksheet\' Target=\'worksheets/sheet{n}.xml\'/>" for n in range(1, len(sheets) + 1))}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{escape(x)}</t></si>' for x in strings)}</sst>")
    return out.getvalue()


def _workbook_writer(folder: str):
    """Writes a workbook for each hundred documents: a table under two rows of headers, its sum, and a second table beneath."""

    def run(table: pa.Table) -> pa.Table:
        number, table = table.column("book")[0].as_py(), table.sort_by("doc_id")
        cells: dict[str, object] = {"A1": "Document", "B1": "Size", "B2": "characters (chars)", "C2": "share", "D1": "lang"}
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "n", "lang")), strict=True))
        for r, (i, n, lang) in enumerate(rows, 3):
            cells |= {f"A{r}": i, f"B{r}": n, f"C{r}": (n / 20_000, 10)} | ({f"D{r}": lang} if lang else {})
        end = len(rows) + 3
        cells |= {f"B{end}": (f"SUM(B3:B{end - 1})", sum(n for _, n, _ in rows)), f"A{end + 2}": "kind", f"B{end + 2}": "count", f"A{end + 3}": "documents", f"B{end + 3}": len(rows)}
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{number:09d}.xlsx") as f:
            f.write(workbook({"Sizes & more": (cells, ["A1:A2", "B1:C1", "D1:D2"])}))
        return pa.table({"book": pa.array([number], pa.int64())})

    return run


def _workbooks(s, d):
    folder = fresh_path(s, "books")
    docs = t(s, d, "documents").where("doc_id IS NOT NULL").select(F.floor(F.col("doc_id") / 100).cast("long").alias("book"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), "lang")
    docs.groupBy("book").applyInArrow(_workbook_writer(folder), "book long").write.format("noop").mode("overwrite").save()
    s.dataSource.register(WorkbookSource)
    found = regions(s.read.format("workbooks").load(folder))
    return found.where("NOT is_header").select(F.regexp_extract("workbook", r"(\d+)", 1).cast("long").alias("book"), "band", "row", "header", "kind", "text", round_to(F.col("number")).alias("number"), "unit", "is_summary")


WORKBOOK_SQL = """WITH d AS (SELECT doc_id // 100 AS book, doc_id, coalesce(length(text), 0) AS n, lang, 2 + row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS r FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT book, count(*) AS c, sum(n) AS n FROM d GROUP BY 1)
SELECT book, 0 AS band, r AS row, 'Document' AS header, 'number' AS kind, CAST(doc_id AS VARCHAR) AS text, doc_id::DOUBLE AS number, NULL AS unit, false AS is_summary FROM d
UNION ALL SELECT book, 0, r, 'Size / characters (chars)', 'number', CAST(n AS VARCHAR), n, 'chars', false FROM d
UNION ALL SELECT book, 0, r, 'Size / share', 'number', CASE WHEN n = 0 THEN '0.0' ELSE CAST(n::DOUBLE / 20000 AS VARCHAR) END, round(n::DOUBLE / 20000, 6), '%', false FROM d
UNION ALL SELECT book, 0, r, 'lang', 'string', lang, NULL, NULL, false FROM d WHERE lang <> ''
UNION ALL SELECT book, 0, c + 3, 'Size / characters (chars)', 'formula', CAST(n AS VARCHAR), n, 'chars', true FROM b
UNION ALL SELECT book, 1, c + 6, 'kind', 'string', 'documents', NULL, NULL, false FROM b UNION ALL SELECT book, 1, c + 6, 'count', 'number', CAST(c AS VARCHAR), c, NULL, false FROM b"""


def _batches(s, d):
    out = fresh_path(s, "batches")
    rows = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for _ in range(2):  # the second write replaces the first
        path = rd.write_batches(rows, out, "f00d", 1000)
    return s.read.json(path, schema="o_orderkey long, o_custkey long, o_orderstatus string")


_DIGITS = "零一二三四五六七八九"


@F.pandas_udf(LongType())
def _numbers(texts: pd.Series) -> pd.Series:
    return texts.map(st.chinese_number)


def _numerals(s, d):
    """Order numbers below ten thousand, written out."""
    n = F.col("o_orderkey") % 10000
    digit = lambda k: F.substring(F.lit(_DIGITS), (F.floor(n / k) % 10 + 1).cast("int"), F.lit(1))
    tens = F.when(F.floor(n / 10) % 10 == 0, F.lit("零")).otherwise(F.concat(digit(10), F.lit("十")))
    text = F.concat(digit(1000), F.lit("千"), digit(100), F.lit("百"), tens, digit(1))
    return t(s, d, "orders").select("o_orderkey", _numbers(text).alias("value"))


@F.pandas_udf(StringType())
def _overlapped(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(st.join_overlap(a, b) for a, b in zip(left, right, strict=True))


def _joined(s, d):
    """The first and last parts of texts without repeated stretches: digests follow one another."""
    body = F.concat_ws(" ", *(F.sha2(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit(str(k))).cast("binary"), 256) for k in range(6)))
    docs = t(s, d, "documents").select("doc_id", body.alias("body"))
    return docs.select("doc_id", _overlapped(F.substring("body", 1, 260), F.expr("substring(body, 130)")).alias("text"))


def _chunks(s, d):
    """Orders' lines as pipe tables over several chunks: a customer is a document; the first chunk of each has the header."""
    o = t(s, d, "orders").withColumn("ord", F.row_number().over(st.Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | **"), F.col("o_orderstatus"), F.lit("** |"))
    text = F.when(F.col("ord") == 1, F.concat(F.lit("Intro\n| key | state |\n|---|:-:|\n"), row)).when(F.col("ord") % 3 == 0, F.lit("plain words")).otherwise(F.concat(F.lit("see\n"), row, F.lit("\nend")))
    return o.select(F.col("o_custkey").alias("doc_id"), "ord", text.alias("content"))


def _tree(s, d):
    """Orders as chunks: the market segment is the knowledge base, the customer the document, the priority the section."""
    c = t(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("kb_id"))
    text = F.concat_ws(" ", F.lit("Order"), F.col("o_orderkey").cast("string"), F.lit("was placed."), F.lit("It is of state"), F.col("o_orderstatus"), F.lit("now."))
    o = t(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("section"), F.col("o_orderkey").alias("ord"), text.alias("content"))
    return st.summary_tree(o.join(c, "doc_id"))


def _tree_counts(s, d):
    """Sources under every node: each level counts all chunks of what it stands for."""
    return _tree(s, d).groupBy("kb_id", "level").agg(F.count(F.lit(1)).alias("nodes"), F.sum("sources").alias("sources"), F.count_if(F.length("content") > 0).alias("told"))


def _tree_texts(s, d):
    """Summaries of sections and documents."""
    return _tree(s, d).where("level < 2").select("kb_id", "doc_id", "level", "node", "content", "sources")


#: A chunk holds two sentences and a summary four: the first two orders of a section, and the first two of a document by section.
TREE_TEXTS_SQL = """WITH o AS (SELECT c_mktsegment AS kb_id, o_custkey AS doc_id, o_orderpriority AS section, o_orderkey AS ord, 'Order ' || o_orderkey || ' was placed. It is of state ' || o_orderstatus || ' now.' AS content FROM orders JOIN customer ON c_custkey = o_custkey),
k AS (SELECT *, row_number() OVER w AS nth, min(ord) OVER (PARTITION BY kb_id, doc_id, section) AS first_ord, count(*) OVER (PARTITION BY kb_id, doc_id, section) AS n, count(*) OVER (PARTITION BY kb_id, doc_id) AS total FROM o WINDOW w AS (PARTITION BY kb_id, doc_id, section ORDER BY ord)),
z AS (SELECT *, row_number() OVER (PARTITION BY kb_id, doc_id ORDER BY first_ord, section, ord) AS place FROM k WHERE nth <= 2)
SELECT kb_id, doc_id, 0 AS level, section AS node, string_agg(content, ' ' ORDER BY ord) AS content, any_value(n) AS sources FROM z GROUP BY kb_id, doc_id, section
UNION ALL SELECT kb_id, doc_id, 1, 'document', string_agg(content, ' ' ORDER BY place), any_value(total) FROM z WHERE place <= 2 GROUP BY kb_id, doc_id"""


def _cluster_tree(s, d):
    """Documents stand for chunks of works of sixty, with the vectors that have their number."""
    docs = t(s, d, "documents").where("doc_id IS NOT NULL")
    e = t(s, d, "embeddings").select(F.floor(F.col("vec_id") / 60).cast("long").alias("doc_id"), F.col("vec_id").alias("ord"), "embedding")
    parts = docs.select(F.coalesce("source", F.lit("")).alias("kb_id"), F.floor(F.col("doc_id") / 60).cast("long").alias("doc_id"), F.col("lang").alias("section"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("content"))
    tree, _ = st.cluster_tree(parts, e)
    return tree.select("kb_id", "doc_id", "level", "node", F.md5(F.col("content").cast("binary")).alias("content_md5"), "sources")


def _levels(s, d):
    """Members of the communities of the supply graph, of those above them, and who belongs to whom."""
    li = t(s, d, "lineitem")
    edges = gr.merge_relations(li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 40 + 1000).alias("dst"), F.lit("r").alias("kind"), (F.col("l_quantity") / 4).alias("weight"), F.col("l_orderkey").alias("doc_id")))
    return gr.hierarchy(edges)


def _merged(s, d):
    o = t(s, d, "orders")
    rank = F.row_number().over(st.Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = o.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 50).alias("page"), rank.alias("rank"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"))
    return rk.merged_pages(hits, F.col("query_id") % 2 == 0, 3, 6).select("query_id", "page", "rrf", "position")


def _citations(s, d):
    o = t(s, d, "orders")
    hits = o.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 5).alias("doc_id"), (F.col("o_orderkey") % 11).alias("chunk_id"), (F.col("o_orderkey") % 23).alias("position"), F.col("o_totalprice").alias("score"))
    return rk.merged_citations(hits).withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ","))


def _window(s, d):
    parts = t(s, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text"))
    asked = t(s, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(lx.words("p_name")).alias("term"))
    return lx.candidate_window(lx.postings(parts, ["chunk_id"]), asked, 7, ["chunk_id"])


_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "的中文字典了和平安全是大小山水在天地人心与火木金土"


def _unspaced(s, d):
    """Terms of texts whose Latin letters became Han characters."""
    return lx.postings(t(s, d, "benchmark").select("item_id", F.translate(F.lower("text"), _LATIN, _HAN).alias("text")), ["item_id"]).drop("tf")


RUNS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"
UNSPACED_SQL = rf"""WITH b AS (SELECT item_id, unnest({RUNS.format(f"translate(lower(text), '{_LATIN}', '{_HAN}')")}) AS run FROM benchmark),
c AS (SELECT item_id, run, unnest(range(1, length(run) + 1)) AS i, regexp_matches(run, '[\x{{4e00}}-\x{{9fff}}]') AS han FROM b),
k AS (SELECT item_id, run[i:i] AS x, CASE WHEN i < length(run) THEN run[i + 1:i + 1] END AS y FROM c WHERE han),
u AS (SELECT item_id, x AS term FROM k WHERE x NOT IN ('的', '了', '是', '在', '与', '和') OR x = '和' UNION SELECT item_id, x || y FROM k WHERE y IS NOT NULL AND regexp_matches(x, '[\x{{4e00}}-\x{{9fff}}]') = regexp_matches(y, '[\x{{4e00}}-\x{{9fff}}]'))
SELECT DISTINCT item_id, term FROM (SELECT item_id, term FROM u UNION ALL SELECT item_id, run FROM b WHERE NOT regexp_matches(run, '[\x{{4e00}}-\x{{9fff}}]') AND length(run) BETWEEN 2 AND 128
 UNION ALL SELECT item_id, unnest(regexp_extract_all(run, '[a-z0-9]+')) FROM b) WHERE NOT (regexp_matches(term, '^[a-z0-9]+$') AND length(term) NOT BETWEEN 2 AND 64 AND term NOT IN (SELECT term FROM u))"""

CHUNKS_SQL = """o AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS ord, '| ' || o_orderkey || ' | **' || o_orderstatus || '** |' AS r, 'key: ' || o_orderkey || ' | state: ' || o_orderstatus AS m FROM orders)
SELECT doc_id, ord, CASE WHEN ord = 1 THEN 'Intro' || chr(10) || '| key | state |' || chr(10) || '|---|:-:|' || chr(10) || r WHEN ord % 3 = 0 THEN 'plain words' ELSE 'see' || chr(10) || '| key | state |' || chr(10) || '|---|:-:|' || chr(10) || r || chr(10) || 'end' END AS with_header,
 CASE WHEN ord > 1 AND ord % 3 = 0 THEN '' ELSE m END AS row_meanings FROM o"""

MERGED_SQL = """WITH h AS (SELECT o_custkey AS query_id, o_orderkey % 50 AS page, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS score FROM orders),
f AS (SELECT query_id, page, round(sum(1.0 / (60 + rank)), 6) AS rrf, max(score) AS score FROM h GROUP BY ALL),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, score DESC NULLS LAST, page) AS INTEGER) AS position FROM f)
SELECT query_id, page, rrf, position FROM p WHERE position <= CASE WHEN query_id % 2 = 0 THEN 6 ELSE 3 END"""

CITATIONS_SQL = """WITH h AS (SELECT o_custkey AS query_id, o_orderkey % 5 AS doc_id, o_orderkey % 11 AS chunk_id, min(o_orderkey % 23) AS position, max(o_totalprice) AS score FROM orders GROUP BY ALL)
SELECT query_id, doc_id, min(position) AS position, max(score) AS score, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY position, chunk_id) AS chunk_ids FROM h GROUP BY ALL"""

WINDOW_SQL = r"""WITH p AS (SELECT p_partkey AS chunk_id, unnest(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{2,}'))) AS term FROM part),
h AS (SELECT q.chunk_id AS query_id, p.chunk_id, count(*) AS matched FROM p q JOIN p USING (term) WHERE q.chunk_id % 20 = 0 GROUP BY ALL)
SELECT query_id, chunk_id, matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, chunk_id) AS n FROM h) WHERE n <= 7"""

TREE_SQL = """WITH o AS (SELECT c_mktsegment AS kb_id, o_custkey AS doc_id, o_orderpriority AS section, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
l AS (SELECT kb_id, 0 AS level, count(*) AS nodes, sum(n) AS sources FROM o GROUP BY 1 UNION ALL SELECT kb_id, 1, count(DISTINCT doc_id), sum(n) FROM o GROUP BY 1 UNION ALL SELECT kb_id, 2, 1, sum(n) FROM o GROUP BY 1)
SELECT kb_id, level, nodes, CAST(sources AS BIGINT) AS sources, nodes AS told FROM l"""

REBUILD_SQL = """WITH e AS (SELECT user_id % 50 AS kb_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY kb_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e)
SELECT kb_id, max(ts) + INTERVAL 6 HOUR AS due, count(*) AS changes FROM g GROUP BY kb_id, nth"""

ARCHIVE_SQL = """WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT doc_id, title, status, size FROM (
SELECT doc_id, 'a.md' AS title, 'ok' AS status, n AS size FROM d UNION ALL SELECT doc_id, 'b - c.txt', 'ok', 6 FROM d UNION ALL SELECT doc_id, 'd' || doc_id || '/.hidden.md', 'hidden', 1 FROM d
UNION ALL SELECT doc_id, 'd' || doc_id || '/x.exe', 'unsupported', 1 FROM d UNION ALL SELECT doc_id, 'd' || doc_id || '/../e.md', 'unsafe', 1 FROM d)"""

QA_SQL = """SELECT doc_id, md5('Say "' || source || '",' || chr(10) || 'which?') AS question_md5, md5('A: ' || replace(coalesce(text, ''), chr(13), ' ') || '.') AS answer_md5 FROM documents"""

JOINED_SQL = "SELECT doc_id, array_to_string([sha256(doc_id || '-' || k) FOR k IN range(0, 6)], ' ') AS text FROM documents"

PLANS = [
    Plan("src1_decoded", _decoded, "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents"),
    Plan("src8_qa_csv", _qa_csv, QA_SQL),
    Plan("src10_artifact", _artifact, "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS price, min(o_orderkey) AS least FROM orders GROUP BY 1"),
    Plan("src11_archives", _archives, ARCHIVE_SQL),
    Plan("src11_archive_source", _archive_source, ARCHIVE_SOURCE_SQL),
    Plan("src6_workbooks", _workbooks, WORKBOOK_SQL),
    Plan("snk2_batches", _batches, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"),
    Plan("ch7_numerals", _numerals, "SELECT o_orderkey, o_orderkey % 10000 AS value FROM orders"),
    Plan("ch8_table_headers", lambda s, d: st.carry_table_headers(_chunks(s, d)).select("doc_id", "ord", "with_header", F.array_join("row_meanings", "; ").alias("row_meanings")), f"WITH {CHUNKS_SQL}"),
    Plan("dd8_joined", _joined, JOINED_SQL),
    Plan("dd9_citations", _citations, CITATIONS_SQL),
    Plan("lx1_unspaced", _unspaced, UNSPACED_SQL),
    Plan("lx10_window", _window, WINDOW_SQL),
    Plan("rk34_merged_pages", _merged, MERGED_SQL),
    Plan("rp1_tree", _tree_counts, TREE_SQL),
    Plan("rp1_tree_texts", _tree_texts, TREE_TEXTS_SQL),
    Plan("rp1_cluster_tree", _cluster_tree),
    Plan("rp7_rebuilds", lambda s, d: jobs.rebuild_times(t(s, d, "events").select((F.col("user_id") % 50).alias("kb_id"), "ts"), "6 hours"), REBUILD_SQL),
    Plan("gr9_levels", _levels),
]
