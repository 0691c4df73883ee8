"""Readers and writers of raw files (SRC1-SRC3, SRC8-SRC12, SNK2)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cairnlake.session import bounded_batches

BLOCK_TAGS = frozenset("p div section article header footer main ul ol table tr br hr blockquote pre h1 h2 h3 h4 h5 h6 li dl dt dd form figure".split())
DROPPED = frozenset("script style head svg iframe template noscript".split())
#: SRC11: bounds of an archive: files, bytes of one and of all.
MAX_FILES, MAX_FILE, MAX_TOTAL = 500, 50 << 20, 100 << 20
TEXT_SUFFIXES = frozenset(".txt .md .markdown .html .htm .csv .json .jsonl .xlsx .xls .docx .pdf .pptx".split())


def decode_bytes(data: bytes | None) -> str:
    """SRC1: by byte order mark UTF-16, else strict UTF-8, GB 18030, GBK, and at last UTF-8 with replacement characters."""
    data = data or b""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for name in ("utf-8-sig", "gb18030", "gbk"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


#: What a heading, an item, a row and so on become, once all that stands inside is known.
CELL = "\ue000"
RULES: dict[str, Callable[[str], str]] = {
    **{f"h{n}": lambda inner, n=n: f"\n\n{'#' * n} {_one_line(inner)}\n\n" for n in range(1, 7)},
    **{tag: lambda inner: f"\n{inner}\n" for tag in BLOCK_TAGS if tag not in ("br", "hr", "li", "tr", "pre") and not tag[1:].isdigit()},
    **{tag: lambda inner: CELL + _one_line(inner) for tag in ("td", "th")},
    **{tag: lambda inner: "" for tag in DROPPED},
    "li": lambda inner: "\n- " + inner.strip() + "\n",
    "tr": lambda inner: "\n" + (" | ".join(c for c in inner.split(CELL)[1:]) if CELL in inner else inner) + "\n",
    "pre": lambda inner: "\n```\n" + inner.strip("\n") + "\n```\n",
}
#: Elements without an end, and what the start of an element ends if it is still open.
EMPTY = {"br": "\n", "hr": "\n", **dict.fromkeys("img input meta link source wbr col area base embed param track".split(), "")}
ENDED_BY = {"li": {"li"}, "p": {"p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "body": {"head", "title"}}


def _one_line(text: str) -> str:
    return " ".join(text.split())


class _Fold(HTMLParser):
    """Folds a page from the inside out: an element's parts are joined by its rule when it ends and go to the element around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = [("", [])]

    def fold(self) -> None:
        tag, parts = self.open.pop()
        inner = "".join(parts)
        self.open[-1][1].append(RULES[tag](inner) if tag in RULES else inner)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open[-1][0] in ENDED_BY.get(tag, ()):
            self.fold()
        if tag in EMPTY:
            self.open[-1][1].append(EMPTY[tag])
        else:
            self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open[-1][0] != tag:
                self.fold()
            self.fold()

    def handle_data(self, data: str) -> None:
        kept = any(t == "pre" for t, _ in self.open)
        self.open[-1][1].append(data.replace(CELL, "") if kept else re.sub(r"\s+", " ", data.replace(CELL, "")))

    def folded(self) -> str:
        while len(self.open) > 1:
            self.fold()
        return "".join(self.open[0][1])


def _stripped(html: str) -> str:
    """What is left of a page without its tags."""
    return unescape(re.sub(r"<[^>]*>", " ", re.sub(rf"(?is)<({'|'.join(sorted(DROPPED))})\b.*?(?:</\1\s*>|\Z)|<!--.*?-->", " ", html)))


def html_to_text(html: str | None) -> str:
    """SRC2: text of a page with heading marks, bullets, cell bars and fenced preformatted parts; hidden elements go, runs of
    blank lines become one. Where that leaves nothing of a page, its text without tags."""
    html = html or ""
    page = _Fold()
    try:
        page.feed(html)
        page.close()
        text = page.folded()
    except (AssertionError, ValueError, RecursionError):  # what the parser raises for broken declarations
        text = ""
    if not text.strip():
        text = _stripped(html)
    # Fenced parts stand at odd places and are kept as they are.
    parts = re.split(r"(?m)^```$", text.replace(CELL, ""))
    told = [re.sub(r"\n{3,}", "\n\n", "\n".join(map(_one_line, part.split("\n")))) if i % 2 == 0 else "```" + part.rstrip() + "\n```" for i, part in enumerate(parts)]
    return "".join(told).strip()


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(html_to_text)


@F.pandas_udf(StringType())
def decoded(files: pd.Series) -> pd.Series:
    return files.map(decode_bytes)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: (path, text) of raw files."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decoded("content").alias("text"))


def normalise_markdown(text: Column | str) -> Column:
    """SRC3: one kind of line end, no zero-width characters, plain spaces, a standalone title said once, no blank runs."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "[\u200b\u200c\u200d\ufeff]", "")
    t = F.regexp_replace(F.replace(t, F.lit("\u00a0"), F.lit(" ")), r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?m)^(#{1,6} [^\n]+)\n+\1$", "$1"), r"\n{3,}", "\n\n"))


QA_FIELDS = "id string, question string, answer string, aliases string, scope string, language string, effectiveFrom string, effectiveTo string, sourceDocumentId string, sourceVersionId string"


def read_qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: question records from CSV with quoted line breaks; an unclosed quote fails the read."""
    return spark.read.csv(path, schema=QA_FIELDS, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)


def validate_qa(rows: DataFrame) -> DataFrame:
    """SRC9: adds errors (an array, empty if the record is good), the list of aliases, and an id that content alone decides."""
    q, a = F.trim(F.coalesce("question", F.lit(""))), F.trim(F.coalesce("answer", F.lit("")))
    start, end = F.col("effectiveFrom").try_cast("timestamp"), F.col("effectiveTo").try_cast("timestamp")
    checks = [
        (F.length(q) == 0, "question missing"),
        (F.length(q) > 2000, "question too long"),
        (F.length(a) == 0, "answer missing"),
        (F.length(a) > 20000, "answer too long"),
        (F.col("effectiveFrom").isNotNull() & start.isNull(), "bad start"),
        (F.col("effectiveTo").isNotNull() & end.isNull(), "bad end"),
        (start.isNotNull() & end.isNotNull() & (end <= start), "dates out of order"),
        (F.col("sourceVersionId").isNotNull() & F.col("sourceDocumentId").isNull(), "version without document"),
    ]
    aliases = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"[|;]"), lambda x: F.trim(x)), lambda x: x != ""))
    made = F.sha2(F.concat_ws("\n", q, a, F.coalesce("scope", F.lit(""))).cast("binary"), 256)
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))).withColumn("alias_list", aliases).withColumn("record_id", F.coalesce("id", F.substring(made, 1, 32)))


def read_table_artifact(spark: SparkSession, path: str, schema: str, sha256: str | None = None, most_bytes: int = 200 << 20) -> DataFrame:
    """SRC10: rows of JSONL artifacts, a file each, if the size of each is within the budget and its digest is the expected one.
    Sizes come from the listing; contents are read for a digest only if one is asked for, and then a single file must have it."""
    files = spark.read.format("binaryFile").load(path)
    if (files.agg(F.max("length").alias("n")).first().n or 0) > most_bytes:
        raise ValueError("artifact over budget")
    if sha256:
        facts = files.agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2("content", 256)).alias("digest")).first()
        if (facts.n, facts.digest) != (1, sha256):
            raise ValueError("artifact changed")
    return spark.read.json(path, schema=schema, mode="FAILFAST")


class TooManyFiles(ValueError):
    pass


def archive_plan(z: zipfile.ZipFile) -> list[tuple[zipfile.ZipInfo, str, str]]:
    """SRC11: (member, title, status) of a zip's files, from its directory alone; more than MAX_FILES of them are an error."""
    out, total, titles = [], 0, set()
    infos = [i for i in z.infolist() if not i.is_dir()]
    if len(infos) > MAX_FILES:
        raise TooManyFiles(f"{len(infos)} files")
    names = [i.filename.replace("\\", "/") for i in infos]
    root = names[0].split("/")[0] + "/" if names and all("/" in n and n.split("/")[0] == names[0].split("/")[0] for n in names) else ""
    for info, name in zip(infos, names, strict=True):
        parts, short = name.split("/"), name[len(root) :]
        if ".." in parts or name.startswith("/") or ":" in parts[0]:
            out.append((info, name, "unsafe"))
        elif any(p.startswith(".") or p == "__MACOSX" for p in parts):
            out.append((info, name, "hidden"))
        elif posixpath.splitext(name)[1].lower() not in TEXT_SUFFIXES:
            out.append((info, name, "unsupported"))
        elif info.file_size > MAX_FILE or total + info.file_size > MAX_TOTAL:
            out.append((info, name, "too_large"))
        else:
            stem, suffix = posixpath.splitext(short.replace("/", " - "))
            title, n = stem + suffix, 1
            while title in titles:
                n, title = n + 1, f"{stem} ({n + 1}){suffix}"
            titles.add(title)
            total += info.file_size
            out.append((info, title, "ok"))
    return out


def archive_entries(data: bytes) -> list[tuple[str, str, int, bytes | None]]:
    """SRC11: (title, status, size, content) of a zip's files: unsafe, hidden, unsupported and over-large ones are told, not read."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(title, status, info.file_size, z.read(info) if status == "ok" else None) for info, title, status in archive_plan(z)]


def expand_archives(files: DataFrame) -> DataFrame:
    """SRC11: a row for each file of each archive (path, content)."""
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = archive_entries(data)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True))], names=["path", "title", "status", "size", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, title string, status string, size long, content binary")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """SRC12: changes between two trees (path, blob): A, M or D; the same tree gives none, an empty one before gives all as A."""
    both = before.select("path", F.col("blob").alias("old")).join(after.select("path", F.col("blob").alias("new")), "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M")
    return both.select("path", kind.alias("status")).where("status is not null")


def write_batches(rows: DataFrame, path: str, source_hash: str, per_file: int = 1000) -> str:
    """SNK2: rows in files of at most ``per_file``, in a folder named by the source's hash: writing the same source again replaces it."""
    out = f"{path.rstrip('/')}/source={source_hash}"
    rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).json(out)
    return out
