"""Exact aggregation over table cells (TB1-TB10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Fixed value: a number with thousands separators, then a unit without digits.
NUMBER = r"^\s*([+-]?)([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|\.[0-9]+)\s*([^0-9\s.,+-]*)\s*$"
MAX_FRACTION, MAX_WHOLE = 18, 30


def number_of(cell: Column | str) -> Column:
    """TB5: struct(ok, text, unit): the digits of a cell without separators, signed."""
    sign, digits, unit = (F.regexp_extract(cell, NUMBER, i) for i in (1, 2, 3))
    plain = F.replace(digits, F.lit(","), F.lit(""))
    whole, fraction = F.substring_index(plain, ".", 1), F.when(F.contains(plain, F.lit(".")), F.substring_index(plain, ".", -1)).otherwise("")
    ok = F.coalesce(F.regexp_like(cell, F.lit(NUMBER)), F.lit(False)) & (F.length(fraction) <= MAX_FRACTION) & (F.length(whole) <= MAX_WHOLE)
    return F.struct(ok.alias("ok"), F.when(ok, F.concat(F.when(sign == "-", "-").otherwise(""), plain)).alias("text"), F.when(ok, unit).alias("unit"))


def exact_aggregate(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """TB4: for each table count, sum, min, max, and the mean as numerator and denominator, all exact, and the unit.

    Any cell that is no number, or several units, makes the group an error instead of a wrong figure. Sums hold 20 digits
    before and 18 after the point; wider tables go through ``exact_sum_wide``."""
    n = number_of(cell)
    value = F.col("_n.text").cast("decimal(38,18)")
    out = cells.withColumn("_n", n).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(value).cast("decimal(38,18)").alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count_if(~F.col("_n.ok")).alias("bad"),
        F.countDistinct("_n.unit").alias("units"),
        F.min("_n.unit").alias("unit"),
    )
    error = F.when(F.col("bad") > 0, "non-numeric cell").when(F.col("units") > 1, "mixed units")
    ok = error.isNull()
    return out.select(*keys, "count", *(F.when(ok, F.col(c)).alias(c) for c in ("sum", "min", "max")), F.when(ok, F.struct(F.col("sum").alias("numerator"), F.col("count").alias("denominator"))).alias("avg"), F.when(ok, F.col("unit")).alias("unit"), error.alias("error"))


def exact_sum_wide(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """TB4, H1: exact sums of up to 30 digits before the point, as text: each task sums its rows, then sums are summed."""
    import decimal

    def add(batches: Iterator[pa.RecordBatch], rows_in: str) -> Iterator[pa.RecordBatch]:
        context = decimal.Context(prec=80)
        total: dict[tuple, Decimal] = {}
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for *key, text in zip(*cols, strict=True):
                if text is not None:
                    total[tuple(key)] = context.add(total.get(tuple(key), Decimal(0)), Decimal(text))
        if total:
            fields = list(zip(*total, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(list(f)) for f in fields), pa.array([format(v, "f") for v in total.values()])], names=[*keys, rows_in])

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    texts = cells.select(*keys, number_of(cell)["text"].alias("text"))
    partial = texts.mapInArrow(lambda b: add(b, "text"), f"{kinds}, text string")
    return partial.repartition(*keys).mapInArrow(lambda b: add(b, "sum"), f"{kinds}, sum string")


#: TB6, TB7: operators of typed filters.
OPERATORS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "contains": "contains"}


def typed_filter(column: Column, kind: Column, op: str, operand: str, wanted: str) -> Column:
    """A filter that only cells of the wanted kind pass; numbers compare exactly, text by equality or part."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    if wanted == "number":
        a, b = column.try_cast("decimal(38,18)"), F.lit(operand).cast("decimal(38,18)")
        test = {"eq": a == b, "ne": a != b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]
    else:
        test = F.contains(column, F.lit(operand)) if op == "contains" else (column == operand if op == "eq" else column != operand)
    return (kind == wanted) & F.coalesce(test, F.lit(False))


def structured_aggregate(rows: DataFrame, keys: list[str], value: str, filters: list[Column], row_count: str) -> DataFrame:
    """TB6: exact figures over fact rows of typed tables: headers, summary rows and inherited cells are no facts; a table
    of which fewer rows were read than it declares is an error. At most 20 filters."""
    if len(filters) > 20:
        raise ValueError("too many filters")
    keep = ~F.col("is_header") & ~F.col("is_summary") & ~F.col("inherited")
    for f in filters:
        keep = keep & f
    v = F.when(keep, F.col(value).try_cast("decimal(38,18)"))
    out = rows.groupBy(*keys).agg(F.count_if(keep).alias("count"), F.sum(v).cast("decimal(38,18)").alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(F.lit(1)).alias("rows_read"), F.max(row_count).alias("declared"))
    return out.withColumn("complete", F.col("rows_read") == F.col("declared"))


def count_rows(rows: DataFrame, keys: list[str], filters: list[Column], question: str, thresholds: list[str]) -> DataFrame:
    """TB7: rows that pass at most 8 filters; every threshold must stand in the question word for word."""
    if len(filters) > 8 or any(x not in question for x in thresholds):
        raise ValueError("a filter is not part of the question")
    keep = F.lit(True)
    for f in filters:
        keep = keep & f
    return rows.groupBy(*keys).agg(F.count_if(keep).alias("matches"), F.count(F.lit(1)).alias("rows"))


def profile(cells: DataFrame, keys: list[str], value: str, most: int = 100) -> DataFrame:
    """TB8: number of distinct values of each column, and the first ``most`` of them (a report's limit, with a flag)."""
    distinct = cells.select(*keys, F.col(value).cast("string").alias("v")).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("v"))
    kept = distinct.withColumn("n", nth)
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_values"), F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.col("v")))).alias("values")).withColumn("sampled", F.col("distinct_values") > most)


def unit_of_format(fmt: Column | str) -> Column:
    """TB10: unit of a number format: percent, a currency sign or code, a quoted word; none else."""
    f = F.col(fmt) if isinstance(fmt, str) else fmt
    quoted, sign = F.regexp_extract(f, r'"\s*([^"\s]+)\s*"', 1), F.regexp_extract(f, r"([$€£¥]|USD|EUR|GBP|CNY)", 1)
    return F.when(F.contains(f, F.lit("%")), "%").when(sign != "", sign).when(quoted != "", quoted).otherwise("")


def split_row(line: str) -> list[str]:
    """TB1: cells of a Markdown row; escaped pipes and pipes in code spans belong to the cell."""
    s, out, cell, ticks, i = line.strip(), [], "", 0, 0
    s = s[1:] if s.startswith("|") else s
    s = s[:-1] if s.endswith("|") and not s.endswith("\\|") else s
    while i < len(s):
        if s[i] == "`":
            run = len(re.match("`+", s[i:]).group())
            ticks = 0 if ticks == run else run if not ticks and s.find("`" * run, i + run) >= 0 else ticks
            cell, i = cell + s[i : i + run], i + run
            continue
        if s[i] == "\\" and s[i + 1 : i + 2] == "|":
            cell, i = cell + "|", i + 2
            continue
        if s[i] == "|" and not ticks:
            out, cell, i = [*out, cell.strip()], "", i + 1
            continue
        cell, i = cell + s[i], i + 1
    return [*out, cell.strip()]


def markdown_tables(text: str) -> Iterator[tuple[int, int, int, str, str, int, int]]:
    """TB2, TB3: (table, row, column, header, value, start, end) of pipe tables outside fences; a table ends at the first row
    with another number of cells. Offsets are those of the row's line."""
    at, fence, lines = 0, "", []
    for line in (text or "").split("\n"):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark and (not fence or line.strip().startswith(fence)):
            fence = "" if fence else mark.group(1)
            lines.append((None, at))
        else:
            lines.append((None if fence else line, at))
        at += len(line) + 1
    table, i = 0, 0
    while i + 1 < len(lines):
        head, rule = lines[i][0], lines[i + 1][0]
        if head and rule and "|" in head and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", rule) and len(split_row(head)) == len(split_row(rule)):
            names, k = split_row(head), i + 2
            while k < len(lines) and lines[k][0] and "|" in lines[k][0] and len(cells := split_row(lines[k][0])) == len(names):
                for c, value in enumerate(cells):
                    yield table, k - i - 2, c, names[c], value, lines[k][1], lines[k][1] + len(lines[k][0])
                k += 1
            table, i = table + 1, k
        else:
            i += 1


def extract_tables(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """TB2: a row for each cell of each Markdown table of each document."""
    names = ["table", "row", "column", "header", "value", "char_start", "char_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *cell) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for cell in markdown_tables(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, table long, row long, column long, header string, value string, char_start long, char_end long")


#: TB9: fixed values: characters of a common part, its share of a title, lengths of titles that are matched.
COMMON, COMMON_SHARE, TITLE_MOST = 4, 0.6, 160
#: Lengths of grams by which titles are proposed.
GRAMS = (4, 6, 8, 12, 16, 24, 32, 48, 64)


class SuffixAutomaton:
    """All substrings of a text: states with their longest length, links to their longest suffix of another kind, and steps by character."""

    def __init__(self, text: str) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for c in text:
            new = self._state(self.length[last] + 1, {}, 0)
            at = last
            while at >= 0 and c not in self.steps[at]:
                self.steps[at][c] = new
                at = self.link[at]
            if at >= 0:
                to = self.steps[at][c]
                if self.length[to] != self.length[at] + 1:
                    # Shorter ends of the old state part from it.
                    part = self._state(self.length[at] + 1, dict(self.steps[to]), self.link[to])
                    while at >= 0 and self.steps[at].get(c) == to:
                        self.steps[at][c] = part
                        at = self.link[at]
                    self.link[to] = to = part
                self.link[new] = to
            last = new

    def _state(self, length: int, steps: dict[str, int], link: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def longest(self, other: str) -> int:
        """Length of the longest part that another text shares: one step for each of its characters, but for falling back."""
        state = n = best = 0
        for c in other:
            while state and c not in self.steps[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.steps[state]:
                state, n = self.steps[state][c], n + 1
                best = max(best, n)
        return best


def title_match(name: str, question: str | SuffixAutomaton) -> int:
    """TB9: length of the longest common part of a title and a question, if it is four and more characters and 60 % of the title."""
    best = (question if isinstance(question, SuffixAutomaton) else SuffixAutomaton(question)).longest(name)
    return best if best >= COMMON and best >= COMMON_SHARE * len(name) else 0


@F.pandas_udf(IntegerType())
def title_matches(names: pd.Series, questions: pd.Series) -> pd.Series:
    """TB9 over columns; null where either is."""
    return pd.Series([None if a is None or b is None else title_match(a, b) for a, b in zip(names, questions, strict=True)], dtype="Int32")


#: Distinct names that a task of ``matched_titles`` holds, tasks that it makes at least, and rows that it gives at once.
BLOCK_NAMES, LEAST_TILES, OUT_ROWS = 262_144, 64, 65_536


def _title_grams(name: str) -> list[str]:
    """Grams of a name of which every common part of the asked length holds one: as many as stand that far apart, of the longest of
    ``GRAMS`` that fits into such a part."""
    least = max(COMMON, int(COMMON_SHARE * len(name)))
    size = max(g for g in GRAMS if g <= least)
    step = least - size + 1
    return [name[p - 1 : p - 1 + size] for p in range(step, len(name) - size + 2, step)]


def matched_titles(titles: DataFrame, questions: DataFrame) -> DataFrame:
    """TB9: (query_id, title_id, common) of titles (title_id, name) that questions (query_id, text) name: case and a suffix after a dot do not
    count, names of 4 to 160 characters do.

    Blocks of names meet parts of questions in tiles: a task holds the grams of a block's names, of which a common part of 60 % of a name
    holds one, and reads the questions of its part, equal ones one after another. Names that a question's grams find are told by its
    suffix automaton. Pairs of a name and a question leave the task as rows of the result: nothing shuffles, sorts or broadcasts them."""
    stem = F.lower(F.regexp_replace("name", r"(?i)\.[a-z0-9]+$", ""))
    borne = titles.select(F.col("title_id").alias("bearer"), stem.alias("text")).where(F.length("text").between(COMMON, TITLE_MOST)).distinct()
    told = questions.where("query_id IS NOT NULL").select(F.col("query_id").alias("asker"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    blocks = 1 + borne.select("text").distinct().count() // BLOCK_NAMES
    parts = -(-LEAST_TILES // blocks)
    hashed = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    none = lambda x, k: F.lit(None).cast(x.schema[k].dataType).alias(k)
    each = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    names = borne.select(F.explode(F.transform(each(parts), lambda i: hashed(blocks) * parts + i)).alias("tile"), "bearer", none(told, "asker"), "text", F.lit(0).alias("kind"))
    asked = told.select(F.explode(F.transform(each(blocks), lambda i: i * parts + hashed(parts))).alias("tile"), none(borne, "bearer"), "asker", "text", F.lit(1).alias("kind"))
    tiles = names.unionByName(asked).repartitionById(blocks * parts, "tile").sortWithinPartitions("tile", "kind", "text")
    ids = {k: x.schema[k].dataType.simpleString() for k, x in (("asker", told), ("bearer", borne))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, names, ids, index, sizes = None, [], [], {}, ()
        last, found = None, []
        out, fields = ([], [], []), None

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, fields, strict=True)], names=["asker", "bearer", "common"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            fields = (batch.schema.field("asker").type, batch.schema.field("bearer").type, pa.int32())
            for at, title, query, text, kind in zip(*(batch.column(c).to_pylist() for c in ("tile", "bearer", "asker", "text", "kind")), strict=True):
                if at != tile:
                    tile, names, ids, index, last = at, [], [], {}, None
                if not kind:
                    if not names or names[-1] != text:
                        names.append(text)
                        ids.append([])
                        for gram in dict.fromkeys(_title_grams(text)):
                            index.setdefault(gram, []).append(len(names) - 1)
                    ids[-1].append(title)
                    continue
                if text != last:
                    sizes = sizes if last is not None else sorted({len(g) for g in index})
                    near = set().union(*(index.get(text[i : i + g], ()) for g in sizes for i in range(len(text) - g + 1)))
                    automaton, last = SuffixAutomaton(text) if near else None, text
                    found = [(n, common) for n in sorted(near) if (common := title_match(names[n], automaton))]
                for n, common in found:
                    for one in range(0, len(ids[n]), OUT_ROWS):
                        some = ids[n][one : one + OUT_ROWS]
                        for x, more in zip(out, ([query] * len(some), some, [common] * len(some)), strict=True):
                            x.extend(more)
                        if len(out[0]) >= OUT_ROWS:
                            yield given()
        if out[0]:
            yield given()

    found = tiles.mapInArrow(run, f"asker {ids['asker']}, bearer {ids['bearer']}, common int")
    return found.select(F.col("asker").alias("query_id"), F.col("bearer").alias("title_id"), "common")
