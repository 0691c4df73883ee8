"""Listings, pages, telemetry and fingerprints over plain tables (SRC16-SRC20, AG1-AG17, SL, ST, WN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_scan(chunks: DataFrame, order: list[str], cap: int) -> DataFrame:
    """SRC16: all rows in order, or an error: a scan over its cap gives nothing rather than a part."""
    n = chunks.limit(cap + 1).count()
    if n > cap:
        raise ValueError(f"over {cap} rows")
    return chunks.orderBy(*order)


def keyset_page(rows: DataFrame, at: str, key: str, anchor: tuple | None, size: int) -> DataFrame:
    """SRC17: the ``size`` newest rows before an anchor (time, key) and one more, with has_more on every row."""
    if anchor is not None:
        rows = rows.where((F.col(at) < F.lit(anchor[0])) | ((F.col(at) == F.lit(anchor[0])) & (F.col(key) < F.lit(anchor[1]))))
    page = rows.orderBy(F.desc(at), F.desc(key)).limit(size + 1)
    nth = F.row_number().over(Window.orderBy(F.desc(at), F.desc(key)))  # over size + 1 rows at most
    return page.withColumn("nth", nth).withColumn("has_more", F.max("nth").over(Window.partitionBy()) > size).where(F.col("nth") <= size)


def offset_page(rows: DataFrame, order: list[Column | str], offset: int, size: int) -> DataFrame:
    """SRC18, SL3: a page by offset, with the total on every row."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(size).crossJoin(total)


def listing(rows: DataFrame, statuses: list[str], allowed: list[str], text: str | None, columns: list[str], pinned: list | None = None, key: str = "id") -> DataFrame:
    """SRC19: rows of known statuses whose title or path holds a text, whatever its case; at most 50 pinned keys always stay."""
    if not set(statuses) <= set(allowed) or len(pinned or []) > 50:
        raise ValueError("unknown status or too many pinned rows")
    keep = F.col("status").isin(statuses) if statuses else F.lit(True)
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(c), F.lit(text.lower()))
        keep = keep & hit
    return rows.where(keep | F.col(key).isin(pinned or []))


def timeline(parts: dict[str, DataFrame]) -> DataFrame:
    """SRC20, ST1: one table of (id, at, action, actor, source) from several, newest first."""
    out = None
    for source, rows in sorted(parts.items()):
        rows = rows.select(F.concat_ws(":", F.lit(source), "id").alias("id"), "at", "action", "actor").withColumn("source", F.lit(source))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("at"), "id")


def filtered_counts(rows: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """AG2, AG11, AG12: rows and rows of each status, and the rate of the first one in per cent to one digit."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values))
    return out.withColumn("rate", F.round(F.col(f"n_{values[0]}") * 1000 / F.col("total")) / 10)


def document_health(docs: DataFrame, chunks: DataFrame, kb: str) -> DataFrame:
    """AG11, Q6: documents of a scope counted before their chunks are joined, so that chunks never multiply them."""
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("chars"))
    joined = docs.join(per_doc, "doc_id", "left")
    return joined.groupBy(kb).agg(F.count(F.lit(1)).alias("documents"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("chars") / F.sum("chunks"), F.lit(0.0)).alias("mean_length"))


def inventory_fingerprint(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """AG13: sha256 of a group's sorted entries ("a:b:..."), joined by semicolons."""
    entry = F.concat_ws(":", *(F.col(p).cast("string") for p in parts))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ";").cast("binary"), 256).alias("fingerprint"))


def faceted(rows: DataFrame, status: str) -> DataFrame:
    """AG15: rows of each status with those of all; ``processing`` sums parsing and indexing."""
    facet = F.when(F.col(status).isin("parsing", "indexing"), "processing").otherwise(F.col(status))
    counts = rows.groupBy(facet.alias("facet")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(counts.agg(F.lit("total").alias("facet"), F.sum("n").alias("n")))


def holding_any(rows: DataFrame, key: str, json: str, private: DataFrame) -> DataFrame:
    """AG16: rows whose JSON array of ids holds any of the private ones."""
    ids = rows.select(key, F.explode(F.from_json(json, "array<bigint>")).alias("id"))
    return ids.join(private, "id", "left_semi").select(key).distinct()


def column_statistics(tables: dict[str, DataFrame], predicates: dict[str, Column]) -> DataFrame:
    """AG17: (name, n) of rows of each table and of those that pass its predicate."""
    out = None
    for name, rows in sorted(tables.items()):
        part = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(predicates.get(name, F.lit(True))).alias("matching")).select(F.lit(name).alias("name"), "n", "matching")
        out = part if out is None else out.unionByName(part)
    return out


def neighbours(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """WN5: each row with the row before and after it."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """WN7: the last value that is not null at or before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """AG4: one row of each key, the first by order, through a partial aggregate instead of a sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_r"))
    return best.select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def merge_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK1: the table after an upsert: new rows replace old ones of their key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
