"""Data sources: archives (SRC11) and webhook queues (SRC13)."""

import io
import os
import time
import zipfile

import pytest

from cairnlake.sources.archives import ArchiveSource
from cairnlake.sources.webhooks import QueueFull, WebhookQueue, WebhookSource


def archive(path, members, **kw):
    with zipfile.ZipFile(path, "w", **kw) as z:
        for name, body in members:
            z.writestr(name, body)


def test_archives_good_and_bad(spark, tmp_path):
    os.makedirs(tmp_path / "sub")
    archive(tmp_path / "a.zip", [("r/a.md", "one"), ("r/b/c.txt", "two"), ("r/.h.md", "x"), ("r/x.exe", "x"), ("r/../e.md", "x")])
    archive(tmp_path / "sub" / "many.zip", [(f"{i}.txt", "x") for i in range(501)])
    archive(tmp_path / "empty.ZIP", [])
    (tmp_path / "broken.zip").write_bytes(b"PK no zip")
    (tmp_path / "other.txt").write_bytes(b"x")
    data = io.BytesIO()
    archive(data, [("good.txt", "fine"), ("bad.txt", "spoiled")])
    (tmp_path / "half.zip").write_bytes(data.getvalue().replace(b"spoiled", b"SPOILED"))
    spark.dataSource.register(ArchiveSource)
    got = spark.read.format("archives").load(str(tmp_path)).collect()
    assert sorted((r.archive, r.title, r.status, r.content and bytes(r.content)) for r in got if r.status in ("ok",)) == [("a.zip", "a.md", "ok", b"one"), ("a.zip", "b - c.txt", "ok", b"two"), ("half.zip", "good.txt", "ok", b"fine")]
    assert sorted((r.archive, r.status) for r in got if r.status != "ok") == [("a.zip", "hidden"), ("a.zip", "unsafe"), ("a.zip", "unsupported"), ("broken.zip", "broken"), ("half.zip", "broken"), ("many.zip", "too_many_files")]
    many = spark.read.format("archives").option("stretch", "100").load(str(tmp_path))
    assert many.rdd.getNumPartitions() > 10 and sorted(map(repr, many.collect())) == sorted(map(repr, got))
    os.makedirs(tmp_path / "none")
    assert spark.read.format("archives").load(str(tmp_path / "none")).collect() == []


def item(n):
    return {"externalId": str(n), "title": f"t{n}", "content": f"c\n{n}"}


def run(spark, at, until, fetch=4):
    stream = spark.readStream.format("webhooks").option("path", f"{at}/queue").option("source", "crm").option("fetch", fetch).load()
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(processingTime="0 seconds").start()
    stop = time.time() + 60
    queue = WebhookQueue(f"{at}/queue")
    while queue.committed("crm") < until and time.time() < stop and q.isActive:
        time.sleep(0.1)
    q.processAllAvailable()
    q.stop()


def test_a_restarted_stream_loses_and_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(WebhookSource)
    queue = WebhookQueue(f"{tmp_path}/queue")
    assert queue.append("crm", [item(n) for n in range(1, 8)]) == 7 and queue.append("other", [item(99)]) == 1
    run(spark, tmp_path, 4)
    queue.append("crm", [item(n) for n in range(8, 12)])
    run(spark, tmp_path, 8)
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("sequence").collect()
    assert [(r.sequence, r.external_id, r.content) for r in rows] == [(n, str(n), f"c\n{n}") for n in range(1, 12)]
    assert queue.last("other") == 1 and queue.committed("other") == 0


def test_a_full_queue_takes_nothing_and_commits_make_room(tmp_path):
    queue = WebhookQueue(f"{tmp_path}/queue", capacity=5)
    queue.append("s", [item(n) for n in range(4)])
    with pytest.raises(QueueFull):
        queue.append("s", [item(8), item(9)])
    assert queue.last("s") == 4 and queue.size("s") == 4
    queue.commit("s", 3)
    assert queue.append("s", [item(8), item(9)]) == 6 and [i["sequence"] for i in queue.read("s", 3, 5)] == [4, 5]
    for bad in ({"externalId": " ", "title": "t", "content": ""}, {"externalId": "1", "title": "t", "content": None}, {"externalId": "1", "title": "", "content": "c"}, item(1) | {"externalAcl": {"subjects": []}}):
        with pytest.raises(ValueError):
            queue.append("s", [bad])
    assert queue.append("s", []) == 6


def test_regions_of_a_workbook(spark, tmp_path):
    from cairnlake.plans.documents import workbook
    from cairnlake.sources.workbooks import WorkbookSource, regions

    # Two blocks side by side, a band beneath without headers, a merged title, a formula without a stored value, a second sheet.
    one = {"B2": "Name", "C2": "Price (EUR)", "B3": "x", "C3": 1.5, "B4": "y", "C4": 2, "C5": ("SUM(C3:C4)", 3.5), "F2": "Year", "F3": 2024, "F4": ("A1+1", None),
           "B8": 1, "C8": (0.25, 10), "B9": 2, "C9": ("AVERAGE(B8:B9)", 1.5), "AB8": "far"}
    two = {"A1": "Title", "A2": "left", "B2": "right", "A3": "a", "B3": "b"}
    (tmp_path / "w.xlsx").write_bytes(workbook({"One": (one, []), "T<wo": (two, ["A1:B1"])}))
    (tmp_path / "bad.xlsx").write_bytes(b"PK nothing")
    spark.dataSource.register(WorkbookSource)
    cells = spark.read.format("workbooks").load(str(tmp_path))
    assert [(r.workbook, r.status) for r in cells.where("status <> 'ok'").collect()] == [("bad.xlsx", "broken")]
    got = {(r.sheet, r.row, r.col): r for r in regions(cells).collect()}
    at = lambda s, r, c: got[s, r, c]
    assert [(at("One", 3, c).header, at("One", 3, c).band, at("One", 3, c).block) for c in (2, 3, 6)] == [("Name", 0, 0), ("Price (EUR)", 0, 0), ("F", 0, 1)]
    assert at("One", 2, 2).is_header and not at("One", 3, 2).is_header
    # A block of one text is no header: two texts, or a merged one, are.
    assert not at("One", 2, 6).is_header
    assert (at("One", 3, 3).unit, at("One", 3, 3).number, at("One", 5, 3).is_summary, at("One", 4, 3).is_summary) == ("EUR", 1.5, True, False)
    assert at("One", 4, 6).kind == "formula" and at("One", 4, 6).text is None
    assert [(at("One", 8, c).header, at("One", 8, c).is_header) for c in (2, 3, 28)] == [("B", False), ("C", False), ("AB", False)] and at("One", 8, 3).unit == "%"
    assert not at("One", 9, 3).is_summary  # it takes in its own row and another column
    assert [at("T<wo", 3, c).header for c in (1, 2)] == ["Title / left", "Title / right"] and [at("T<wo", r, 1).is_header for r in (1, 2, 3)] == [True, True, False]


def test_names_of_columns(spark):
    from pyspark.sql import functions as F

    from cairnlake.sources.workbooks import letters, place

    for n, name in ((1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")):
        assert spark.range(1).select(letters(F.lit(n))).first()[0] == name and place(f"{name}7") == (7, n)
