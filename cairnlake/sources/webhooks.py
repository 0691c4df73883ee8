"""SRC13 as a streaming data source: a queue of webhook payloads with sequence numbers and a bounded backlog.

    queue = WebhookQueue(folder)
    queue.append("crm", [{"externalId": "7", "title": "t", "content": "c"}])
    spark.dataSource.register(WebhookSource)
    spark.readStream.format("webhooks").option("path", folder).option("source", "crm").load()

Payloads are files of JSON lines named by their sequence numbers, so a stretch of numbers is read the same way each time. The stream's offset is
the last number read. What a batch has committed makes room in the queue; a batch that was not committed comes again: at least once,
and a restarted stream goes on after its last offset."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Payloads that may wait, and that one fetch takes; subjects of an access list.
CAPACITY, FETCH, SUBJECTS = 1000, 1000, 1000
SCHEMA = "sequence long, external_id string, title string, content string, external_revision string, deleted boolean"
COMMITTED = "committed"


class QueueFull(RuntimeError):
    pass


def _valid(item: dict) -> dict:
    """A payload as it is queued; without an id, a title or a content of text it is an error."""
    external_id, title = (str(item.get(k) or "").strip() for k in ("externalId", "title"))
    if not external_id or not title or not isinstance(item.get("content"), str):
        raise ValueError("a payload needs externalId, title and a content of text")
    acl = item.get("externalAcl")
    if acl is not None and (not acl.get("revision") or len(acl.get("subjects") or []) > SUBJECTS or any(not s.get("id") or not s.get("type") for s in acl.get("subjects") or [])):
        raise ValueError("invalid access list")
    return {"externalId": external_id, "title": title, "content": item["content"], "externalRevision": item.get("externalRevision"), "deleted": bool(item.get("deleted"))}


class WebhookQueue:
    """The queue of each source under a folder that driver and executors share. One writer appends to a source at a time."""

    def __init__(self, folder: str, capacity: int = CAPACITY) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.capacity = capacity

    def _files(self, source: str) -> list[tuple[int, int, str]]:
        """(first, last, path) of each file, in order."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{source}", allow_not_found=True))
        names = [(f.base_name, f.path) for f in found if f.is_file and f.base_name.endswith(".jsonl")]
        return sorted((*map(int, n[: -len(".jsonl")].split("-")), path) for n, path in names)

    def last(self, source: str) -> int:
        files = self._files(source)
        return files[-1][1] if files else 0

    def committed(self, source: str) -> int:
        path = f"{self.root}/{source}/{COMMITTED}"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            return 0
        with self.fs.open_input_stream(path) as f:
            return int(f.read())

    def size(self, source: str) -> int:
        return self.last(source) - self.committed(source)

    def append(self, source: str, items: list[dict]) -> int:
        """Queues payloads, all or none; returns the last number. A full queue is an error."""
        if not source.strip():
            raise ValueError("a source needs a key")
        valid, last = [_valid(i) for i in items], self.last(source)
        if not valid:
            return last
        if self.size(source) + len(valid) > self.capacity:
            raise QueueFull(f"{source}: {self.size(source)} of {self.capacity} payloads wait")
        self.fs.create_dir(f"{self.root}/{source}", recursive=True)
        path = f"{self.root}/{source}/{last + 1:018d}-{last + len(valid):018d}"
        with self.fs.open_output_stream(f"{path}.part") as f:
            f.write("".join(json.dumps({"sequence": last + 1 + n} | v) + "\n" for n, v in enumerate(valid)).encode())
        self.fs.move(f"{path}.part", f"{path}.jsonl")  # a file is there whole or not at all
        return last + len(valid)

    def read(self, source: str, after: int, upto: int) -> Iterator[dict]:
        for first, last, path in self._files(source):
            if last > after and first <= upto:
                with self.fs.open_input_stream(path) as f:
                    for line in f.read().splitlines():
                        item = json.loads(line)
                        if after < item["sequence"] <= upto:
                            yield item

    def commit(self, source: str, upto: int) -> None:
        with self.fs.open_output_stream(f"{self.root}/{source}/{COMMITTED}.part") as f:
            f.write(str(upto).encode())
        self.fs.move(f"{self.root}/{source}/{COMMITTED}.part", f"{self.root}/{source}/{COMMITTED}")
        for _, last, path in self._files(source):
            if last <= upto - 2 * self.capacity:  # long past: no batch can come again from here
                self.fs.delete_file(path)


@dataclass
class Span(InputPartition):
    after: int
    upto: int


class WebhookReader(DataSourceStreamReader):
    def __init__(self, folder: str, source: str, fetch: int) -> None:
        self.folder, self.source, self.fetch = folder, source, fetch
        self.known: int | None = None

    def initialOffset(self) -> dict:
        return {"sequence": 0}

    def latestOffset(self) -> dict:
        queue = WebhookQueue(self.folder)
        served = max(queue.committed(self.source), self.known or 0)
        self.known = max(served, min(queue.last(self.source), served + self.fetch))
        return {"sequence": self.known}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(start["sequence"], end["sequence"])]

    def read(self, partition: Span) -> Iterator[tuple]:
        for i in WebhookQueue(self.folder).read(self.source, partition.after, partition.upto):
            yield i["sequence"], i["externalId"], i["title"], i["content"], i["externalRevision"], i["deleted"]

    def commit(self, end: dict) -> None:
        WebhookQueue(self.folder).commit(self.source, end["sequence"])


class WebhookSource(DataSource):
    """Options: path (the queues' folder), source (its key), fetch (payloads of a batch)."""

    @classmethod
    def name(cls) -> str:
        return "webhooks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> WebhookReader:
        return WebhookReader(self.options["path"], self.options["source"], int(self.options.get("fetch", FETCH)))
