"""Processing messages from files: a streaming source of Spark's Python Data Source API.

A topic is a folder of files of JSON lines, one for each partition and piece: {topic}/{partition}-{anything}.jsonl, read in
order of their names. The offset of a stream is, for each topic and partition, the last file taken; a batch takes whole
files, at most `filesPerBatch` new ones of each partition, and each partition is a task. Files are written whole (renamed
into place) and are not changed later; those whose names sort before one already taken are not seen. A line that isn't a
JSON object still comes, as its text, for `parsed` to tell."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..streaming.processing import parsed

NAME = re.compile(r"(\d+)-.+\.jsonl")


class Piece(InputPartition):
    """The files of one topic and partition that a batch reads."""

    def __init__(self, topic: str, partition: int, paths: list[str]):
        self.topic, self.partition, self.paths = topic, partition, paths


class MessageReader(DataSourceStreamReader):
    def __init__(self, path: str, topics: list[str], per_batch: int):
        self.path, self.topics, self.per_batch = path, topics, per_batch
        self.taken: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {}

    def files(self) -> dict[str, list[str]]:
        """Files by topic/partition, in order."""
        found: dict[str, list[str]] = {}
        for topic in self.topics:
            folder = os.path.join(self.path, topic)
            for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
                if match := NAME.fullmatch(name):
                    found.setdefault(f"{topic}/{match[1]}", []).append(name)
        return found

    def between(self, start: dict, end: dict) -> dict[str, list[str]]:
        return {key: [n for n in names if start.get(key, "") < n <= end.get(key, "")] for key, names in self.files().items()}

    def latestOffset(self) -> dict:
        """A batch further than the last one given: Spark asks once for each batch."""
        for key, names in self.files().items():
            new = [n for n in names if n > self.taken.get(key, "")][: self.per_batch]
            if new:
                self.taken[key] = new[-1]
        return dict(self.taken)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        # After a restart the first batch begins where the last one that was finished ended.
        for key, name in end.items():
            self.taken[key] = max(name, self.taken.get(key, ""))
        return [Piece(key.split("/")[0], int(key.split("/")[1]), [os.path.join(self.path, key.split("/")[0], n) for n in names]) for key, names in sorted(self.between(start, end).items()) if names]

    def read(self, partition: Piece) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, encoding="utf-8") as lines:
                for number, line in enumerate(lines):
                    if line.strip():
                        yield (line.rstrip("\n"), partition.topic, partition.partition, f"{os.path.basename(path)}:{number}")

    def commit(self, end: dict) -> None:
        pass


class MessageSource(DataSource):
    """Format `message_files`: value, topic, partition, place. Options: path, topics (comma-separated), filesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "message_files"

    def schema(self) -> str:
        return "value string, topic string, partition int, place string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MessageReader(self.options["path"], [t.strip() for t in self.options["topics"].split(",")], int(self.options.get("filespersbatch", self.options.get("filesPerBatch", "100"))))


def message_files(spark: SparkSession, path: str, topics: list[str], per_batch: int = 100) -> DataFrame:
    """A stream of processing messages from files of messages, in a folder that driver and executors share."""
    spark.dataSource.register(MessageSource)
    raw = spark.readStream.format("message_files").option("path", path).option("topics", ",".join(topics)).option("filesPerBatch", str(per_batch)).load()
    return parsed(raw)


def write_messages(path: str, topic: str, partition: int, name: str, messages: list[dict]) -> None:
    """A file of messages, put into place whole."""
    folder = os.path.join(path, topic)
    os.makedirs(folder, exist_ok=True)
    hidden = os.path.join(folder, f".{partition}-{name}")
    with open(hidden, "w", encoding="utf-8") as out:
        out.writelines(json.dumps(m) + "\n" for m in messages)
    os.replace(hidden, os.path.join(folder, f"{partition}-{name}.jsonl"))
