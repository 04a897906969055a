"""A batch source of pull-request records behind a paged interface; offline pages by default.

spark.dataSource.register(HubSource); spark.read.format("hub").option("targets", "a/b#1,a/b#2").load()
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo string, number int, connection string, issue_number int, title string, state string"
CONNECTIONS = ("closing_references", "timeline_links")
RATE_WORDS = ("rate", "429", "abuse", "secondary")


def retry(call: Callable[[], object], attempts: int = 5, delay: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """L1: again with doubling waits, only for errors that speak of rates."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:
            if n == attempts or not any(w in str(error).lower() for w in RATE_WORDS):
                raise
            sleep(delay)
            delay = min(delay * 2, most)


def offline_page(repo: str, number: int, connection: str, cursor: int, size: int) -> dict:
    """Pages that follow from the request alone: (number mod 4) issues for each connection."""
    every = [{"number": 100 * number + i, "title": f"{connection} {i}", "state": "CLOSED" if i % 2 else "OPEN"} for i in range(number % 4)]
    return {"nodes": every[cursor : cursor + size], "next": cursor + size if cursor + size < len(every) else None}


class Target(InputPartition):
    def __init__(self, repo: str, number: int, connection: str) -> None:
        self.repo, self.number, self.connection = repo, number, connection


class HubReader(DataSourceReader):
    def __init__(self, options: dict, page: Callable = offline_page) -> None:
        self.targets = [t.rsplit("#", 1) for t in options.get("targets", "").split(",") if "#" in t]
        self.size, self.page = int(options.get("pageSize", "50")), page

    def partitions(self) -> list[Target]:
        """One for each PR and connection."""
        return [Target(r.strip(), int(n), c) for r, n in self.targets for c in CONNECTIONS]

    def read(self, partition: Target) -> Iterator[tuple]:
        cursor: int | None = 0
        while cursor is not None:
            try:
                got = retry(lambda: self.page(partition.repo, partition.number, partition.connection, cursor, self.size))
            except Exception:
                return  # an error ends this connection, not the read
            for n in got["nodes"]:
                yield partition.repo, partition.number, partition.connection, n["number"], n["title"], n["state"]
            cursor = got["next"]


class HubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HubReader:
        return HubReader(dict(self.options))


def to_json(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, sort_keys=True)
