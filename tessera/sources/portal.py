"""External services as Spark data sources: pages of a portal's dataset, and crawls by day. Transports are pluggable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS = 4


def fetch(get: Callable[[str], list[tuple]], route: str, attempts: int = ATTEMPTS, pause: float = 1.0) -> list[tuple]:
    """``get`` with retries; waits pause * 2**k after the k-th failure."""
    for k in range(attempts):
        try:
            return get(route)
        except OSError:
            if k + 1 == attempts:
                raise
            time.sleep(pause * 2**k)
    return []


def counting_pages(route: str) -> list[tuple]:
    """Built-in transport for tests: page ``n`` has the rows ``(10 n + i, "row-...")``."""
    page = int(route.rsplit("/", 1)[1])
    return [(10 * page + i, f"row-{10 * page + i}") for i in range(10)]


TRANSPORTS: dict[str, Callable[[str], list[tuple]]] = {"counting": counting_pages}


def register_transport(name: str, get: Callable[[str], list[tuple]]) -> None:
    TRANSPORTS[name] = get


class Part(InputPartition):
    pass


class PortalReader(DataSourceReader):
    def __init__(self, get: Callable[[str], list[tuple]], dataset: str, pages: int):
        self.get, self.dataset, self.pages = get, dataset, pages

    def partitions(self) -> list[InputPartition]:
        return [Part(f"{self.dataset}/{i}") for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from fetch(self.get, partition.value)


class Portal(DataSource):
    """One partition for each page (or day, or region) that a service is asked for."""

    @classmethod
    def name(cls) -> str:
        return "tessera_portal"

    def schema(self) -> str:
        return self.options.get("columns", "id long, label string")

    def reader(self, schema) -> DataSourceReader:
        return PortalReader(TRANSPORTS[self.options.get("transport", "counting")], self.options.get("dataset", "data"), int(self.options.get("pages", "1")))


def dataset(spark: SparkSession, name: str, pages: int, transport: str = "counting") -> DataFrame:
    spark.dataSource.register(Portal)
    return spark.read.format("tessera_portal").options(dataset=name, pages=str(pages), transport=transport).load()
