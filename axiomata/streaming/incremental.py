"""Incremental, idempotent loads: what a re-run of the same input adds is nothing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..operators import sinks


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: list[str], version: str, keep: tuple[str, ...] = ()) -> StreamingQuery:
    """K-01 on a stream: each micro-batch is merged into the table published at ``path``, which is swapped whole.

    A batch that runs again after a failure gives the same table, so rows count
    once however often they arrive.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = sinks.upsert(batch.limit(0), batch, key, version, keep)
        old = sinks.published(spark, path)
        old = new.limit(0) if old is None else old
        sinks.publish(sinks.upsert(old, new, key, version, keep), path)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(rows: DataFrame, path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """R-03..R-07 on a stream: only rows whose key the table lacks are appended, by batch folders that a re-run overwrites."""

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        if exists(spark, path):
            known = spark.read.parquet(path).filter(F.col("batch") != number)
            fresh = fresh.join(known.select(key).distinct(), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class HarvestSource(DataSource):
    """S-01, S-02: a stream of harvest pages; the offset is the resumption token.

    Options: ``pages``, a folder of numbered page files, page n named ``n.xml``.
    Reading over a network needs only another ``fetch``; retries belong there,
    on the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return "token int, page string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return HarvestReader(self.options)


class HarvestReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.pages = options["pages"]

    def initialOffset(self) -> dict:
        return {"token": 0}

    def fetch(self, token: int) -> str | None:
        """A page, or none after the last."""
        try:
            with open(f"{self.pages}/{token}.xml", encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, token = [], start["token"]
        while (page := self.fetch(token)) is not None:
            out.append((token, page))
            token += 1
        return iter(out), {"token": token}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(t, self.fetch(t)) for t in range(start["token"], end["token"])])


def retry_delays(status: int | None, retry_after: int | None, attempt: int, most: int = 5) -> int | None:
    """S-02: seconds to wait before the next attempt, or none to give up: a busy server's own wish, else doubling."""
    if status == 503:
        return retry_after if retry_after is not None else 15
    return 2 ** (attempt + 1) if attempt < most else None


__all__ = ["HarvestSource", "append_new", "retry_delays", "upsert_stream"]
