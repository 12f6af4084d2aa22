"""Streams that end in files: a recorder with each row once, a landmark map kept by versions, and what the streams themselves report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from trackloom.operators.healing import CANDIDATE, heal

#: Columns of a recorded sensor log, in their order.
SENSOR_LOG = "time long, seconds_elapsed double, z double, y double, x double"


def live_log(spark: SparkSession, folder: str, schema: str = SENSOR_LOG, files_a_batch: int | None = None) -> DataFrame:
    """Sensor logs as they come to a folder, with the file's name; each file is read once."""
    reader = spark.readStream.schema(schema).option("header", True)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    return reader.csv(folder).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def record(stream: DataFrame, folder: str, checkpoint: str, every: str | None = "2 seconds") -> StreamingQuery:
    """Appends a stream to CSV files. Offsets and the list of whole files are kept by batch, so a restart neither loses nor repeats a row
    for those who read the folder by Spark. every: None takes what is there and ends."""
    writer = stream.writeStream.format("csv").option("header", True).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


class MapStore:
    """Versions of a landmark map in a shared folder, one for each batch of a stream.

    A version is written whole before its name is taken, and a batch whose version is there has been done: a batch that Spark repeats
    after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        files = self._files()
        if not files.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path(self.folder))]
        return sorted(int(n.removeprefix("v")) for n in names if n.startswith("v") and n[1:].isdigit() and files.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The latest version, or the latest before a batch; None where there is none."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.schema(CANDIDATE).parquet(f"{self.folder}/v{found[-1]}") if found else None

    def update(self, rows: DataFrame, batch: int, **settings) -> None:
        """For foreachBatch: rows(run, t, x, y, kind), kind null for places that were only passed."""
        if batch in self.versions():
            return
        healed = heal(self.read(before=batch), rows.where("kind is not null"), rows.select("run", "t", "x", "y"), **settings)
        healed.write.mode("overwrite").parquet(f"{self.folder}/v{batch}")
        for old in self.versions()[: -self.keep]:
            self._files().delete(self._path(f"{self.folder}/v{old}"), True)


def keep_map(stream: DataFrame, store: MapStore, checkpoint: str, **settings) -> StreamingQuery:
    """Brings the map up to date with every batch of what is there."""
    return stream.writeStream.foreachBatch(lambda rows, batch: store.update(rows, batch, **settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS = "name string, batch long, rows long, rows_a_second double, ms long, state_rows long, state_bytes long, watermark string"


class ProgressLog(StreamingQueryListener):
    """A row for every batch of every stream that has a name: throughput, duration, size of the state. The last `most` of each are held."""

    def __init__(self, most: int = 1000):
        self.most, self.rows = most, {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(event.name, [])

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = p.get("stateOperators") or []
        row = (p.get("name"), p["batchId"], p.get("numInputRows", 0), float(p.get("processedRowsPerSecond") or 0.0), int(p.get("batchDuration") or sum((p.get("durationMs") or {}).values())), sum(s.get("numRowsTotal", 0) for s in state), sum(s.get("memoryUsedBytes", 0) for s in state), (p.get("eventTime") or {}).get("watermark"))
        held = self.rows.setdefault(p.get("name"), [])
        held.append(row)
        del held[: -self.most]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r for rows in self.rows.values() for r in rows], PROGRESS)


def stream_report(progress: DataFrame, rides: DataFrame, drift: DataFrame, hz: float) -> DataFrame:
    """name, rides, seconds, times_real_time, most_state_bytes, median_drift: of each stream how much faster than recorded its rides went by,
    what it held, and how far off their distances were. rides(name, ride_id, samples), drift(name, ride_id, drift_pct)."""
    ran = progress.groupBy("name").agg((F.sum("ms") / 1000).alias("seconds"), F.max("state_bytes").alias("most_state_bytes"), F.max("state_rows").alias("most_state_rows"))
    lasted = rides.groupBy("name").agg(F.count_distinct("ride_id").alias("rides"), (F.sum("samples") / hz).alias("recorded"))
    off = drift.groupBy("name").agg(F.percentile("drift_pct", 0.5).alias("median_drift"))
    return ran.join(lasted, "name").join(off, "name", "left").select("name", "rides", "seconds", (F.col("recorded") / F.col("seconds")).alias("times_real_time"), "most_state_rows", "most_state_bytes", "median_drift")
