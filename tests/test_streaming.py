"""Streams give what the batch gives."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import fold as D
from trackloom.plans.folds import switch_step
from trackloom.sources.rides import rides
from trackloom.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ride_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "rides")
    r = rides(spark, SF).where("ride_id < 5").select("ride_id", "seq", "k", "value", "gnss_ok", (F.timestamp_seconds(F.col("seq") + 1_000_000)).alias("ts"))
    r.repartition(1).sortWithinPartitions("seq").write.parquet(path)
    return path


def drain(df, mode="append"):
    name = f"out_{abs(hash(str(df.schema))) % 10**8}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_switch_stream_equals_batch(spark, ride_dir):
    stream = spark.readStream.schema(spark.read.parquet(ride_dir).schema).parquet(ride_dir)
    out = live.stateful(stream, "ride_id", "seq", "ts", D.GnssSwitch, switch_step, "ride_id long, seq long, mode string, switches int", ["ride_id", "seq", "mode", "switches"])
    got = sorted(map(tuple, drain(out)))
    batch = D.fold(spark.read.parquet(ride_dir), "ride_id", ["seq"], D.GnssSwitch, switch_step, "ride_id long, seq long, mode string, switches int")
    assert got == sorted(map(tuple, batch.collect()))


def test_sampled_stream(spark, ride_dir):
    stream = spark.readStream.schema(spark.read.parquet(ride_dir).schema).parquet(ride_dir)
    got = {(r["start"], r["n"]) for r in drain(live.sampled(stream, "ts"), "append")}
    want = {(r["start"], r["n"]) for r in live.sampled(spark.read.parquet(ride_dir), "ts").collect()}
    assert got <= want and len(got) >= len(want) - 4  # windows past the watermark are out
