"""Rate limits on streams, however their files are cut, and started again from a checkpoint."""

import random

import pytest

from lodestrata.streaming import limiter


@pytest.fixture
def requests(spark):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(5)}", round(rng.uniform(0, 500), 3), i) for i in range(300)] + [("k0", 100.0, 900 + i) for i in range(4)] + [("lone", 3.0, 999)]
    return spark.createDataFrame(rows, "key string, at double, seq long")


def decisions(df):
    return sorted((r.key, r.at, r.seq, r.allowed, r.retry_after) for r in df.collect())


@pytest.mark.parametrize("cut", ["by time", "at random"])
def test_a_stream_decides_as_a_batch_does(spark, requests, tmp_path, cut):
    window, source, out, state = 60.0, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    delay = 5.0 if cut == "by time" else 600.0
    if cut == "by time":
        limiter.dealt(requests, source, 5, delay, window)
    else:
        requests.repartition(7).write.parquet(source)
        limiter.ended(requests, window, delay).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: limiter.limited_stream(spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 2).parquet(source), 3, window, delay)
    limiter.run_to_end(stream(), out, state)
    assert decisions(spark.read.parquet(out)) == decisions(limiter.limited(requests, 3, window))


def test_a_stream_goes_on_from_its_checkpoint(spark, requests, tmp_path):
    window, delay, source, out, state = 60.0, 5.0, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    run = lambda: limiter.run_to_end(limiter.limited_stream(spark.readStream.schema(requests.schema).parquet(source), 3, window, delay), out, state)
    requests.filter("at < 200").coalesce(1).write.parquet(source)
    run()
    before = decisions(spark.read.parquet(out))
    run()  # nothing new
    assert decisions(spark.read.parquet(out)) == before
    assert before and max(r[1] for r in before) <= 200 - delay
    requests.filter("at >= 200").coalesce(1).write.mode("append").parquet(source)
    run()
    limiter.ended(requests, window, delay).coalesce(1).write.mode("append").parquet(source)
    run()
    assert decisions(spark.read.parquet(out)) == decisions(limiter.limited(requests, 3, window))


def test_late_requests_are_left_out(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "key string, at double, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows(("a", 1.0, 1), ("a", 100.0, 2))
    run = lambda: limiter.run_to_end(limiter.limited_stream(spark.readStream.schema("key string, at double, seq long").parquet(f"{tmp_path}/in"), 2, 10.0, 20.0), f"{tmp_path}/out", f"{tmp_path}/state")
    run()
    rows(("a", 50.0, 3), ("a", 85.0, 4), (limiter.END, 500.0, -1))
    run()
    assert [r[2] for r in decisions(spark.read.parquet(f"{tmp_path}/out"))] == [1, 4, 2]
