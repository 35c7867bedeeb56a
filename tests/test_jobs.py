import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import jobs


def slow(x):
    time.sleep(0.5)
    return x


def test_one_job_is_cancelled_and_the_other_is_right(spark):
    wait = F.udf(slow, "long")
    long = jobs.start(spark, lambda: spark.range(200, numPartitions=200).select(wait("id").alias("x")).agg(F.sum("x")).collect())
    other = jobs.start(spark, lambda n: spark.range(n).agg(F.sum("id").alias("s")).first().s, 1000)
    deadline = time.time() + 30
    while not long.progress()[1] and time.time() < deadline:
        time.sleep(0.2)
    assert long.progress()[1] >= 1 and not long.done
    long.cancel()
    with pytest.raises(Exception, match="(?i)cancel"):
        long.result(30)
    assert other.result(30) == 499500 and long.cancelled
    with pytest.raises(ZeroDivisionError):
        jobs.start(spark, lambda: 1 / 0).result(10)
    waiting = jobs.start(spark, time.sleep, 3)
    with pytest.raises(TimeoutError):
        waiting.result(0.1)
    waiting.result(10)


def numbers(spark, n, add=0):
    CALLS.append(n)
    return spark.range(n).select((F.col("id") + add).alias("id"))


CALLS: list[int] = []


def test_results_are_kept_until_they_are_old(spark, tmp_path):
    now = [1000.0]
    kept = jobs.Results(spark, str(tmp_path / "r"), seconds=60, clock=lambda: now[0])
    CALLS.clear()
    assert kept.get(numbers, 3).count() == 3 and kept.get(numbers, 3).count() == 3 and CALLS == [3]
    assert kept.get(numbers, 3, add=5).agg(F.min("id")).first()[0] == 5 and CALLS == [3, 3]
    now[0] += 61
    stale = kept._times(kept._folder(numbers, (3,), {}))
    assert kept.get(numbers, 3).count() == 3 and CALLS == [3, 3, 3]
    assert len(kept._times(kept._folder(numbers, (3,), {}))) == len(stale) + 1
    kept.refresh(numbers, 3)
    assert len(kept._times(kept._folder(numbers, (3,), {}))) == 2 and len(CALLS) == 4
    with pytest.raises(TypeError):
        kept.get(numbers, object())


def test_a_task_runs_again_and_again(spark, tmp_path):
    ran: list[int] = []
    q = jobs.every(spark, 0.2, ran.append, str(tmp_path / "c"))
    deadline = time.time() + 40
    while len(ran) < 3 and time.time() < deadline:
        time.sleep(0.2)
    q.stop()
    assert ran[:3] == [0, 1, 2]
    again: list[int] = []
    q = jobs.every(spark, 0.2, again.append, str(tmp_path / "c"))
    while not again and time.time() < deadline + 40:
        time.sleep(0.2)
    q.stop()
    assert again[0] >= len(ran) - 1
