from __future__ import annotations

from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from leaksieve.operators import store
from leaksieve.operators.incremental import incremental_scan
from leaksieve.operators.scan import scan
from leaksieve.operators.skew import _BITS, FILTER_BYTES, filter_bitmaps, filter_error, maybe_in
from leaksieve.rules.catalogue import standard_rules
from tests.conftest import as_tuples, corpus

RULES = [rule for rule in standard_rules() if "Plate" in rule.name]


@pytest.fixture()
def name(spark):
    name = f"contents_{uuid4().hex}"
    yield name
    store.drop(spark, name)


def plates(spark, *numbers):
    return corpus(spark, *(f"AB{n}CD77" for n in numbers))


def kept(spark, name):
    return sorted(row.snippet for row in store.stored(spark, name).where("type is not null").collect())


def test_batches_are_kept_and_levels_merged(spark, name):
    for n in range(100, 109):
        texts = plates(spark, n, n + 1, n)
        found = store.scan_batch(texts, RULES, name, f"b{n}", buckets=4, fan=3)
        assert sorted(as_tuples(found)) == sorted(as_tuples(scan(texts, RULES)))
    # Nine batches in threes: three merged runs of level 1, merged into one of level 2.
    assert [run.level for run in store.runs(spark, name)] == [2]
    assert kept(spark, name) == [f"AB{n}CD77" for n in range(100, 110)]
    one = store.runs(spark, name)[0]
    files = spark.table(one.table).select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 4 and one.buckets == 4


def test_a_repeated_batch_replaces_itself(spark, name):
    for _ in range(3):
        found = store.scan_batch(plates(spark, 100, 101), RULES, name, "one", buckets=4, fan=2)
        assert found.count() == 2 and kept(spark, name) == ["AB100CD77", "AB101CD77"]
    store.scan_batch(plates(spark, 102), RULES, name, "two", fan=2)
    # "one" is part of a merged run now; its contents are known there.
    store.scan_batch(plates(spark, 100, 101), RULES, name, "one", fan=2)
    assert kept(spark, name) == ["AB100CD77", "AB101CD77", "AB102CD77"]
    assert sum(run.level == 0 for run in store.runs(spark, name)) == 1


def test_runs_read_together_group_and_join_as_one_table(spark, name):
    marks = corpus(spark, *map(str, range(40))).select(
        F.md5(F.col("text").cast("binary")).alias("content_md5"),
        *(F.lit(None).cast(store._TYPES.get(c, "string")).alias(c) for c in ("ruleset", *store.FOUND)),
    )
    for n in range(3):  # the same rows in three runs
        store._write(marks.repartition(4, "content_md5"), name, store.Run("", 0, f"b{n}", 4, ()))
    rows = store.stored(spark, name)
    assert rows.count() == 120 and rows.distinct().count() == 40
    assert rows.distinct().rdd.count() == 40 and rows.select("content_md5").distinct().count() == 40
    assert {row["count"] for row in rows.groupBy("content_md5").count().collect()} == {3}
    assert marks.repartition(4, "content_md5").join(rows, "content_md5", "left_anti").isEmpty()
    store.compact(spark, name, fan=3)
    assert store.stored(spark, name).count() == 40


def test_what_a_lost_driver_leaves_is_not_read(spark, name):
    store.scan_batch(plates(spark, 100), RULES, name, "one", buckets=4)
    store.scan_batch(plates(spark, 101), RULES, name, "two")
    live = store.runs(spark, name)
    # Written but not published; then published, with the runs it stands for still there.
    spark.table(live[0].table).write.saveAsTable(f"{name}__run_unpublished")
    assert len(store.runs(spark, name)) == 2
    rows = store.stored(spark, name)
    store._write(rows, name, store.Run("", 1, "", 4, tuple(run.table for run in live)))
    assert [run.level for run in store.runs(spark, name)] == [1] and len(store._tables(spark, name)) == 4
    assert kept(spark, name) == ["AB100CD77", "AB101CD77"]
    store.compact(spark, name)
    assert len(store._tables(spark, name)) == 1 and kept(spark, name) == ["AB100CD77", "AB101CD77"]


def test_empty_and_null_texts_and_empty_corpora(spark, name):
    texts = spark.createDataFrame([("a", None), ("b", ""), (None, "AB100CD77")], "file string, text string")
    # A text without a file name is scanned and kept, and found under no name.
    assert [row.file for row in store.scan_batch(texts, RULES, name, "one", buckets=4).collect()] == [None]
    assert store.scan_batch(texts.limit(0), RULES, name, "none").count() == 0
    assert kept(spark, name) == ["AB100CD77"]
    with pytest.raises(ValueError):
        store.scan_batch(texts, RULES, "no name", "one")


def _plan(frame) -> str:
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return frame._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("partitions", ["4", "64"])
@pytest.mark.parametrize("rows_per_task", [1, 1_000_000])
def test_stored_rows_are_joined_where_they_lie(spark, name, partitions, rows_per_task):
    store.scan_batch(plates(spark, 100, 101), RULES, name, "one", buckets=16, fan=9)
    store.scan_batch(plates(spark, 102, 103), RULES, name, "two", fan=9)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": partitions}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        texts = plates(spark, 100, 103, 104, 104)
        found, _ = incremental_scan(
            texts, RULES, store.stored(spark, name), buckets=16, rows_per_task=rows_per_task
        )
        assert sorted(as_tuples(found)) == sorted(as_tuples(scan(texts, RULES)))
        if rows_per_task > 1:
            # From a scan of the store up to its join there is a Sort and no Exchange.
            above = _plan(found).split("FileScan")[0]
            assert "Exchange" not in above[above.rindex("Sort [") :] and "SortMergeJoin" in above
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_the_filter_follows_the_count(spark):
    assert filter_bitmaps(0) == 1 and filter_bitmaps(10**7) == -(-12 * 10**7 // _BITS)
    for ids in (10**3, 10**6, 10**8):
        assert filter_error(ids, filter_bitmaps(ids)) < 0.01
    # 10^9 ids need 1.5 GB, which has to be asked for.
    assert filter_bitmaps(10**9) * _BITS == 8 * FILTER_BYTES and filter_error(10**9, filter_bitmaps(10**9)) > 0.1
    roomy = filter_bitmaps(10**9, 1_600_000_000)
    assert roomy * _BITS // 8 < 1_600_000_000 and filter_error(10**9, roomy) < 0.01


def test_the_filter_loses_nothing_and_lets_little_through(spark):
    rows = spark.range(60_000).select(F.xxhash64("id").alias("_id"), "id")
    wanted = rows.where("id < 20000").select("_id")
    let = maybe_in(rows, wanted, "_id").select("id").toPandas()["id"]
    assert (let < 20_000).sum() == 20_000
    assert (let >= 20_000).sum() < 0.01 * 40_000
    # A filter that is too small lets more through and still loses nothing.
    full = maybe_in(rows, wanted, "_id", most_bytes=4096).select("id").toPandas()["id"]
    assert (full < 20_000).sum() == 20_000 and len(full) > len(let)
    assert maybe_in(rows, wanted.limit(0), "_id").count() == 0
