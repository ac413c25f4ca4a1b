"""Published tables and topics under readers, failures and repeats."""

from __future__ import annotations

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from tests.helpers import bronze
from tests.test_streaming import drain
from tripstrata.operators import adhoc, replay, silver
from tripstrata.sources import files, lake
from tripstrata.streaming import trips


@pytest.fixture
def name(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shown")
    made = f"`shown`.`t_{uuid.uuid4().hex[:8]}`"
    yield made
    lake.drop_published(spark, made)


def figures(spark, generation, rows=50):
    return spark.range(rows).select(F.col("id").alias("k"), F.lit(generation).alias("generation"))


def test_readers_see_one_whole_version_while_tables_change(spark, name):
    lake.publish_table(figures(spark, 0), name, grain=["k"])
    seen, problems, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                rows = spark.table(name).collect()
                seen.append((len(rows), len({r["generation"] for r in rows})))
            except Exception as problem:  # collected for the assertion
                problems.append(problem)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for generation in range(1, 6):
            lake.publish_table(figures(spark, generation), name, grain=["k"], keep=6)
    finally:
        done.set()
        reader.join()
    assert not problems and seen and set(seen) == {(50, 1)}
    assert spark.table(name).first()["generation"] == 5


def test_a_writer_that_dies_leaves_the_old_table(spark, name, monkeypatch):
    lake.publish_table(figures(spark, 1), name)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(lake, "point_to", dies)
        with pytest.raises(KeyboardInterrupt):
            lake.publish_table(figures(spark, 2), name)
    assert {r["generation"] for r in spark.table(name).collect()} == {1}
    assert len(lake.table_versions(spark, name)) == 2
    with monkeypatch.context() as patched:
        patched.setattr(lake, "drop_old_versions", dies)
        with pytest.raises(KeyboardInterrupt):
            lake.publish_table(figures(spark, 3), name)
    assert {r["generation"] for r in spark.table(name).collect()} == {3}
    lake.publish_table(figures(spark, 4), name, keep=1)
    assert {r["generation"] for r in spark.table(name).collect()} == {4}
    assert lake.table_versions(spark, name) == [lake.published_version(spark, name)]


def test_a_broken_grain_fails_the_write_and_leaves_no_trace(spark, name):
    lake.publish_table(figures(spark, 1), name, grain=["k"])
    before = lake.table_versions(spark, name)
    with pytest.raises(ValueError, match="more than one row"):
        lake.publish_table(figures(spark, 2).union(figures(spark, 2, 1)), name, grain=["k"])
    assert lake.table_versions(spark, name) == before
    assert {r["generation"] for r in spark.table(name).collect()} == {1}
    nulls = spark.createDataFrame([(None, "a"), (1, None)], "k int, v string")
    lake.publish_table(nulls, name, grain=["k"])
    assert sorted(map(tuple, spark.table(name).collect()), key=str) == [(1, None), (None, "a")]


def test_other_columns_and_an_empty_table_may_follow(spark, name):
    lake.publish_table(figures(spark, 1), name)
    lake.publish_table(spark.createDataFrame([], "k long, label string, `odd name` double"), name, grain=["k"])
    assert spark.table(name).columns == ["k", "label", "odd name"] and spark.table(name).isEmpty()


def test_a_table_that_was_not_published_is_taken_over(spark, name):
    figures(spark, 7).write.saveAsTable(name)
    assert lake.published_version(spark, name) is None
    lake.publish_table(figures(spark, 8), name)
    assert {r["generation"] for r in spark.table(name).collect()} == {8}


def test_versions_are_no_tables_to_a_reader(spark, name):
    lake.publish_table(figures(spark, 1), name)
    lake.publish_table(figures(spark, 1), name)
    table = name.split("`")[3]
    found = {r["table_name"] for r in adhoc.catalog(spark, ["shown"]).collect()}
    assert found == {table}
    assert adhoc.table_preview(spark, "shown", table).row_count == 50
    result = adhoc.run_sql(spark, f"SELECT count(*) AS n FROM {name}")
    assert result.error is None and result.rows == [[50]]
    assert lake.drop_published(spark, name) and not lake.drop_published(spark, name)
    assert not spark.catalog.tableExists(name) and lake.table_versions(spark, name) == []


def chosen(spark, n=4):
    return silver.silver_accepted(bronze(spark, *[{"trip_distance": float(i + 1)} for i in range(n)])).drop("period")


def topic_lines(spark, topic):
    return sorted(r["value"] for r in spark.read.text(topic).collect())


def test_a_repeated_publish_adds_nothing(spark, tmp_path):
    topic, rows = f"{tmp_path}/topic", chosen(spark)
    first = replay.replay_publish(rows, topic)
    assert replay.replay_publish(rows.repartition(3), topic) == first
    assert len(topic_lines(spark, topic)) == 4
    assert replay.replay_publish(rows, topic, publish_id="again") == "again"
    assert len(topic_lines(spark, topic)) == 8
    with pytest.raises(ValueError):
        replay.replay_publish(rows, topic, publish_id="../x")


@pytest.mark.parametrize("moved", [0, 1, 3])
def test_a_publish_that_died_is_taken_up(spark, tmp_path, monkeypatch, moved):
    topic, rows = f"{tmp_path}/topic", chosen(spark).repartition(4)
    real, calls = files.rename, []

    def dies(spark_, source, target):
        if source.startswith(f"{topic}/_staged") and len(calls) >= moved:
            raise OSError("killed")
        calls.append(target)
        return real(spark_, source, target)

    with monkeypatch.context() as patched:
        patched.setattr(replay, "_MOVES_AT_A_TIME", 1)
        patched.setattr(replay.files, "rename", dies)
        with pytest.raises(OSError):
            replay.replay_publish(rows, topic)
    for _ in range(2):
        replay.replay_publish(rows, topic)
    lines = topic_lines(spark, topic)
    assert len(lines) == 4 and lines == sorted(r["value"] for r in replay.to_events(rows).collect())


def test_a_publish_that_died_while_staging_starts_again(spark, tmp_path):
    topic, rows = f"{tmp_path}/topic", chosen(spark)
    publish_id = replay.content_id(replay.to_events(rows))
    replay.to_events(rows).write.text(f"{topic}/_staged/{publish_id}")  # written, but no list yet
    replay.replay_publish(rows, topic)
    out = trips.stream_trips(spark, topic).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp")
    drain(out.trigger(availableNow=True).start(f"{tmp_path}/out"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_an_empty_publish(spark, tmp_path):
    topic = f"{tmp_path}/topic"
    replay.replay_publish(chosen(spark).limit(0), topic)
    replay.replay_publish(chosen(spark).limit(0), topic)
    assert topic_lines(spark, topic) == []
