"""Files of a topic: empty ones and compressed ones."""

from __future__ import annotations

from pathlib import Path

from tests.test_publish import chosen, topic_lines
from tests.test_streaming import drain
from tripstrata.operators import replay
from tripstrata.streaming import query_log, trips


def test_an_empty_file_is_not_lost(spark, tmp_path):
    topic = tmp_path / "topic"
    replay.replay_publish(chosen(spark), str(topic), publish_id="first")
    (topic / "first-empty.txt").write_text("")
    writer = trips.stream_trips(spark, str(topic)).writeStream.format("parquet")
    drain(writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out"))
    audit = query_log.audit_files(spark, f"{tmp_path}/cp", str(topic)).collect()
    assert any(r["file"].endswith("first-empty.txt") for r in audit)
    assert all(r["in_topic"] and r["committed_batches"] == 1 for r in audit)


def test_a_compressed_topic_holds_the_same_events(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "_EVENTS_PER_FILE", 3)
    topic, rows = f"{tmp_path}/topic", chosen(spark, 20).coalesce(1)
    replay.replay_publish(rows, topic, compression="gzip")
    found = [path.name for path in Path(topic).glob("*.gz")]
    assert len(found) == 7 and topic_lines(spark, topic) == sorted(r["value"] for r in replay.to_events(rows).collect())
