import datetime
import time

import pytest
from pyspark.sql import functions as F

from quillmill.sources import files
from quillmill.streaming.conversation import conversation_counts
from quillmill.streaming.ingest import Ingestor


def test_ingest_stream(spark, tmp_path):
    root, store, waited = tmp_path / "in", tmp_path / "store", []
    (root / "My Docs").mkdir(parents=True)
    (root / "My Docs" / "a.md").write_text("# A\n\nSome words here.\n")
    (root / "b.CSV").write_text("x,y\n1,2\n")
    (root / "copy.md").write_text("# A\n\nSome words here.\n")
    (root / "empty.txt").write_text(" \n")
    (root / "skip.bin").write_text("no")
    (root / "bad.pdf").write_text("no pdf")
    ingestor = Ingestor(spark, str(root), str(store), pdf_reader=lambda b: (_ for _ in ()).throw(ValueError("broken")), sleep=waited.append)
    ingestor.stream(str(tmp_path / "cp")).awaitTermination()
    chunks = ingestor.chunks.read().collect()
    assert len(chunks) == 2
    assert len(chunks[0].embedding) == 64
    assert waited == [2, 4]
    events = {(r.file_path.rsplit("/", 1)[1], r.status, r.attempt_count) for r in ingestor.log.read().collect()}
    assert {("bad.pdf", s, n) for s in ("processing", "failed") for n in (1, 2, 3)} <= events
    state = {(r.file_path.rsplit("/", 1)[1], r.status) for r in ingestor.state().collect()}
    assert ("empty.txt", "failed") in state and ("bad.pdf", "failed") in state and sum(s == "done" for _, s in state) == 2
    (root / "c.txt").write_text("More text.")
    ingestor.stream(str(tmp_path / "cp")).awaitTermination()
    assert ingestor.chunks.read().count() == 3
    scan = files.scan_folder(spark, str(root))
    ingestor.retry(scan, "retry")
    assert ingestor.state().agg(F.max("attempt_count")).first()[0] == 3
    assert ingestor.chunks.read().count() == 3
    statuses, collections = ingestor.diagnostics()
    assert {tuple(r) for r in statuses.collect()} == {("done", 3), ("failed", 2)} and sum(r.chunks for r in collections.collect()) == 3


def test_sweep_and_diagnostics(spark, tmp_path):
    root, store, seen, broken = tmp_path / "in", tmp_path / "store", [], tmp_path / "broken"
    root.mkdir()
    (root / "a.pdf").write_text("x")
    broken.write_text("yes")

    def reader(content):
        if broken.exists():
            raise ValueError("not now")
        return ["Some text of the page."]

    ingestor = Ingestor(spark, str(root), str(store), pdf_reader=reader, sleep=lambda s: None)
    ingestor.attempt(files.scan_folder(spark, str(root)), "first")
    assert [r.status for r in ingestor.state().collect()] == ["failed"]
    broken.unlink()
    queries = [ingestor.sweep(str(tmp_path / "s"), "1 second"), ingestor.watch_diagnostics(lambda a, b: seen.append({r.status: r.n for r in a.collect()}), str(tmp_path / "d"), "1 second")]
    try:
        for _ in range(60):
            time.sleep(1)
            if seen and seen[-1] == {"done": 1}:
                break
    finally:
        for q in queries:
            q.stop()
    assert seen[-1] == {"done": 1} and ingestor.chunks.read().count() == 1


def test_changed_files_are_taken_in(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("First text.")
    ingestor = Ingestor(spark, str(root), str(tmp_path / "store"), sleep=lambda s: None)
    query = ingestor.rescan(str(tmp_path / "r"), "1 second", 0.0)
    try:
        for want, text in ((1, "Second text, written over the first."), (2, None)):
            for _ in range(60):
                time.sleep(1)
                if ingestor.chunks.read().count() == want:
                    break
            if text:
                (root / "a.txt").write_text(text)
    finally:
        query.stop()
    assert {r.text.split("\n\n")[1] for r in ingestor.chunks.read().collect()} == {"First text.", "Second text, written over the first."}


@pytest.mark.parametrize("lateness", [None, "1 day"])
def test_conversation_state(spark, tmp_path, lateness):
    """Redeliveries are dropped, lower ids that come late are counted."""
    folder = tmp_path / "m"
    schema = "session_id string, id long, role string, content string, created_at timestamp"
    at = lambda n: datetime.datetime(2025, 1, 1, 0, n)
    out = []
    for part in ([("s", 2, "human", "a", at(1)), ("s", 5, "ai", "b" * 2000, at(2))], [("s", 5, "ai", "b" * 2000, at(2)), ("s", 6, "human", "c" * 2000, None), ("s", 1, "system", "late", at(3))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        query = conversation_counts(stream, lateness).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert (out[-1].msg_count, out[-1].last_role, out[-1].summarize_every) == (4, "human", 4)
