import pytest
from pyspark.sql import functions as F

from quillmill.functions.embedding import embed_texts, embed_with_retries, hash_embedder
from quillmill.functions.vectors import l2_normalize
from quillmill.operators import retrieval as R
from quillmill.operators import sessions as M
from quillmill.operators import state as S
from quillmill.sources import files, sinks


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_normalize(spark):
    assert one(spark, [0.0, 0.0], "array<double>", l2_normalize) == [0.0, 0.0]
    assert one(spark, [3.0, 4.0], "array<double>", l2_normalize) == [0.6, 0.8]
    assert one(spark, None, "array<double>", l2_normalize) is None


def test_boost(spark):
    df = spark.createDataFrame([("setup guide", "Install > Setup", "guide.md"), ("", "a", "b"), (None, None, None)], "q string, s string, f string")
    assert [round(r[0], 2) for r in df.select(R.metadata_boost(F.col("q"), F.col("s"), F.col("f"))).collect()] == [0.15, 0.0, 0.0]


def test_keep_best(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "a", 2.0), (1, None, 1.0), (1, None, 1.0)], "q int, k string, s double")
    assert sorted((r.k or "", r.s) for r in R.keep_best(df, ["q"], "k", [F.desc("s")]).collect()) == [("", 1.0), ("", 1.0), ("a", 3.0)]


def test_agent_retrieve(spark):
    df = spark.createDataFrame([(1, "x", "same", None, 0.2), (1, "y", "same", None, 0.1)], "query_id int, collection string, content string, source string, distance double")
    assert [(r.content, r.distance) for r in R.agent_retrieve(df).collect()] == [("same", 0.1)]


def test_rerank(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0.9), (1, "b", 2.0, 0.1)], "query_id int, chunk_id string, score double, m double")
    assert [r.final_score for r in R.rerank(df, F.col("m")).orderBy("rank").collect()] == [0.925, 0.575]


def test_dense_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0]), (6, [])], "id int, v array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id int, query_vector array<float>")
    got = R.dense_topk(v, q, 2, id_col="id", vector_col="v").orderBy("id").collect()
    assert [(r.query_id, r.id, r.similarity) for r in got] == [(9, 1, 1.0), (9, 5, 1.0)]
    assert R.dense_topk(v.limit(0), q, 2, id_col="id", vector_col="v").count() == 0
    assert R.dense_topk(v, q.limit(0), 2, id_col="id", vector_col="v").count() == 0


def test_bm25_without_words(spark):
    c = spark.createDataFrame([(1, "a", ""), (1, "b", None)], "query_id int, id string, t string")
    q = spark.createDataFrame([(1, "word")], "query_id int, query string")
    assert {r.sparse_score for r in R.bm25(c, q, keys=["query_id"], doc_id="id", text_col="t").collect()} == {0.0}


def test_texts(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, "c", None), (1, 2, 0.25, "d", "s")], "query_id int, rank int, distance double, content string, source string")
    assert R.hits_to_text(hits).first().text == "[score=0.500 | source=unknown]\nc\n\n[score=0.250 | source=s]\nd"
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert {r.text for r in R.with_fallback(q, R.hits_to_text(hits)).collect() if r.query_id == 2} == {R.NO_HITS}
    rows = spark.createDataFrame([(1, 1, 0.5, "c", "", "f", None, 3)], "query_id int, rank int, score double, content string, source string, filename string, page int, page_number int")
    assert "1. [score=0.500 | source=f, page 3]\nc" in R.context_block(rows).first().text


def test_state(spark):
    rows = [("p", "h", "processing", 1, "2024-01-01"), ("p", "h", "done", 1, "2024-01-02"), ("p", "h", "done", 1, "2024-01-02"), ("q", "g", "failed", 2, None)]
    events = spark.createDataFrame(rows, "file_path string, file_hash string, status string, attempt_count int, d string").withColumn("last_attempt", F.to_timestamp("d")).drop("d").withColumns({"error_msg": F.lit(None).cast("string"), "chunk_count": F.lit(1)})
    latest = S.latest_state(events)
    assert {(r.file_path, r.status) for r in latest.collect()} == {("p", "done"), ("q", "failed")}
    files_ = spark.createDataFrame([("other", "h"), ("q", "g")], "file_path string, file_hash string")
    assert [r.file_hash for r in S.not_ingested(files_, latest).collect()] == ["g"]
    assert S.failed_for_retry(latest).count() == 1 and S.failed_for_retry(latest, 2).count() == 0


def test_sessions(spark):
    def messages(lengths):
        return spark.createDataFrame([("s", i, "human", "x" * n, None) for i, n in enumerate(lengths)], "session_id string, id long, role string, content string, created_at timestamp")

    assert M.summarize_threshold(messages([801] * 4)).first().threshold == 4
    assert M.summarize_threshold(messages([9999, 800, 800, 800, 800])).first().threshold == 8
    assert M.summarize_threshold(messages([])).count() == 0
    assert M.summarize_threshold(messages([]), spark.createDataFrame([("e",), (None,)], "session_id string")).collect() == [("e", 8)]
    assert one(spark, 'Session Title: "Foo   bar."', "string", M.clean_title) == "Foo bar"
    node = spark.sql("select array('retrieve') as calls").select(M.next_node(F.lit(5), F.lit(5), F.lit(9), F.lit(8), F.col("calls"))).first()[0]
    assert node == "END"
    assert [r.ord for r in M.keep_last_two(messages([1])).collect()] == [1]
    with pytest.raises(ValueError):
        M.list_sessions(messages([1]), 0)
    tools = spark.sql("select array('a') as b, array('retrieve', 'c', 'a') as n").select(M.tools_used(F.col("b"), F.col("n"))).first()[0]
    assert tools == ["a", "c"]


def test_collection(spark):
    df = spark.createDataFrame([("root/My Docs/x.md",), ("root/x.md",), ("root/__/x.md",)], "p string")
    assert [r[0] for r in df.select(files.collection_for(F.col("p"), "root")).collect()] == ["my_docs", "documents", "documents"]


def test_stable_files(spark):
    rows = [("a", i, n) for i, n in enumerate((1, 2, 2, 2, 2))] + [("b", i, i) for i in range(9)]
    assert [r[0] for r in files.stable_files(spark.createDataFrame(rows, "file_path string, reading_no int, length long")).collect()] == ["a"]


def test_csv_and_html():
    assert files.csv_to_text(b"a,b\n1,\n,2\n") == "a: 1\nb: 2"
    assert files.html_to_text("<title>t</title><script>x</script><p>a</p><!-- c --><nav>n</nav>b") == "t\na\nb"


def test_sinks(spark, tmp_path):
    table = sinks.BucketedTable(spark, str(tmp_path / "t"), "id string, v int", "id", 8)
    assert table.read().count() == 0
    new = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2), (None, 3)], "id string, v int")
    table.upsert(new, ["id"], ["v"])
    table.upsert(new, ["id"], ["v"])
    assert sorted(map(tuple, table.read().collect())) == [("a", 0), ("b", 2)]
    table.delete(F.col("id") == "a")
    assert [r.id for r in table.read().collect()] == ["b"]
    table.delete_value("b")
    table.delete_value("never there")
    assert table.read().count() == 0
    table.upsert(new.limit(0), ["id"], ["v"])
    assert table.drop() and not table.drop()


def test_of_two_writers_one_loses(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, v int"
    one, two = (sinks.BucketedTable(spark, path, schema, "id", 4) for _ in range(2))
    row = lambda k, v: spark.createDataFrame([(k, v)], schema)
    one.upsert(row("a", 1), ["id"], ["v"])
    start = one.snapshot()
    two.upsert(row("b", 2), ["id"], ["v"], at=start)
    with pytest.raises(sinks.LostRace):
        one.upsert(row("c", 3), ["id"], ["v"], at=start)
    one.upsert(row("c", 3), ["id"], ["v"])
    assert sorted(map(tuple, two.read().collect())) == [("a", 1), ("b", 2), ("c", 3)]
    (tmp_path / "t" / "current-9").write_text('{"buckets": 4, "fol')  # a writer that died
    assert one.read().count() == 3
    two.upsert(row("d", 4), ["id"], ["v"])
    assert one.read().count() == 4 and two.snapshot().number == 10


def test_a_file_touches_its_bucket_only(spark, tmp_path):
    table = sinks.chunk_table(spark, str(tmp_path / "c"), buckets=16)
    chunk = lambda f, i: {"chunk_id": f"{f}{i}", "file_hash": f, "chunk_index": i, "text": "t", "collection": "x"}
    made = lambda rows: spark.createDataFrame(rows, sinks.CHUNK_COLUMNS)
    sinks.upsert_chunks(table, made([chunk(f"f{k}", i) for k in range(40) for i in range(3)]))
    before = table.snapshot().folders
    sinks.upsert_chunks(table, made([chunk("f7", 9)]))
    after = table.snapshot().folders
    assert sum(before.get(k) != v for k, v in after.items()) == 1 and table.read().count() == 121
    sinks.delete_file(table, "f7")
    assert sum(after.get(k) != v for k, v in table.snapshot().folders.items()) <= 1 and table.read().count() == 117
    assert sinks.without_files(table.read(), spark.createDataFrame([("f1",), ("f2",), (None,)], "file_hash string")).count() == 111


def test_appended_messages(spark):
    import datetime

    day = lambda n: datetime.datetime(2025, 1, n)
    sessions = spark.createDataFrame([("a", "t", 2, day(5)), ("b", None, None, None), ("c", "u", 1, day(3))], "session_id string, title string, msg_count long, updated_at timestamp")
    old = spark.createDataFrame([("a", 1, day(1))], "session_id string, id long, created_at timestamp")
    new = spark.createDataFrame([("a", 2, day(2)), ("a", 3, None), ("b", 4, day(7)), (None, 5, day(9)), ("z", 6, day(9))], "session_id string, id long, created_at timestamp")
    moved, rows = sinks.append_messages(sessions, old, new)
    assert {tuple(r) for r in moved.collect()} == {("a", "t", 4, day(5)), ("b", None, 1, day(7)), ("c", "u", 1, day(3))}
    assert rows.count() == 6


def test_embedders_by_name():
    from quillmill.functions.embedding import embedder_named

    with pytest.warns(UserWarning, match="unknown embedder"):
        assert len(embedder_named("no such")(["a"])[0]) == 64
    assert len(embedder_named("hash", dimensions=8)(["a"])[0]) == 8
    assert callable(embedder_named("ollama", url="http://localhost:1/api/embed", model="m"))


def test_suffixes_in_any_case(spark, tmp_path):
    for name in ("a.DocX", "b.HTml", "e.mD", "f.txt", "g.bin", "h.PDF"):
        (tmp_path / name).write_bytes(b"x")
    assert {r.filename for r in files.scan_folder(spark, str(tmp_path)).collect()} == {"a.DocX", "b.HTml", "e.mD", "f.txt", "h.PDF"}


def test_embedding(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    got = embed_texts(df, "t", embed=hash_embedder(8), batch_size=2, delays=(0,)).collect()
    assert abs(sum(x * x for x in got[0].embedding) - 1) < 1e-6 and sum(map(abs, got[1].embedding)) == 0
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [[1.0]] * len(texts)

    assert embed_with_retries(flaky, ["x"], (0, 0, 0)) == [[1.0]]
    with pytest.raises(RuntimeError):
        embed_with_retries(lambda t: [], ["x"], (0, 0))


def test_dense_equals_brute_force(spark, monkeypatch):
    """Groups of several blocks, queries in several blocks, ties, vectors of two lengths and rows without a group."""
    import random

    import numpy as np

    from quillmill.operators import nearest

    r = random.Random(6)
    vector = lambda d: [float(r.choice((-1, 0, 1))) for _ in range(d)]
    rows = [(i, r.choice(("a", "a", "b", None, "None")), vector(r.choice((4, 4, 5)))) for i in range(300)]
    asked = [(i, vector(r.choice((4, 5)))) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, g string, v array<float>")
    q = spark.createDataFrame(asked, "query_id long, query_vector array<float>")

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        n = np.sqrt((a * a).sum() * (b * b).sum())
        return round(float(a @ b / n), 6) + 0.0 if n else 0.0

    want = set()
    for key, w in asked:
        for g in ("a", "b", None, "None"):
            near = sorted((-cosine(x, w), i) for i, own, x in rows if own == g and len(x) == len(w))[:7]
            want |= {(key, i, g, -s + 0.0) for s, i in near}
    for block, query, most in ((1 << 16, 1 << 10, 1 << 26), (16, 8, 1 << 26), (16, 8, 0)):
        monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
        monkeypatch.setattr(nearest, "QUERY_ROWS", query)
        monkeypatch.setattr(nearest, "BROADCAST_BYTES", most)
        got = R.dense_topk(v, q, 7, id_col="id", vector_col="v", collection="g").collect()
        assert {(x.query_id, x.id, x.g, x.similarity) for x in got} == want and len(got) == len(want)


def test_index_recall(spark):
    """Every row is in the index; of the ten nearest at least nine in ten are found in the cells visited."""
    import numpy as np

    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    data = centers[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id long, v array<float>")
    q = v.where("id % 50 = 0").selectExpr("id as query_id", "v as query_vector")
    exact = {(r.query_id, r.id) for r in R.dense_topk(v, q, 10, id_col="id", vector_col="v").collect()}
    index = R.VectorIndex(v, id_col="id", vector_col="v", cells=32, sample=1000)
    assert index.vectors.count() == 3000
    found = {(r.query_id, r.id) for r in index.topk(q, 10, probes=8).collect()}
    assert len(exact) == len(found) == 600 and len(exact & found) / 600 >= 0.9
    assert {(r.query_id, r.id) for r in index.topk(q, 10, probes=32).collect()} == exact
    assert R.VectorIndex(v.limit(0), id_col="id", vector_col="v").topk(q, 3).count() == 0
