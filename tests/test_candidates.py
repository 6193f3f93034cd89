"""Scores of candidates whose words travel instead of their texts."""

import random

from pyspark.sql import functions as F

from quillmill import queries as core
from quillmill.operators import retrieval as R

WORDS = [f"w{n}" for n in range(40)]


def lying(spark):
    """Bytes in shuffle files and blocks on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getPath(): files.apply(i).length() for i in range(files.size())}


def test_no_text_is_kept_for_each_candidate(spark, tmp_path):
    r = random.Random(3)
    usual = [f"{r.choice(WORDS)}{r.choice(WORDS)}" for _ in range(3000)]
    documents = [(n, " ".join(r.choices(usual, k=150)), "wiki/x", "txt", f"c{n % 5}") for n in range(1500)]
    spark.createDataFrame(documents, "doc_id bigint, text string, source string, doc_type string, collection string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, [0.125] * 64) for n in range(9)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = lying(spark)
    assert core.queries()["hybrid_retrieve_all"](spark, str(tmp_path)).count() == 30 * 8
    written = sum(n for path, n in lying(spark).items() if path not in before)
    assert written < 2.5 * sum(len(d[1]) for d in documents)


def test_candidate_scores_are_those_of_bm25(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices(WORDS, k=r.randint(0, 30)) + [f"rare{n}", "Größe_1 ÉTÉ K2"][: n % 3]) for n in range(60)]
    texts[4], texts[5], texts[6] = None, "w1 " * 600 + "w2", "rare7 " * 300 + "lone"
    chunks = [(str(n), r.choice("ab") if n % 9 else None, t, r.choice(["Guide > W3", "", None]), f"w{n}.md", [r.random() for _ in range(4)]) for n, t in enumerate(texts)]
    asked = [(n, r.choice(["w1 w1 w2 rare7 rare7 lone", "W3 guide", "K2 größe_1 none", "w5\tw6.md w9", "??"]), [r.random() for _ in range(4)]) for n in range(12)]
    c = spark.createDataFrame(chunks, "chunk_id string, collection string, text string, section_path string, filename string, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id int, query string, query_vector array<double>")
    dense = R.dense_topk(c, q, 20, id_col="chunk_id", vector_col="embedding", collection="collection").withColumnRenamed("similarity", "dense_score")
    rows = R.bm25(dense.join(c, ["chunk_id", "collection"]), q, keys=["query_id", "collection"], doc_id="chunk_id", text_col="text").join(q, "query_id")
    want = {x[:3]: x[3:] for x in rows.select("query_id", "collection", "chunk_id", "dense_score", "sparse_score", R.metadata_boost(F.col("query"), F.col("section_path"), F.col("filename"))).collect()}
    got = {(x.query_id, x.collection, x.chunk_id): (x.dense_score, x.sparse_score, x.metadata_boost) for x in R.candidate_scores(c, q, c, k_dense=20).collect()}
    assert set(got) == set(want) and len(got) > 400
    assert any(x[1] for x in got.values()) and any(x[2] for x in got.values())
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 and got[k][2] == want[k][2] for k in want)
    few = c.limit(0)
    assert R.candidate_scores(few, q, few).count() == 0 and R.hybrid_retrieve(c, q.limit(0)).count() == 0
