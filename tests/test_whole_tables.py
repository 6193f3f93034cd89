"""Queries without a DuckDB statement against results worked out row by row."""

import math
import random
import re
from collections import Counter

from quillmill import queries as core
from quillmill.functions.embedding import hash_embedder

WORDS = "pump bridge winter panel harbour valve crew record wiki form lathe sensor door bench lamp".split()


def brute_force(documents, vectors):
    """hybrid_retrieve's rows without rank limit, by query: (chunk, collection, dense, sparse, boost)."""
    vectors = dict(vectors)
    embed = hash_embedder()
    vector = {d[0]: vectors.get(d[0]) or embed([d[1] or ""])[0] for d in documents}

    def cosine(a, b):
        length = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / length, 6) + 0.0 if length else 0.0

    words = lambda text: re.findall(r"[a-z0-9_]+", (text or "").lower())
    out = {}
    for query, asked, *_ in documents:
        if query % 50 or not (asked or "").strip(" "):
            continue
        rows = out[query] = []
        for collection in sorted({d[4] for d in documents if d[4]}):
            near = sorted((-cosine(vector[d[0]], vector[query]), str(d[0]), d) for d in documents if d[4] == collection)[:30]
            texts = {key: words(d[1]) for _, key, d in near}
            mean = sum(map(len, texts.values())) / len(texts)
            seen = Counter(w for t in texts.values() for w in set(t))
            raw = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in seen.items()}
            idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
            for dense, key, d in near:
                count = Counter(texts[key])
                sparse = sum(idf[w] * count[w] * 2.5 / (count[w] + 1.5 * (0.25 + 0.75 * len(texts[key]) / mean)) for w in words(asked) if w in count)
                parts = asked.lower().split()
                name = f"{d[2]}/{d[0]}.{d[3]}".lower()
                boost = 0.1 * any(w in d[2].lower() for w in parts) + 0.05 * any(w in name for w in parts)
                rows.append((key, collection, -dense + 0.0, sparse, boost))
    return out


def test_every_document_asks_and_is_searched(spark, tmp_path):
    r = random.Random(8)
    documents = [(n, " ".join(r.choices(WORDS, k=r.randint(3, 12))), f"{r.choice(WORDS)}/x", "txt", r.choice(("a", "a", "b"))) for n in range(101)]
    documents[7] = (7, None, "wiki/x", "txt", "a")
    documents[8] = (8, "  ", "wiki/x", "txt", None)
    vectors = [(n, [r.choice((-1, 1)) * 0.125 for _ in range(64)]) for n in range(0, 30)]
    spark.createDataFrame(documents, "doc_id bigint, text string, source string, doc_type string, collection string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute_force(documents, vectors)
    assert set(want) == {0, 50, 100}
    got = {(x.query_id, x.chunk_id, x.collection): x.sparse_score for x in core.queries()["bm25_scores_all"](spark, str(tmp_path)).collect()}
    rows = {(q, key, c): sparse for q, found in want.items() for key, c, _, sparse, _ in found}
    assert set(got) == set(rows) and all(abs(got[k] - rows[k]) < 2e-6 for k in rows)
    best = core.queries()["hybrid_retrieve_all"](spark, str(tmp_path)).collect()
    for query, found in want.items():
        first = sorted(found, key=lambda x: (-round(x[2] + round(x[3], 6) + x[4], 6), x[1], x[0]))[:8]
        own = sorted((x for x in best if x.query_id == query), key=lambda x: x["rank"])
        assert [(x.chunk_id, x.collection) for x in own] == [x[:2] for x in first]
        assert all(abs(x.dense_score - y[2]) < 2e-6 and abs(x.metadata_boost - y[4]) < 1e-9 for x, y in zip(own, first))
