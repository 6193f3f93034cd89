import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm.packing import pack, pack_texts, plan_packing
from quillmill.llm.splitting import _tier, cut_texts, split_records, words_of
from quillmill.llm.tokens import RANK_FILE, encoding


def greedy(text, limit, overlap, floor):
    """The same cuts one after the other."""
    codes, _, ws, we, count = words_of([text])
    n = int(count[0])
    tier = _tier(codes, we, np.append(ws[1:], we[-1:]))
    tier[-1] = 0
    out, at = [], 0
    while True:
        if n - at <= limit:
            return [*out, (at, n)]
        most, end = at + limit, None
        for low in (at + min(max(floor, overlap + 1), limit), at + min(overlap + 1, limit)):
            for want in (3, 2, 1):
                ends = [e for e in range(low, most + 1) if tier[e - 1] >= want]
                if end is None and ends:
                    end = ends[-1]
        end = end or most
        out.append((at, end))
        at = max(end - overlap, at + 1)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab.!? \n　", max_size=120), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 5), st.integers(0, 6))
def test_cuts_equal_sequential_cuts(texts, limit, overlap, floor):
    got = cut_texts(texts, *(np.full(len(texts), x) for x in (limit, overlap, floor))).to_pylist()
    for text, pieces in zip(texts, got):
        words = text.split()
        if not words:
            assert pieces == []
            continue
        overlap_ = min(overlap, max(limit - 1, 0))
        assert [(p["first_word"], p["first_word"] + p["words"]) for p in pieces] == greedy(text, limit, overlap_, min(floor, limit))
        for p in pieces:
            assert text[p["char_from"] : p["char_from"] + p["chars"]].split() == words[p["first_word"] : p["first_word"] + p["words"]]
            assert p["words"] <= limit


def test_split_records(spark):
    profile = spark.createDataFrame([("txt", 4, 1, 2), ("csv", 2, 0, 1)], "doc_type string, max_tokens int, overlap_tokens int, min_tokens int")
    rows = [("a", "a b c d e f", "txt"), ("b", "a b c", "CSV"), ("c", "a b c d e", None), ("d", "a b c d e", "odd"), ("e", None, "txt"), ("f", " \n", "txt"), ("g", "w " * 100_000, "txt"), ("a", "a b c d e f", "txt")]
    df = spark.createDataFrame(rows, "rec_key string, text string, doc_type string").withColumn("words", F.lit(1))
    got = {r.rec_key: [p["words"] for p in r.pieces] for r in split_records(df, profile).collect()}
    assert got["a"] == [4, 3] and got["b"] == [2, 1] and got["c"] == got["d"] == [4, 2] and got["e"] == got["f"] == []
    assert len(got["g"]) == 33_333 and split_records(df.limit(0), profile).count() == 0
    # Without a row for unknown types these have no limit; of two rows of a type the least counts; no profile loses no record.
    other = spark.createDataFrame([("csv", 3, 0, 0), ("CSV", 2, 0, 0), (None, 1, 0, 0)], "doc_type string, max_tokens int, overlap_tokens int, min_tokens int")
    got = {r.rec_key: [p["words"] for p in r.pieces] for r in split_records(df, other).collect()}
    assert got["b"] == [2, 1] and got["c"] == [5] and got["g"] == [100_000]
    assert split_records(df, other.limit(0)).count() == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.just(40))
def test_packing_is_whole(lengths, capacity):
    histogram = np.bincount(np.array(lengths, dtype=int), minlength=capacity + 1) if lengths else np.zeros(capacity + 1, dtype=int)
    plan = plan_packing(histogram, capacity)
    length = np.repeat(np.arange(capacity + 1), histogram)
    rank = np.concatenate([np.arange(n) for n in histogram]) if lengths else np.zeros(0, dtype=int)
    if not lengths:
        return
    where = plan.of(length, rank)
    load = np.bincount(where, weights=length, minlength=plan.containers)
    assert load.max() <= capacity and load.min() > 0 and len(load) == plan.containers
    assert plan.containers <= 2 * -(-sum(lengths) // capacity)


def test_pack_hot_length(spark):
    df = spark.createDataFrame([(i, 7 if i % 3 else i % 50 + 1) for i in range(3000)] + [(9000, None), (9001, 0), (9002, 99)], "id long, n int").withColumn("container_", F.lit(0))
    rows = pack(df, ["id"], "n", 60).collect()
    assert len(rows) == 3003 and {r.id for r in rows if r.container is None} == {9000, 9001, 9002}
    load = {}
    for r in rows:
        if r.container is not None:
            load[r.container] = load.get(r.container, 0) + r.n
    assert max(load.values()) <= 60 and sorted(load) == list(range(len(load)))
    assert sum(load.values()) / (60 * len(load)) > 0.97


def test_pack_texts(spark):
    pytest.importorskip("tiktoken")
    rows = [(1, "some words"), (2, ""), (3, None), (4, " \n"), (5, "word " * 5000), (1, "some words"), (None, "x")]
    got = pack_texts(spark.createDataFrame(rows, "doc_id long, text string"), capacity=100).collect()
    size = len(encoding(RANK_FILE).encode_ordinary("word " * 5000))
    big = sorted((r.part_no, r.first_token, r.tokens) for r in got if r.doc_id == 5)
    assert sum(t for _, _, t in big) == size and all(t == 100 for _, _, t in big[:-1]) and [f for _, f, _ in big] == [100 * i for i in range(len(big))]
    assert sorted(r.doc_id for r in got if r.doc_id != 5) == [1, 1]
    assert pack_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
