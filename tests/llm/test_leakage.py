import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm.leakage import LeakIndex, SuffixAutomaton, leaks, remove_leaks

TERM = re.compile(r"[^\W_]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 4), max_size=20), st.integers(1, 4))
def test_longest_matches(passages, stream, least):
    import numpy as np

    index = LeakIndex(passages, np.zeros(0, dtype=np.uint64), least)
    runs = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    want = {}
    for end in range(1, len(stream) + 1):
        best = max((end - i for i in range(end) if tuple(stream[i:end]) in runs), default=0)
        if best >= least:
            want[end] = best
    got = list(index.matches(stream))
    assert {e: n for e, n, _ in got} == want
    for end, _, at in got:
        run = tuple(stream[end - least : end])
        holders = {k for k, p in enumerate(passages) if any(tuple(p[i : i + least]) == run for i in range(len(p)))}
        assert set(index.items_of(index.short[at])) == holders
    assert len(SuffixAutomaton().next) == 1


def data(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(12)] + [(50, "short one"), (51, None), (52, "")]
    items.append((60, items[0][1]))
    docs = []
    for d in range(120):
        body = [r.choice([*words, "new", "other"]) for _ in range(r.randint(0, 60))]
        if d % 4 == 0:
            source = items[r.randint(0, 11)][1].split()
            at, n = r.randint(0, 15), r.randint(5, 15)
            body[len(body) // 2 : len(body) // 2] = [w.upper() for w in source[at : at + n]]
        docs.append((d, ", ".join(body)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (3, docs[4][1])]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")


def test_leaks_equal_brute_force(spark):
    docs, items, d, i = data(spark)
    for block, size in ((10**6, 1 << 28), (70, 1 << 28), (70, 1)):  # one automaton; several in one pass; each in a pass of its own
        got = {(r.doc_id, r.item_id) for r in leaks(d, i, min_terms=6, block_terms=block, pass_bytes=size).collect()}
        grams = {}
        for key, passage in items:
            t = TERM.findall((passage or "").lower())
            for k in range(len(t) - 5):
                grams.setdefault(tuple(t[k : k + 6]), set()).add(key)
        want = {(key, x) for key, text in docs if key is not None for t in [TERM.findall((text or "").lower())] for k in range(len(t) - 5) for x in grams.get(tuple(t[k : k + 6]), ())}
        assert got == want and want


def test_removal(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(1, "Intro words here " * 10 + "P0, " + passage[3:] + ". The end."), (2, passage), (3, "clean"), (4, None), (5, "İİ Intro İ " * 30 + passage.replace("p3", "P3") + " İ end")]
    spark_docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, passage), (8, passage + " more"), (9, "x " + passage)], "item_id long, passage string")
    for size in (1 << 28, 1):
        got = {r.doc_id: r for r in remove_leaks(spark_docs, items, block_terms=25, pass_bytes=size).collect()}
        assert set(got) == {1, 2, 5}
        assert got[1].clean_text == "Intro words here " * 10 + ". The end." and got[1].removed == 20 and not got[1].dropped
        assert got[2].dropped and got[2].clean_text is None
        # Letters whose lower case is longer move no span.
        assert got[5].clean_text == "İİ Intro İ " * 30 + " İ end" and not got[5].dropped


def test_empty(spark):
    d, i = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")
    assert leaks(d, i).count() == 0 and remove_leaks(d, i).count() == 0
    assert leaks(d.limit(0), spark.createDataFrame([(1, "a " * 20)], "item_id long, passage string")).count() == 0
