import itertools
import random
import re

import numpy as np
import pytest

from quillmill.llm import near_duplicates
from quillmill.llm.near_duplicates import NearDuplicates, prefix_sizes
from quillmill.plans import skew

TERM = re.compile(r"[^\W_]+")


def corpus(seed=4):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for family in range(12):
        base = [r.choice(words) for _ in range(r.choice((8, 25, 40, 90)))]
        for version in range(r.randint(1, 7)):
            own = [w if r.random() > 0.03 * version else r.choice(words) for w in base]
            rows.append((f"c{len(rows):03}", f"f{r.randint(0, 20)}", " ".join(own) + r.choice(("", ".", " !"))))
    rows += [("x1", "g1", "Same text again and again here"), ("x2", "g2", "same TEXT again, and again here"), ("x3", "g1", "same text again and again here"), ("x1", "g1", "Same text again and again here")]
    return rows + [("n1", "g", None), (None, "g", "same text again and again here"), ("n2", None, ""), ("n3", None, "two terms"), ("n4", None, "same text again and again here")]


def brute(rows, width, threshold, least):
    sets, groups = {}, {}
    for key, group, text in rows:
        if key is None or text is None:
            continue
        terms = TERM.findall(text.lower())
        if len(terms) >= max(least, width):
            sets[key], groups[key] = {tuple(terms[i : i + width]) for i in range(len(terms) - width + 1)}, group
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and (groups[a] is None or groups[a] != groups[b]):
            out.add((a, b))
    return out


SCHEMA = "chunk_id string, file_hash string, text string"


@pytest.mark.parametrize("width, threshold, least", [(3, 0.6, 5), (5, 0.8, 1), (1, 1.0, 1), (2, 0.3, 1)])
def test_pairs_are_exact(spark, width, threshold, least):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = NearDuplicates(df, "chunk_id", "text", "file_hash", width=width, threshold=threshold, min_terms=least).pairs().collect()
    assert {(r.id_a, r.id_b) for r in got} == brute(rows, width, threshold, least)
    assert len(got) == len({(r.id_a, r.id_b) for r in got})


def test_hot_blocks_are_split(spark, monkeypatch):
    """Hot bits, hubs and classes of many copies are spread over keys; no pair is lost or doubled."""
    monkeypatch.setattr(near_duplicates, "HOT", 3)
    monkeypatch.setattr(near_duplicates, "COPIES", 2)
    monkeypatch.setattr(skew, "KEY_ROWS", 2)
    rows = corpus(9) + [(f"y{i}", f"g{i % 3}", "same text again and again here") for i in range(9)]
    assert (near_duplicates.Order(np.full(1 << 16, 0) + np.eye(1, 1 << 16, 5, dtype=int)[0] * 100).parts(np.array([0, 53])) > [0, 20]).all()
    nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", "file_hash", width=2, threshold=0.5)
    got = nd.pairs().collect()
    assert {(r.id_a, r.id_b) for r in got} == brute(rows, 2, 0.5, 1) and len(got) == len({(r.id_a, r.id_b) for r in got})
    split = {tuple(r) for r in nd.groups().collect()}
    monkeypatch.undo()
    assert split == {tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", "file_hash", width=2, threshold=0.5).groups().collect()}
    nd.close()


def test_very_long_texts(spark):
    words = [f"t{i}" for i in range(40_000)]
    rows = [("a", "1", " ".join(words)), ("b", "2", " ".join(words[:38_000])), ("c", "3", " ".join(words[:20_000]))]
    got = NearDuplicates(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", "file_hash", width=3, threshold=0.9).pairs().collect()
    assert [(r.id_a, r.id_b) for r in got] == [("a", "b")] and abs(got[0].similarity - 37_998 / 39_998) < 1e-9


def test_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.rec_id: r for r in NearDuplicates(df, "chunk_id", "text", width=3, threshold=0.6).groups().collect()}
    pairs = brute([(a, None, c) for a, _, c in rows], 3, 0.6, 1)
    for a, b in pairs:
        assert got[a].group_id == got[b].group_id
    assert got["x1"].copies == 4 and got["x1"].group_id == "n4"
    assert all(r.group_id <= k for k, r in got.items())


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", slot int, digest string, bits string, rec_id string")
    nd = NearDuplicates(df, "chunk_id", "text", "file_hash")
    assert nd.pairs().count() == 0 and nd.groups().count() == 0


def many(count, seed=2):
    """Texts of a small vocabulary, one in ten a revision of the one before, so that runs of terms are shared widely."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(count):
        if i % 10 and i % 10 < 9 or not rows:
            own = [r.choice(words) for _ in range(60)]
        else:
            own = [w if r.random() > 0.04 else r.choice(words) for w in rows[-1][2].split(" ")]
        rows.append((f"c{i:05}", f"f{i}", " ".join(own)))
    return rows


def test_blocks_grow_with_the_texts_whatever_the_sketch(spark, monkeypatch):
    small, large = (spark.createDataFrame(many(n), SCHEMA) for n in (300, 3000))
    made = lambda df: NearDuplicates(df, "chunk_id", "text", width=3, threshold=0.6, min_terms=20)
    a, b = made(small).blocks().count(), made(large).blocks().count()
    assert b <= 10.5 * a
    whole = made(large)
    found, met = set(whole.class_pairs().select("digest_a", "digest_b").collect()), whole.candidates().count()
    # A sketch far too small: some forty bits for each cell.
    monkeypatch.setattr(near_duplicates, "LEAST_CELLS", 12)
    monkeypatch.setattr(near_duplicates, "MOST_CELLS", 12)
    poor = made(large)
    assert poor._order().load > 30
    assert poor.blocks().count() <= 1.1 * b
    assert poor.candidates().count() <= 2 * met + 100
    assert len(found) == poor.class_pairs().count() > 200
    for nd in (whole, poor):
        nd.close()


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_prefixes_suffice(threshold):
    """Sets at the threshold or over it share as many bits of their prefixes as the operator asks for."""
    r = random.Random(7)
    for _ in range(400):
        both = r.randint(1, 60)
        a, b = (sorted({*range(0, 3 * both, 3), *(r.randrange(1, 900) for _ in range(r.randint(0, both)))}) for _ in range(2))
        common = len(set(a) & set(b))
        if common < threshold * (len(a) + len(b) - common):
            continue
        a, b = sorted((a, b), key=len)
        narrow, wide, shared = prefix_sizes(np.array([len(a), len(b)]), threshold)
        assert len(set(a[: narrow[0]]) & set(b[: wide[1]])) >= shared[0]
