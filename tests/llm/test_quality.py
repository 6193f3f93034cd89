import regex as re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm.irep import induce, to_case
from quillmill.llm.line_features import Lines, line_table, statistics, word_hashes
from quillmill.llm.quality import line_features, line_labels, prose_rules, prose_shares, text_statistics
from quillmill.llm.quality_samples import labelled_texts

COMMON = "the of and to in is a for that with on be has have been was it not if are we by an as at der die das und den ist von mit le la les de et en est que el los y con por no se и в на не с по i w z na od".split()


def test_rules_are_found():
    r = np.random.default_rng(1)
    a, b = r.random(3000), r.random(3000)
    y = (a > 0.7) | ((b < 0.2) & (a < 0.3))
    rules = induce({"a": a, "b": b}, y)
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= rule.holds({"a": a, "b": b})
    assert (hit == y).mean() > 0.98
    assert to_case(rules).startswith("CASE WHEN ") and to_case([]) == "FALSE"
    assert induce({"a": a}, np.zeros(3000)) == []


def test_held_out_accuracy(spark):
    """Texts made from another seed: most words are labelled rightly, headings told from prose and from lists."""
    samples = labelled_texts(250, seed=99)
    df = spark.createDataFrame([(i, t) for i, t, _ in samples], "rid int, text string")
    rows = line_labels(df, "text", COMMON).toPandas()
    y = []
    table = line_table([t for _, t, _ in samples], word_hashes(COMMON))
    for text, line in zip(table["text"], table["line"]):
        y.append(samples[text][2][line])
    order = rows.sort_values("rid", kind="stable")
    guess = np.where(order.heading, 2, order.other.astype(int))
    right = (guess == np.array(y)) * order.word_count
    assert right.sum() / order.word_count.sum() > 0.97


def _slow(text: str, common: set[str]) -> dict[str, list[int]]:
    """Some features line by line with regular expressions."""
    out: dict[str, list[int]] = {k: [] for k in ("words", "commas", "code", "sentences", "glue", "pairs", "bars", "marker")}
    for line in text.split("\n"):
        if not line.strip():
            continue
        out["words"].append(len(line.split()))
        out["commas"].append(sum(line.count(c) for c in ",;"))
        out["code"].append(sum(line.count(c) for c in "={}[]<_"))
        out["sentences"].append(len(re.findall(r"""(?<=[^\W_]|[%”»’")])[.!?…。！？]["”»)’]*(?=\s*$|\s+["“«(¿¡—]*\p{Lu})""", line)))
        out["glue"].append(sum(w in common for w in re.findall(r"[^\W_]+", line.lower())))
        out["pairs"].append(line.count(": "))
        out["marker"].append(int(bool(re.match(r"\s*(?:[-*•▪◦‣·+|├└│]|[(]?[0-9]{1,3}[.)](?:\s|$)|[(]?[A-Za-z][.)](?:\s|$))", line))))
    return out


def test_counts_equal_a_plain_reading():
    texts = [t for _, t, _ in labelled_texts(60, seed=5)] + ["", "  \n\t", "one", "(a) x\n12) y\n1234) z\na. b", 'He said "go." Then left.)\n... ..!', "x" * 5000 + ".)))))" * 400 + " A", "####\n#\n# t", "«Да.» Нет; é,è"]
    common = set(COMMON)
    got = line_table(texts, word_hashes(COMMON))
    x = Lines(texts)
    seen = x.words > 0
    markers = x.markers()[seen]
    for i, text in enumerate(texts):
        mine, want = got["text"] == i, _slow(text, common)
        words = got["words"][mine]
        assert words.tolist() == want["words"]
        for name in ("commas", "code", "sentences", "glue", "pairs"):
            assert np.round(got[f"f_{name}"][mine] * words).astype(int).tolist() == want[name], (name, text)
        assert markers[mine].astype(int).tolist() == want["marker"]


def test_shares(spark):
    prose = "The pump is loud because nobody has oiled it. We told the owner that it must be fixed before the next shift starts.\n"
    listing = "\n".join(f"- old pump x {i}" for i in range(30))
    rows = [("p", "Document: a.md\nSection: Pumps\n\n" + prose * 3), ("l", listing), ("m", prose + "\n" + listing), ("t", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"), ("n", None), ("e", ""), ("b", " \n\t"), ("h", "# Only a heading"), ("p", "Document: a.md\nSection: Pumps\n\n" + prose * 3), ("w", "word " * 20_000)]
    df = spark.createDataFrame(rows, "k string, text string").withColumn("words", F.lit(0)).withColumn("f_words", F.lit("x"))
    got = {r.k: r for r in prose_shares(df, ["k"], "text", COMMON).collect()}
    assert got["p"].is_prose and not got["l"].is_prose and not got["m"].is_prose and not got["t"].is_prose
    assert set(got) == {"p", "l", "m", "t", "w"}
    assert line_features(df.select("k", "text").limit(0), "text", COMMON).count() == 0
    assert prose_shares(df.select(F.col("k").alias("word_count"), "text"), ["word_count"], "text", []).count() == 5
    assert prose_rules([])[1]


def test_statistics(spark):
    df = spark.createDataFrame([(0, "The cat, sat.\nno end\n\n"), (1, ""), (2, None), (3, "　! "), (4, "Is it «the»?»)\n)))\n(no) THE the-no")], "i int, t string")
    rows = {r.i: tuple(r)[1:] for r in text_statistics(df, "t", ["the", "no"]).collect()}
    assert rows[0] == (5, 3.2, round(2 / 16, 6), 0.5, 0.4)
    assert rows[1] == rows[2] == (0, None, None, None, None)
    assert rows[3][0] == 1 and rows[3][2] == 1.0
    assert rows[4][0] == 7 and rows[4][3] == pytest.approx(1 / 3, abs=1e-6) and rows[4][4] == pytest.approx(3 / 7, abs=1e-6)
    assert statistics([], word_hashes([]))["words"].tolist() == []
