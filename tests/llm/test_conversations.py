import datetime
import random

from quillmill.llm.conversations import ROLES, Conversations

SCHEMA = "session_id string, id long, role string, content string, created_at timestamp"
START = datetime.datetime(2024, 1, 1)


def log(seed=2):
    r = random.Random(seed)
    rows = []
    for s in range(60):
        at = START
        for _ in range(r.randint(0, 9) if s else 400):
            at += datetime.timedelta(seconds=r.randint(0, 2))
            role = r.choice(["human", "ai", "ai", " User", "assistant ", "system", "TOOL"]) if s % 3 else ("human" if len(rows) % 2 else "ai")
            rows.append((f"s{s}", len(rows), role, r.choice(["x", "y", "z", "  ", None]) if s % 5 == 0 else f"m{len(rows)}", at))
            if r.random() < 0.1:
                rows.append((rows[-1][0], r.choice([rows[-1][1], 5000 + len(rows)]), *rows[-1][2:]))
    rows += [("bad", 9000, "nobody", "x", START), ("late", 9001, "human", "x", None), (None, 9002, "human", "x", START), ("none", 9003, None, "x", START)]
    r.shuffle(rows)
    return rows


def brute(rows, sessions):
    out = set()
    for s in {x[0] for x in rows} | set(sessions):
        if s is None:
            continue
        own = sorted((x for x in rows if x[0] == s), key=lambda x: (x[4] or START, x[1], x[2] or "", x[3] or ""))
        kinds = [ROLES.get((x[2] or "").strip().lower()) for x in own]
        bad = any(k is None or x[4] is None for k, x in zip(kinds, own))
        seen, kept = set(), []
        for k, x in zip(kinds, own):
            if k in ("human", "ai") and (x[3] or "").strip() and x[2:] not in seen:
                seen.add(x[2:])
                kept.append(k)
        broken = not kept or kept[0] == "ai" or any(a == "human" and b == "human" for a, b in zip(kept, [*kept[1:], "human"]))
        if bad or broken:
            out.add(s)
    return out


def test_broken_sessions(spark):
    rows = log()
    sessions = spark.createDataFrame([("s1",), ("unheard",), (None,)], "session_id string")
    c = Conversations(spark.createDataFrame(rows, SCHEMA).repartition(6), sessions)
    broken = {r.session_id for r in c.broken().collect()}
    assert broken == brute(rows, ["s1", "unheard"])
    turns = c.conversations().orderBy("session_id", "seq").collect()
    assert {t.session_id for t in turns}.isdisjoint(broken) and turns
    for s in {t.session_id for t in turns}:
        own = [t for t in turns if t.session_id == s]
        assert [t.seq for t in own] == list(range(1, len(own) + 1))
        assert own[0].role == "human" and own[-1].role == "ai" and own[-1].exchange == sum(t.role == "human" for t in own)


def test_versions_fold(spark):
    at = [START + datetime.timedelta(seconds=i) for i in range(6)]
    rows = [("s", 1, "human", "draft", at[0], 1, "create"), ("s", 1, "human", "final", at[4], 2, "edit"), ("s", 2, "ai", "gone", at[1], 1, "create"), ("s", 2, "ai", None, at[5], 2, "Delete"), ("s", 3, "ai", "kept", at[2], None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", version int, op string")
    got = Conversations(df, version_col="version", op_col="op").conversations().orderBy("seq").collect()
    assert [(t.role, t.content) for t in got] == [("human", "final"), ("ai", "kept")]


def test_empty(spark):
    c = Conversations(spark.createDataFrame([], SCHEMA + ", kind int, seq int, before int"))
    assert c.broken().count() == 0 and c.conversations().count() == 0
