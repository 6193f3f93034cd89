"""Rebuilding conversations from message rows, taken as an event log.

1. Fold: every row is an event with a version; the last version of a message stands, and a message whose last
   version is a delete is gone.  Then retries (rows equal in role as written, content and time) fold into the earliest
   delivery.  Both folds are one aggregate with map-side combine.
2. Order: by created_at, then id.  Positions and exchange numbers are running totals over globally sorted narrow rows (texts
   are stood for by their hash), so a session that holds a third of all rows is spread over tasks.
3. Validate: a conversation is a sequence of exchanges, each one human row and at least one ai row.  With
   exchange = number of human rows so far, it is whole exactly if no row has exchange 0 and every
   exchange has at least two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.plans.ordered import running_totals

#: Role names as written and what they stand for.
ROLES = {"human": "human", "user": "human", "ai": "ai", "assistant": "ai", "system": "system", "tool": "tool"}
_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def role_of(column: Column) -> Column:
    """human, ai, system or tool, or null where the role cannot be read."""
    plain = F.lower(F.regexp_replace(column, _SPACE, ""))
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.element_at(known, plain)


def fold(events: DataFrame, message: list[str], version: list[Column], first: list[str]) -> DataFrame:
    """The last state of each message: the columns of `events`, whose row with the highest `version` counts unless its `op` is a delete.

    `message` names a message; of `first` the least value over all its events stands, so that an edited message stays in its place.  Versions that tie are
    settled by op and the other columns; null versions come before all others.
    """
    rest = [c for c in events.columns if c not in (*message, *first)]
    state = F.max(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(version)), *("op" if c == "op" else c for c in sorted(rest, key=lambda c: c != "op")))).alias("s")
    folded = events.groupBy(*message).agg(state, *(F.min(c).alias(c) for c in first))
    return folded.where("s.op is null or s.op <> 'delete'").select(*message, *first, *(F.col(f"s.{c}").alias(c) for c in rest))


def as_events(log: DataFrame, version_col: str | None = None, op_col: str | None = None) -> DataFrame:
    """(session_id, id, role, content, created_at, version, op) of every row of a log.

    Without `version_col` each row is a put of its own, delivered at its time: such a log knows retries but no edits, as ids may be given again.
    """
    version = F.col(version_col) if version_col else F.col("created_at")
    op = F.lower(F.col(op_col).cast("string")) if op_col else F.lit("put")
    return log.select("session_id", "id", "role", "content", "created_at", version.alias("version"), op.alias("op"))


class Conversations:
    """Conversations of a message log with columns session_id, id, role, content, created_at.

    `sessions` (column session_id) adds sessions that may have no message.  Rows with null session_id belong
    to no session.  A session is broken if a row has no created_at or an unreadable role, or if after leaving
    out system and tool rows, blank rows and retries nothing remains, the first row is ai, or a human row is followed
    by a human row or by nothing.  Empty tables give empty results; other columns are not read.
    """

    def __init__(self, messages: DataFrame, sessions: DataFrame | None = None, version_col: str | None = None, op_col: str | None = None):
        events = as_events(messages, version_col, op_col).where("session_id is not null")
        if version_col:
            events = fold(events, ["session_id", "id"], [F.col("version")], ["created_at"])
        rows = events.withColumn("kind", role_of(F.col("role"))).withColumn("text_hash", F.md5(F.col("content")))
        named = rows.select("session_id")
        if sessions is not None:
            named = named.unionAll(sessions.select("session_id").where("session_id is not null"))
        self.sessions = named.distinct()
        self.unreadable = rows.where("created_at is null or kind is null").select("session_id").distinct()
        self._rows = rows

    def _placed(self) -> DataFrame:
        """Rows that count, without their texts: (session_id, seq, exchange, id, role, kind, created_at, text_hash)."""
        blank = F.coalesce(F.regexp_replace("content", _SPACE, ""), F.lit("")) == ""
        counted = self._rows.where(F.col("kind").isin("human", "ai") & ~blank & F.col("created_at").isNotNull()).select("session_id", "role", "text_hash", "created_at", "id", "kind", "op")
        # A retry is a later version of a message that is named by what it says; the earliest delivery keeps its place.
        once = fold(counted, ["session_id", "role", "text_hash", "created_at"], [-F.col("id")], ["id"])
        narrow = once.select("session_id", "created_at", "id", "role", "text_hash", "kind", (F.col("kind") == "human").cast("long").alias("_human"), F.lit(1).cast("long").alias("_one"))
        placed = running_totals(narrow, ["session_id"], ["created_at", "id", "role", "text_hash"], {"before": "_one", "humans": "_human"})
        return placed.select("session_id", (F.col("before") + 1).alias("seq"), (F.col("humans") + F.col("_human")).alias("exchange"), "id", "role", "kind", "created_at", "text_hash")

    def _with_texts(self, placed: DataFrame) -> DataFrame:
        """The texts of placed rows; a row's id and hash name it, so that no session is one group."""
        texts = self._rows.where("kind is not null").select("session_id", "id", "role", "created_at", "text_hash", "content")
        joined = placed.join(texts, ["session_id", "id", "role", "created_at", "text_hash"])
        once = joined.groupBy("session_id", "seq").agg(F.first(F.struct("exchange", "id", "kind", "content", "created_at")).alias("t"))
        return once.select("session_id", "seq", "t.exchange", "t.id", F.col("t.kind").alias("role"), "t.content", "t.created_at")

    def turns(self) -> DataFrame:
        """Rows that count, in order: (session_id, seq, exchange, id, role, content, created_at) of all sessions.

        seq counts from 1; exchange is the number of human rows up to this one.
        """
        return self._with_texts(self._placed())

    def _whole(self, placed: DataFrame) -> DataFrame:
        sizes = placed.groupBy("session_id", "exchange").agg(F.count(F.lit(1)).alias("n"))
        fine = (F.col("exchange") > 0) & (F.col("n") > 1)
        return sizes.groupBy("session_id").agg(F.min(fine).alias("fine")).where("fine").select("session_id").join(self.unreadable, "session_id", "left_anti")

    def whole(self) -> DataFrame:
        """(session_id) of the conversations that are complete."""
        return self._whole(self._placed())

    def broken(self) -> DataFrame:
        """(session_id) of all other sessions."""
        return self.sessions.join(self.whole(), "session_id", "left_anti")

    def conversations(self) -> DataFrame:
        """The turns of the complete conversations, one row each; order by session_id, seq."""
        placed = self._placed()
        return self._with_texts(placed.join(self._whole(placed), "session_id", "left_semi"))
