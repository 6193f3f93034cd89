"""Conversation state across turns as a stateful stream operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "session_id string, msg_count bigint, last_role string, summarize_every int"
_STATE = "msg_count bigint, ids array<bigint>, lengths array<int>, roles array<string>"


def conversation_counts(messages: DataFrame, lateness: str | None = None) -> DataFrame:
    """Running message count, last role and summary threshold of each session of a stream (session_id, id, role, content, created_at).

    A row whose session and id came before is a redelivery and dropped; ids may arrive in any order, and a lower id that comes
    late counts.  Ids seen are state of their own, spread over sessions and ids; with `lateness` they are forgotten so long after created_at (rows without one are
    remembered always), and what comes later than that is dropped.  A session's own state holds the four messages with the highest ids.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, ids, lengths, roles = state.get if state.exists else (0, [], [], [])
        kept = pd.DataFrame({"id": list(ids), "length": list(lengths), "role": list(roles)})
        for batch in batches:
            count += len(batch)
            kept = pd.concat([kept, batch[["id", "length", "role"]]] if len(kept) else [batch[["id", "length", "role"]]], ignore_index=True).nlargest(4, "id")
        kept = kept.sort_values("id")
        state.update((count, [int(x) for x in kept["id"]], [int(x) for x in kept["length"]], kept["role"].tolist()))
        yield pd.DataFrame({"session_id": [key[0]], "msg_count": [count], "last_role": [kept["role"].iloc[-1]], "summarize_every": [4 if kept["length"].mean() > 800 else 8]})

    rows = messages.where("session_id is not null and id is not null").select("session_id", "id", "role", F.length(F.coalesce("content", F.lit(""))).alias("length"), F.col("created_at").cast("timestamp"))
    key, out = ["session_id", "id"], ["session_id", "id", "role", "length"]
    if lateness is None:
        once = rows.dropDuplicates(key).select(*out)
    else:
        timed = rows.where("created_at is not null").withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(key)
        once = timed.select(*out).unionByName(rows.where("created_at is null").dropDuplicates(key).select(*out))
    return once.groupBy("session_id").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
