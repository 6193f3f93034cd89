"""Session and prompt-window operators over messages (session_id, id, role, content, created_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.cleaning import strip
from quillmill.plans.ordered import running_totals

ROLES = ("human", "ai", "system")
TITLE_LENGTH = 80


def known_roles(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isin(*ROLES))


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("msg_count"), F.max("created_at").alias("updated_at"), F.min("created_at").alias("created_at"))


def session_rollup(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every session of `sessions` with its true message count; of repeated rows the one updated last."""
    rest = [c for c in sessions.columns if c not in ("session_id", "updated_at", "msg_count")]
    one = sessions.where("session_id is not null").groupBy("session_id").agg(F.max(F.struct("updated_at", *rest)).alias("s")).select("session_id", "s.*")
    counts = messages.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("msg_count"))
    return one.join(counts, "session_id", "left").withColumn("msg_count", F.coalesce("msg_count", F.lit(0)).cast("bigint"))


def list_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first; a limit outside 1..100 is an error."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be in 1..100")
    return sessions.orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.asc("session_id")).limit(limit)


def session_by_id(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("session_id") == session_id)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session by id, numbered oldest first (ord from 1).

    Spark cuts to n rows per session in each task before it shuffles, so a very long session costs no more than n rows a task.
    """
    back = Window.partitionBy("session_id").orderBy(F.desc("id"), F.desc_nulls_last("created_at"), F.desc_nulls_last("content"))
    kept = messages.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n)
    size = F.max("_back").over(Window.partitionBy("session_id"))
    return kept.withColumn("ord", (size - F.col("_back") + 1).cast("int")).drop("_back")


def session_detail(sessions: DataFrame, messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages of each session in order, one row each, with the session's title; of a session's repeated rows the one updated last counts."""
    rows = last_messages(messages, limit) if limit else messages
    one = sessions.where("session_id is not null").groupBy("session_id").agg(F.max(F.struct("updated_at", "title")).alias("s")).select("session_id", "s.title")
    return one.join(rows.select("session_id", "id", "role", "content", "created_at"), "session_id")


def summarize_threshold(messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(session_id, threshold): 4 where the last four known messages are longer than 800 characters on average, else 8.

    Sessions of `sessions`, and those of which no message has a known role, have a row, too: 8.
    """
    lengths = last_messages(known_roles(messages), 4).groupBy("session_id").agg(F.avg(F.length(F.coalesce("content", F.lit("")))).alias("avg_len"))
    named = messages.select("session_id")
    named = (named if sessions is None else named.unionAll(sessions.select("session_id"))).where("session_id is not null").distinct()
    return named.join(lengths, "session_id", "left").select("session_id", F.when(F.col("avg_len") > 800, 4).otherwise(8).alias("threshold"))


def clean_title(c: Column) -> Column:
    c = F.regexp_replace(strip(c), r"^(?i:session\s*title\s*:\s*|title\s*:\s*)", "")
    c = F.regexp_replace(c, "^[\"'`]+|[\"'`]+$", "")
    c = strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.substring(F.regexp_replace(c, "^[-:;,. ]+|[-:;,. ]+$", ""), 1, TITLE_LENGTH)


def title_for(title: Column, msg_count: Column, proposed: Column) -> Column:
    """The title a session has, else a proposed one after its first message, else none."""
    return F.when(F.coalesce(title, F.lit("")) != "", title).when(msg_count == 1, clean_title(proposed)).otherwise(F.lit(""))


_NAMES = {"human": "HumanMessage", "ai": "AIMessage", "system": "SystemMessage", "tool": "ToolMessage"}


def type_name(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in _NAMES.items() for x in p)), role), role)


def window_text(messages: DataFrame, n: int, chars: int, template: str, skip_system: bool = False) -> DataFrame:
    """(session_id, text): lines of the last n messages, oldest first, each cut to `chars`; `template` is a format with the type and the content."""
    rows = last_messages(messages.where(F.col("role") != "system") if skip_system else messages, n)
    line = F.format_string(template, type_name(F.col("role")), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    ordered = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def router_window(messages: DataFrame) -> DataFrame:
    return window_text(messages, 6, 200, "[%s] %s")


def summarizer_input(messages: DataFrame) -> DataFrame:
    """What a summariser reads, one row per message so that a long session is no single row: (session_id, seq, line), to be joined by line feeds in order of seq.

    System messages and unknown roles are left out, contents cut to 400 characters.  seq counts from 1.
    """
    rows = known_roles(messages).where("role <> 'system' and session_id is not null")
    line = F.format_string("%s: %s", type_name(F.col("role")), F.substring(F.coalesce("content", F.lit("")), 1, 400))
    narrow = rows.select("session_id", "id", "created_at", line.alias("line"), F.lit(1).cast("bigint").alias("_one"))
    placed = running_totals(narrow, ["session_id"], ["id", "created_at", "line"], {"_before": "_one"})
    return placed.select("session_id", (F.col("_before") + 1).alias("seq"), "line")


def keep_last_two(messages: DataFrame) -> DataFrame:
    return last_messages(messages.where(F.col("role") != "system"), 2)


def session_state(sessions: DataFrame, messages: DataFrame, n: int = 10) -> DataFrame:
    """What a turn starts from: the summary as a system message (ord 0) where there is one, then the last n known messages."""
    recent = known_roles(last_messages(messages, n)).select("session_id", "ord", "role", "content")
    summary = sessions.where("coalesce(summary, '') <> ''").select("session_id", F.lit(0).alias("ord"), F.lit("system").alias("role"), F.col("summary").alias("content"))
    return summary.unionByName(recent)


def tools_used(before: Column, names: Column) -> Column:
    """Tool names so far and new ones except retrieve, each once, in order."""
    return F.array_distinct(F.concat(F.coalesce(before, F.array().cast("array<string>")), F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x != "retrieve")))


def prompt_messages(messages: Column, prompt: Column, summary: Column, chunks: Column) -> Column:
    """Array of (role, content): prompt, summary if any, retrieved block if any, then all messages that are not system."""
    pair = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    head = F.concat(F.array(pair("system", prompt)), F.when(F.coalesce(summary, F.lit("")) != "", F.array(pair("system", summary))).otherwise(none))
    block = F.when(F.coalesce(chunks, F.lit("")) != "", F.array(pair("human", chunks))).otherwise(none)
    joined = F.concat(head, rest)
    return F.concat(F.slice(joined, 1, 2), block, F.slice(joined, 3, F.size(joined)))


def next_node(iterations: Column, max_iterations: Column, since_summary: Column, threshold: Column, tool_calls: Column) -> Column:
    """Where a turn goes next; the iteration limit comes first."""
    first = F.get(tool_calls, 0)
    return F.when(iterations >= max_iterations, "END").when(since_summary >= threshold, "summarizer").when(first == "retrieve", "retriever").when(first.isNotNull(), "tool_executor").otherwise("END")


def entry_node(route: Column) -> Column:
    return F.when(route.isin("retrieve", "both"), "retriever").otherwise("coordinator")


def iteration_note(attempts: Column) -> Column:
    return F.when(attempts >= 3, F.format_string("retrieval limit reached after %d", attempts)).otherwise("")


def route_note(route: Column) -> Column:
    return F.when(route == "direct", "no tools").when(route.isin("external", "both"), "prefer the most specific tool").otherwise("")


def answer_of(result: Column) -> Column:
    """The answer of a turn: content of the last message, else text, else answer; blank gives null."""
    last = F.get(result["messages"], F.size(result["messages"]) - 1)["content"]
    filled = lambda c: F.when(strip(c) != "", c)
    return F.coalesce(filled(last), filled(result["text"]), filled(result["answer"]))
