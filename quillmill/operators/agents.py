"""Model calls behind functions: routing, generation and tools, with deterministic offline stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.sessions import list_sessions, session_by_id, session_detail
from quillmill.operators.state import collection_counts, latest_state, status_counts

ROUTES = ("retrieve", "external", "both", "direct")

Model = Callable[[list[str]], list[str]]


def keyword_router(questions: list[str]) -> list[str]:
    """A stand-in for a model: greetings are answered directly, news from outside, all else is retrieved."""
    out = []
    for q in questions:
        words = set(q.lower().split())
        outside, inside = bool(words & {"news", "today", "weather", "latest"}), bool(words & {"document", "documents", "handbook", "manual", "policy"})
        out.append("both" if outside and inside else "external" if outside else "direct" if words and words <= {"hi", "hello", "thanks", "thank", "you", "ok"} else "retrieve")
    return out


def echo_model(prompts: list[str]) -> list[str]:
    """A stand-in for a chat model: the last line of the prompt."""
    return [(p.strip().splitlines() or [""])[-1] for p in prompts]


#: Models by purpose; a deployment puts its own in.
MODELS: dict[str, Model] = {"router": keyword_router, "coordinator": echo_model, "summarizer": echo_model, "title": echo_model}


def call_model(df: DataFrame, prompt_col: str, out_col: str, model: Model) -> DataFrame:
    """Add the model's answer to each prompt, a call for each Arrow batch; null prompts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = model(batch[prompt_col].fillna("").tolist())
            if len(answers) != len(batch):
                raise ValueError("one answer for each prompt is needed")
            yield batch.assign(**{out_col: answers})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out_col) + f", `{out_col}` string"
    return df.drop(out_col).mapInPandas(run, schema)


def route(df: DataFrame, question_col: str, model: Model | None = None) -> DataFrame:
    """Add `route`; an answer that is no route counts as retrieve."""
    out = call_model(df, question_col, "route", model or MODELS["router"])
    return out.withColumn("route", F.when(F.col("route").isin(*ROUTES), F.col("route")).otherwise("retrieve"))


class Tools:
    """Column functions by name."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[Callable[[Column], Column], str]] = {}

    def add(self, name: str, f: Callable[[Column], Column], description: str = "") -> None:
        self._known[name] = (f, description)

    def names(self) -> list[str]:
        return list(self._known)

    def apply(self, name: Column, argument: Column) -> Column:
        """The result of the named tool; null for an unknown one."""
        out = F.lit(None).cast("string")
        for known, (f, _) in self._known.items():
            out = F.when(name == known, f(argument)).otherwise(out)
        return out


class Service:
    """What the service's end points answer, as DataFrames."""

    def __init__(self, sessions: DataFrame, messages: DataFrame, chunks: DataFrame, events: DataFrame):
        self.sessions, self.messages, self.chunks, self.events = sessions, messages, chunks, events

    def health(self) -> tuple[DataFrame, DataFrame]:
        return status_counts(latest_state(self.events)), collection_counts(self.chunks)

    def list(self, limit: int = 20) -> DataFrame:
        return list_sessions(self.sessions, limit)

    def get(self, session_id: str, limit: int | None = None) -> DataFrame:
        """Messages of one session in order; a KeyError if there is none."""
        one = session_by_id(self.sessions, session_id)
        if one.isEmpty():
            raise KeyError(session_id)
        return session_detail(one, self.messages.where(F.col("session_id") == session_id), limit).orderBy("id")

    @staticmethod
    def valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Requests with a message, and those to reject."""
        good = F.length(F.coalesce("message", F.lit(""))) >= 1
        return requests.where(good), requests.where(~good)
