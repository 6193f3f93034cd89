"""Embedding behind a function: order-preserving batches, retries, a deterministic offline stand-in."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
import warnings
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.ordered import running_totals

# Seconds waited before each try.
DELAYS = (0, 2, 5, 10)
#: Words whose hash the stand-in keeps at most.
KNOWN_WORDS = 1 << 16
#: Texts whose vectors a task holds at once.
ROWS_AT_ONCE = 1 << 10

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hash_embedder(dimensions: int = 64) -> Embedder:
    """A stand-in for a model: every word moves one coordinate chosen by its hash."""
    known: dict[str, tuple[int, float]] = {}

    def move(word: str) -> tuple[int, float]:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        if len(known) >= KNOWN_WORDS:
            known.clear()
        known[word] = found = h % dimensions, 1.0 if h >> 63 else -1.0
        return found

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * dimensions
            for word in text.lower().split():
                at, by = known.get(word) or move(word)
                vector[at] += by
            length = sum(x * x for x in vector) ** 0.5
            out.append([x / length for x in vector] if length else vector)
        return out

    return embed


def http_embedder(url: str, model: str, timeout: float = 60.0) -> Embedder:
    """Vectors of a service that answers {"model", "input": [texts]} with {"embeddings": [vectors]} (the published form of local model servers)."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": list(texts)}).encode("utf-8", "replace")
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)["embeddings"]

    return embed


def sentence_embedder(model: str) -> Embedder:
    """A sentence-transformers model, loaded once in each worker, where that package is installed."""
    loaded: list = []

    def embed(texts: Sequence[str]) -> list[list[float]]:
        if not loaded:
            from sentence_transformers import SentenceTransformer

            loaded.append(SentenceTransformer(model))
        return loaded[0].encode(list(texts), normalize_embeddings=True).tolist()

    return embed


#: Embedders by name, made from the options given; further ones may be added.
EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hash": hash_embedder, "ollama": http_embedder, "huggingface": sentence_embedder}
DEFAULT_EMBEDDER = "hash"


def embedder_named(name: str, **options) -> Embedder:
    """The embedder of that name; an unknown name is warned of and takes the default."""
    if name not in EMBEDDERS:
        warnings.warn(f"unknown embedder {name!r}; {DEFAULT_EMBEDDER!r} is used", stacklevel=2)
        return EMBEDDERS[DEFAULT_EMBEDDER]()
    return EMBEDDERS[name](**options)


def embed_with_retries(embed: Embedder, texts: Sequence[str], delays: Sequence[float] = DELAYS) -> list[list[float]]:
    """Vectors in the order of the texts; tried once for each delay, the count checked each time."""
    last: Exception | None = None
    for delay in delays:
        time.sleep(delay)
        try:
            vectors = [list(map(float, v)) for v in embed(texts)]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            return vectors
        except Exception as error:  # noqa: BLE001 - any failure of the service is tried again
            last = error
    raise RuntimeError("embedding failed") from last


def embed_texts(df: DataFrame, text_col: str, out_col: str = "embedding", embed: Embedder | None = None, batch_size: int = 1, delays: Sequence[float] = DELAYS) -> DataFrame:
    """Add a unit vector of each text; null texts count as empty.  Concurrency is the number of tasks."""
    embed = embed or hash_embedder()
    rows = df.drop(out_col)
    at = rows.columns.index(text_col)
    # Few rows at once: vectors are lists of numbers until they are handed on.
    step = max(batch_size, ROWS_AT_ONCE // batch_size * batch_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                unit = []
                for i in range(0, len(texts), batch_size):
                    for v in embed_with_retries(embed, texts[i : i + batch_size], delays):
                        length = sum(x * x for x in v) ** 0.5
                        unit.append([x / length for x in v] if length else v)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit, pa.list_(pa.float32()))], [*batch.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out_col}` array<float>"
    return rows.mapInArrow(run, schema)


def plan_batches(df: DataFrame, partition: list[str], order: list[str], tokens: str, size: int) -> DataFrame:
    """Batches of `size` rows within each partition: (partition, batch_no, items, tokens).  A partition of very many rows is spread over tasks."""
    narrow = df.select(*dict.fromkeys([*partition, *order]), F.col(tokens).alias("_tokens"), F.lit(1).cast("bigint").alias("_one"))
    placed = running_totals(narrow, partition, order, {"_place": "_one"})
    return placed.withColumn("batch_no", F.floor(F.col("_place") / size).cast("bigint")).groupBy(*partition, "batch_no").agg(F.count(F.lit(1)).alias("items"), F.sum("_tokens").alias("tokens"))
