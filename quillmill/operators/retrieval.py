"""Dense, lexical and hybrid retrieval for any number of queries in one job."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators import lexical
from quillmill.operators.nearest import VectorIndex, dense_topk

__all__ = ["VectorIndex", "dense_topk"]

# BM25 constants, boosts and blend weights.
K1, B, EPSILON = 1.5, 0.75, 0.25
SECTION_BOOST, FILENAME_BOOST = 0.10, 0.05
RERANK_WEIGHTS = (0.25, 0.75)

def top_by(df: DataFrame, partition: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each partition; Spark cuts to k rows in each task before it shuffles."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def bm25(candidates: DataFrame, queries: DataFrame, *, keys: list[str], doc_id: str, text_col: str, query_id: str = "query_id", query_text: str = "query", score: str = "sparse_score") -> DataFrame:
    """Add the Okapi BM25 score of each candidate; the corpus is the candidates of the same `keys`, query included.

    Candidates are tokenised once, and all statistics come from one table of term counts.  Query terms count with repeats, and a negative inverse document
    frequency becomes EPSILON times the mean over all distinct terms.  Candidates without words score 0.
    """
    candidates = candidates.withColumn("_t", tokens(F.col(text_col))).persist(StorageLevel.MEMORY_AND_DISK)
    docs = candidates.select(*keys, doc_id, "_t")
    sizes = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("_t")).alias("_avg"))
    tf = docs.select(*keys, doc_id, F.size("_t").alias("_len"), F.explode("_t").alias("_term")).groupBy(*keys, doc_id, "_len", "_term").agg(F.count(F.lit(1)).alias("_tf")).persist(StorageLevel.MEMORY_AND_DISK)
    df = tf.groupBy(*keys, "_term").agg(F.count(F.lit(1)).alias("_df"))
    idf = df.join(sizes, keys).withColumn("_idf", F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5))
    mean = idf.groupBy(*keys).agg(F.avg("_idf").alias("_mean"))
    # Of the terms only those that are asked for go on.
    named = queries.select(query_id, F.explode(tokens(F.col(query_text))).alias("_term")).distinct()
    idf = idf.join(named, [query_id, "_term"], "left_semi").join(mean, keys).select(*keys, "_term", "_avg", F.when(F.col("_idf") < 0, EPSILON * F.col("_mean")).otherwise(F.col("_idf")).alias("_idf"))
    asked = queries.select(query_id, F.explode(tokens(F.col(query_text))).alias("_term")).groupBy(query_id, "_term").agg(F.count(F.lit(1)).alias("_times"))
    hit = tf.join(asked, [query_id, "_term"]).join(idf, [*keys, "_term"])
    part = F.col("_times") * F.col("_idf") * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    sums = hit.groupBy(*keys, doc_id).agg(F.sum(part).alias(score))
    return candidates.drop("_t").join(sums, [*keys, doc_id], "left").withColumn(score, F.coalesce(score, F.lit(0.0)))


def _boost_words(query: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def metadata_boost(query: Column, section: Column, filename: Column) -> Column:
    """Boosts if a word of the query is part of the section path or of the file name, each in lower case."""
    words = _boost_words(query)
    inside = lambda c: F.exists(words, lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w))
    return F.when(inside(section), SECTION_BOOST).otherwise(0.0) + F.when(inside(filename), FILENAME_BOOST).otherwise(0.0)


def keep_best(df: DataFrame, partition: list[str], key: str, order: list[Column]) -> DataFrame:
    """The first row for each key; rows with a null key are all kept."""
    named = df.where(F.col(key).isNotNull())
    return top_by(named, [*partition, key], order, 1).unionByName(df.where(F.col(key).isNull()))


def candidate_scores(chunks: DataFrame, queries: DataFrame, details: DataFrame, *, k_dense: int = 30, digits: int = 6) -> DataFrame:
    """Dense candidates per collection (dense_score) with their BM25 score among the candidates of the query and collection, and their boost.

    chunks: chunk_id, collection, embedding; queries: query_id, query, query_vector; details: chunk_id, collection, text, section_path, filename.
    """
    dense = dense_topk(chunks, queries, k_dense, id_col="chunk_id", vector_col="embedding", collection="collection", digits=digits).withColumnRenamed("similarity", "dense_score")
    return lexical.scored_candidates(dense, queries, details, _boost_words(F.col("query")), k1=K1, b=B, epsilon=EPSILON, boosts=(SECTION_BOOST, FILENAME_BOOST))


def hybrid_retrieve(chunks: DataFrame, queries: DataFrame, *, k_dense: int = 30, k_final: int = 8, digits: int = 6, details: DataFrame | None = None) -> DataFrame:
    """Dense candidates per collection, BM25 over these, boosts, one ranking per query.

    chunks: chunk_id, collection, text, section_path, filename, embedding (if `details` are given, all but the embedding are taken from these); queries: query_id,
    query, query_vector.  Blank queries give nothing.  Ties in the score go to the lower collection, then chunk_id.
    """
    asked = queries.where("trim(query) <> ''")
    scored = candidate_scores(chunks, asked, chunks if details is None else details, k_dense=k_dense, digits=digits)
    total = scored.withColumn("sparse_score", F.round("sparse_score", digits)).withColumn("score", F.round(F.col("dense_score") + F.col("sparse_score") + F.col("metadata_boost"), digits))
    order = [F.desc("score"), F.asc("collection"), F.asc("chunk_id")]
    # Rows lie by query for both steps; no chunk_id is null here.
    best = top_by(top_by(total.repartition("query_id"), ["query_id", "chunk_id"], order, 1), ["query_id"], order, k_final, "rank")
    return best.select("query_id", "rank", "chunk_id", "collection", "score", "dense_score", "sparse_score", "metadata_boost")


def agent_retrieve(hits: DataFrame, *, per_collection: int = 3, keep: int = 5) -> DataFrame:
    """hits (query_id, collection, content, source, distance): nearest per collection, one per content and source, the nearest of all."""
    order = [F.asc("distance"), F.asc_nulls_first("content"), F.asc("collection")]
    near = top_by(hits, ["query_id", "collection"], order, per_collection)
    once = top_by(near, ["query_id", "content", "source"], order, 1)
    return top_by(once, ["query_id"], order, keep, "rank")


def decode_result(df: DataFrame) -> DataFrame:
    """Parallel arrays ids, documents, metadatas (maps) as rows; missing texts are "" and missing numbers 0."""
    rows = df.select(*[c for c in df.columns if c not in ("ids", "documents", "metadatas")], F.inline(F.arrays_zip("ids", "documents", "metadatas")))
    own = lambda k: F.coalesce(F.try_element_at("metadatas", F.lit(k)), F.lit(""))
    number = lambda k: F.coalesce(F.try_element_at("metadatas", F.lit(k)).cast("int"), F.lit(0))
    keep = [c for c in rows.columns if c not in ("ids", "documents", "metadatas")]
    return rows.select(*keep, F.col("ids").alias("chunk_id"), F.coalesce("documents", F.lit("")).alias("text"), own("file_hash").alias("file_hash"), own("file_path").alias("file_path"), own("filename").alias("filename"), own("doc_type").alias("doc_type"), number("chunk_index").alias("chunk_index"), number("total_chunks").alias("total_chunks"))


def rerank(hits: DataFrame, model_score: Column, *, k: int = 5, digits: int = 6) -> DataFrame:
    """Blend a retrieval score with a model's score and keep the k best of each query."""
    final = hits.withColumn("model_score", model_score).withColumn("final_score", F.round(RERANK_WEIGHTS[0] * F.col("score") + RERANK_WEIGHTS[1] * F.col("model_score"), digits))
    return top_by(final, ["query_id"], [F.desc("final_score"), F.asc("chunk_id")], k, "rank")


def hits_to_text(hits: DataFrame) -> DataFrame:
    """One text per query of its ranked hits (at most a handful each)."""
    line = F.format_string("[score=%.3f | source=%s]\n%s", F.col("distance"), F.coalesce("source", F.lit("unknown")), F.coalesce("content", F.lit("")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))


NO_HITS = "No relevant documents found for this query."


def with_fallback(queries: DataFrame, texts: DataFrame) -> DataFrame:
    return queries.select("query_id").join(texts, "query_id", "left").withColumn("text", F.coalesce("text", F.lit(NO_HITS)))


def context_block(hits: DataFrame) -> DataFrame:
    """Numbered block per query from ranked hits (rank, score, content, source, filename, page, page_number)."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    page = F.coalesce(F.col("page").cast("string"), F.col("page_number").cast("string"))
    line = F.format_string("%d. [score=%.3f | source=%s%s]\n%s", F.col("rank"), F.coalesce("score", F.lit(0.0)), F.coalesce(filled("source"), filled("filename"), F.lit("unknown")), F.coalesce(F.concat(F.lit(", page "), page), F.lit("")), F.coalesce("content", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return hits.groupBy("query_id").agg(F.array_join(F.concat(F.array(F.lit("Retrieved chunks from the retriever:")), ordered), "\n\n").alias("text"))


def chosen_query(tool_calls: Column, query: Column) -> Column:
    """The query of the first call of the retrieve tool (array of name, query), else the own one."""
    calls = F.filter(tool_calls, lambda c: c["name"] == "retrieve")
    return F.coalesce(F.when(F.size(calls) > 0, F.get(calls, 0)["query"]), query)
