"""The queries of the core operators, each over its whole tables, and DuckDB statements for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill import operator_queries
from quillmill.functions import chunking, cleaning, payload
from quillmill.functions.embedding import embed_texts, plan_batches
from quillmill.functions.vectors import l2_normalize
from quillmill.operators import retrieval, sessions, state
from quillmill.plans.spread import spread
from quillmill.sources import files
from quillmill.streaming.windows import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- dense retrieval -------------------------------------------------------------------------------------------------

_PAIRS = """select q.vec_id as query_id, e.label, e.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 6) + 0.0 as similarity
from embeddings q, embeddings e where q.vec_id % 50 = 0 and len(e.embedding) = len(q.embedding)"""
_TOP3 = f"select * from ({_PAIRS}) qualify row_number() over (partition by query_id, label order by similarity desc, vec_id) <= 3"


def _label_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.dense_topk(e, queries, 3, id_col="vec_id", vector_col="embedding", collection="label")


@_query(_TOP3)
def dense_topk(spark, sf_dir):
    return _label_hits(spark, sf_dir).select("query_id", "label", "vec_id", "similarity")


@_query(f"select query_id, label, vec_id, similarity, row_number() over (partition by query_id order by similarity desc, label, vec_id)::int as rank from ({_TOP3}) qualify rank <= 5")
def merged_topk(spark, sf_dir):
    return retrieval.top_by(_label_hits(spark, sf_dir), ["query_id"], [F.desc("similarity"), F.asc("label"), F.asc("vec_id")], 5, "rank").select("query_id", "label", "vec_id", "similarity", "rank")


@_query(f"""with h as (select query_id, cast(vec_id % 100 as varchar) as content, label, round(1 - similarity, 6) as distance from ({_TOP3})),
once as (select * from h qualify row_number() over (partition by query_id, content order by distance, content, label) = 1)
select query_id, content, label as collection, distance, row_number() over (partition by query_id order by distance, content, label)::int as rank from once qualify rank <= 5""")
def agent_retrieve(spark, sf_dir):
    hits = _label_hits(spark, sf_dir).select("query_id", F.col("label").alias("collection"), (F.col("vec_id") % 100).cast("string").alias("content"), F.lit(None).cast("string").alias("source"), F.round(1 - F.col("similarity"), 6).alias("distance"))
    return retrieval.agent_retrieve(hits).select("query_id", "content", "collection", "distance", "rank")


@_query(f"select query_id, vec_id, similarity from ({_PAIRS}) qualify row_number() over (partition by query_id order by similarity desc, vec_id) <= 3")
def index_topk(spark, sf_dir):
    """The index with all its cells visited: every row is in it, so the result is exact."""
    e = _t(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.VectorIndex(e, id_col="vec_id", vector_col="embedding", cells=16).topk(queries, 3, probes=16)


@_query("""select vec_id, i::int as pos, round(x / n, 6) + 0.0 as value from (select vec_id, unnest(v) as x, generate_subscripts(v, 1) - 1 as i, n from
(select vec_id, list_transform(embedding, lambda y: cast(y as double) * 3) as v, sqrt(list_sum(list_transform(embedding, lambda y: (cast(y as double) * 3) ** 2))) as n from embeddings))""")
def l2_normalized(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").withColumn("v", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3))
    return e.select("vec_id", F.posexplode(l2_normalize(F.col("v"))).alias("pos", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


# --- lexical and hybrid retrieval -------------------------------------------------------------------------------------

_CORPUS = """select cast(d.doc_id as varchar) as chunk_id, d.collection, d.text, d.source as section_path, d.source || '/' || d.doc_id || '.' || d.doc_type as filename, cast(e.embedding as double[]) as v
from documents d join embeddings e on d.doc_id = e.vec_id where d.collection is not null"""
_ASKED = """select d.doc_id as query_id, d.text as query, cast(e.embedding as double[]) as v from documents d join embeddings e on d.doc_id = e.vec_id where d.doc_id % 50 = 0 and trim(d.text) <> ''"""
_HYBRID = f"""corpus as materialized ({_CORPUS}), asked as materialized ({_ASKED}),
dense as materialized (select query_id, chunk_id, collection, text, section_path, filename, query, round(list_cosine_similarity(a.v, c.v), 6) as dense_score from corpus c, asked a
  qualify row_number() over (partition by query_id, collection order by dense_score desc, chunk_id) <= 30),
toks as (select query_id, collection, chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') as t from dense),
sizes as (select query_id, collection, count(*) as n, avg(len(t)) as avgdl from toks group by all),
tf as (select query_id, collection, chunk_id, dl, term, count(*) as tf from (select query_id, collection, chunk_id, len(t) as dl, unnest(t) as term from toks) group by all),
df as (select query_id, collection, term, count(*) as df from tf group by all),
idf as (select df.*, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) as raw from df join sizes using (query_id, collection)),
mean as (select query_id, collection, avg(raw) as m from idf group by all),
qt as (select query_id, term, count(*) as times from (select query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) as term from asked) group by all),
sparse as (select tf.query_id, tf.collection, tf.chunk_id, sum(times * (case when raw < 0 then 0.25 * m else raw end) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as s
  from tf join qt using (query_id, term) join idf using (query_id, collection, term) join mean using (query_id, collection) group by all),
scored as (select d.*, round(coalesce(s, 0.0), 6) as sparse_score,
  (case when len(list_filter(regexp_extract_all(lower(query), '\\S+'), lambda w: contains(lower(coalesce(section_path, '')), w))) > 0 then 0.10 else 0.0 end
  + case when len(list_filter(regexp_extract_all(lower(query), '\\S+'), lambda w: contains(lower(coalesce(filename, '')), w))) > 0 then 0.05 else 0.0 end)::double as metadata_boost
  from dense d left join sparse using (query_id, collection, chunk_id))"""


#: Ids of vectors that are broadcast at most, to find the documents that have none without moving texts.
_FEW_IDS = 1 << 20


def _hybrid_inputs(spark: SparkSession, sf_dir: str, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, questions and texts of the documents that have a vector or, with `every`, of all: those without one get the stand-in's."""
    d, e = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    details = d.where("collection is not null").select(F.col("doc_id").cast("string").alias("chunk_id"), "collection", "text", F.col("source").alias("section_path"), F.expr("source || '/' || doc_id || '.' || doc_type").alias("filename"))
    narrow = ["doc_id", "collection", F.expr("case when doc_id % 50 = 0 and trim(text) <> '' then text end").alias("query")]
    columns = ["doc_id", "collection", "query", "embedding"]
    both = d.select(*narrow).join(e.where("size(embedding) > 0") if every else e, F.col("doc_id") == F.col("vec_id")).select(*columns)
    if every:
        ids = e.where("size(embedding) > 0").select("vec_id")
        missing = d.join(F.broadcast(ids) if ids.count() <= _FEW_IDS else ids, F.col("doc_id") == F.col("vec_id"), "left_anti").select(*narrow, "text")
        both = both.unionByName(embed_texts(missing, "text", batch_size=64).select(*columns)).persist(StorageLevel.MEMORY_AND_DISK)
    corpus = both.where("collection is not null").select(F.col("doc_id").cast("string").alias("chunk_id"), "collection", "embedding")
    asked = both.where("query is not null").select(F.col("doc_id").alias("query_id"), "query", F.col("embedding").alias("query_vector"))
    return corpus, asked, details


@_query(f"""with {_HYBRID} select query_id, (row_number() over (partition by query_id order by score desc, collection, chunk_id))::int as rank, chunk_id, collection, score, dense_score, sparse_score, metadata_boost
from (select *, round(dense_score + sparse_score + metadata_boost, 6) as score from scored) qualify rank <= 8""")
def hybrid_retrieve(spark, sf_dir):
    corpus, asked, details = _hybrid_inputs(spark, sf_dir)
    return retrieval.hybrid_retrieve(corpus, asked, details=details)


@_query(f"with {_HYBRID} select query_id, collection, chunk_id, sparse_score from scored")
def bm25_scores(spark, sf_dir):
    return _bm25_scores(*_hybrid_inputs(spark, sf_dir))


@_query()
def hybrid_retrieve_all(spark, sf_dir):
    """hybrid_retrieve over every document, whether or not it has a vector."""
    corpus, asked, details = _hybrid_inputs(spark, sf_dir, every=True)
    return retrieval.hybrid_retrieve(corpus, asked, details=details)


@_query()
def bm25_scores_all(spark, sf_dir):
    """bm25_scores over every document, whether or not it has a vector."""
    return _bm25_scores(*_hybrid_inputs(spark, sf_dir, every=True))


def _bm25_scores(corpus: DataFrame, asked: DataFrame, details: DataFrame) -> DataFrame:
    # The names of files and sections tell nothing here.
    texts = details.withColumns({c: F.lit(None).cast("string") for c in ("section_path", "filename")})
    return retrieval.candidate_scores(corpus, asked, texts).select("query_id", "collection", "chunk_id", F.round("sparse_score", 6).alias("sparse_score"))


@_query(f"""select query_id, vec_id, similarity as score, model_score, round(0.25 * similarity + 0.75 * model_score, 8) as final_score,
row_number() over (partition by query_id order by round(0.25 * similarity + 0.75 * model_score, 8) desc, vec_id)::int as rank from (select *, round(((vec_id * 37) % 101) / 101.0, 6)::double as model_score from ({_TOP3})) qualify rank <= 5""")
def rerank_blend(spark, sf_dir):
    hits = _label_hits(spark, sf_dir).select("query_id", "vec_id", F.col("vec_id").alias("chunk_id"), F.col("similarity").alias("score"))
    return retrieval.rerank(hits, F.round(((F.col("vec_id") * 37) % 101) / 101.0, 6), digits=8).select("query_id", "vec_id", "score", "model_score", "final_score", "rank")


@_query("select doc_id, term, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) as term from documents) group by all")
def tokenize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(retrieval.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@_query("""select chunk_id, max((case when len(list_filter(w, lambda x: contains(lower(coalesce(section_path, '')), x))) > 0 then 0.10 else 0.0 end + case when len(list_filter(w, lambda x: contains(lower(coalesce(filename, '')), x))) > 0 then 0.05 else 0.0 end)::double) as boost
from (select *, regexp_extract_all(lower('Setup of the rooftop sensor'), '\\S+') as w from chunks) group by chunk_id""")
def metadata_boost(spark, sf_dir):
    return _t(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.max(retrieval.metadata_boost(F.lit("Setup of the rooftop sensor"), F.col("section_path"), F.col("filename"))).alias("boost"))


# --- sources, identity, state -----------------------------------------------------------------------------------------


@_query("select doc_id, sha256(text) as hash from documents")
def content_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("hash"))


@_query("select sha256(text) as hash, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by sha256(text)")
def dedup_by_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2(F.col("text"), 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@_query("""select file_path, file_hash, coalesce(nullif(lower(regexp_replace(regexp_replace(case when contains(b, '/') then split_part(b, '/', 1) else '' end, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')), ''), 'documents') as collection, lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) as ext
from (select file_path, file_hash, regexp_extract(file_path, '^/data/inbox/+(.*)$', 1) as b from raw_documents)""")
def collection_route(spark, sf_dir):
    path = F.col("file_path")
    return _t(spark, sf_dir, "raw_documents").select("file_path", "file_hash", files.collection_for(path, "/data/inbox").alias("collection"), files.extension(path).alias("ext"))


@_query("select distinct collection from chunks where collection is not null")
def collections(spark, sf_dir):
    return files.collections(_t(spark, sf_dir, "chunks"))


_LATEST = """select * from ingestion_state qualify row_number() over (partition by file_path, file_hash order by last_attempt desc nulls last, attempt_count desc nulls last,
case status when 'done' then 3 when 'failed' then 2 when 'processing' then 1 else 0 end desc, status desc nulls last, error_msg desc nulls last, chunk_count desc nulls last) = 1"""


@_query(f"select file_path, file_hash, status, attempt_count, last_attempt::timestamp as last_attempt, error_msg, chunk_count from ({_LATEST})")
def state_latest(spark, sf_dir):
    return state.latest_state(_t(spark, sf_dir, "ingestion_state")).select("file_path", "file_hash", "status", "attempt_count", F.col("last_attempt"), "error_msg", "chunk_count")


@_query(f"select status, count(*) as n from ({_LATEST}) group by status")
def status_counts(spark, sf_dir):
    return state.status_counts(state.latest_state(_t(spark, sf_dir, "ingestion_state")))


@_query(f"select file_path, file_hash, attempt_count from ({_LATEST}) where status = 'failed' and attempt_count < 3")
def failed_for_retry(spark, sf_dir):
    return state.failed_for_retry(state.latest_state(_t(spark, sf_dir, "ingestion_state")))


@_query(f"select file_path, file_hash from raw_documents r where not exists (select 1 from ({_LATEST}) s where s.status = 'done' and s.file_hash = r.file_hash)")
def not_ingested(spark, sf_dir):
    return state.not_ingested(_t(spark, sf_dir, "raw_documents").select("file_path", "file_hash"), state.latest_state(_t(spark, sf_dir, "ingestion_state"))).select("file_path", "file_hash")


@_query("select collection, count(*) as chunks from chunks group by collection")
def collection_counts(spark, sf_dir):
    return state.collection_counts(_t(spark, sf_dir, "chunks"))


@_query("select count(*) as records from chunks")
def total_records(spark, sf_dir):
    return state.total_records(_t(spark, sf_dir, "chunks"))


_SPLIT = "timestamp '2025-06-01 00:00:00'"


@_query(f"""with o as (select chunk_id, max(chunk_index) as chunk_index, max(extracted_at) as extracted_at from chunks where extracted_at < {_SPLIT} group by chunk_id),
n as (select chunk_id, min(chunk_index) as chunk_index, arg_min(extracted_at, (chunk_index, extracted_at)) as extracted_at from chunks where extracted_at >= {_SPLIT} group by chunk_id)
select chunk_id, chunk_index, extracted_at from o where chunk_id not in (select chunk_id from n) union all select chunk_id, chunk_index, extracted_at from n""")
def chunk_upsert(spark, sf_dir):
    c = _t(spark, sf_dir, "chunks").select("chunk_id", "chunk_index", "extracted_at")
    old = c.where("extracted_at < '2025-06-01'").groupBy("chunk_id").agg(F.max("chunk_index").alias("chunk_index"), F.max("extracted_at").alias("extracted_at"))
    return state.upsert(old, c.where("extracted_at >= '2025-06-01'"), ["chunk_id"], ["chunk_index", "extracted_at"])


@_query("select file_hash, batch_no, count(*) as items, sum(target_tokens)::bigint as tokens from (select file_hash, target_tokens, floor((row_number() over (partition by file_hash order by chunk_index, chunk_id, extracted_at) - 1) / 4)::bigint as batch_no from chunks) group by all")
def batch_plan(spark, sf_dir):
    return plan_batches(_t(spark, sf_dir, "chunks"), ["file_hash"], ["chunk_index", "chunk_id", "extracted_at"], "target_tokens", 4)


# --- cleaning ---------------------------------------------------------------------------------------------------------


@_query("select doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') as text from documents")
def clean_control(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", cleaning.drop_control_chars(F.col("text")).alias("text"))


@_query("select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '`([^`\\n]+)`', '\\1', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') as text from documents")
def clean_collapse(spark, sf_dir):
    c = cleaning.drop_html_comments(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", cleaning.collapse_newlines(cleaning.collapse_blanks(cleaning.unwrap_inline_code(c))).alias("text"))


_RAW_LINES = "select file_path, file_hash, (line_no - 1)::int as line_no, l from (select file_path, file_hash, extracted_at, unnest(string_split(raw_text, chr(10))) as l, generate_subscripts(string_split(raw_text, chr(10)), 1) as line_no from raw_documents where raw_text is not null)"
_BARE = "regexp_replace(l, '^[\\s\\x{85}\\p{Z}]+|[\\s\\x{85}\\p{Z}]+$', '', 'g')"


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "raw_documents").where("raw_text is not null")
    return r.select("file_path", "file_hash", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "l"))


@_query(f"""select file_path, file_hash, line_no, (length(b) >= 6 and ((a = 0 and n >= 4) or (n >= 8 and a <= 2) or (p >= 2 and a <= 3) or regexp_matches(b, '^[-=*_#~|+ ]*$'))) as art,
regexp_matches(b, '^(=\\s*){{4,}}=$|^(-\\s*){{4,}}-$|^(_\\s*){{4,}}_$|^(\\*\\s*){{4,}}\\*$|^(#\\s*){{4,}}#$|^(~\\s*){{4,}}~$') as separator
from (select *, length(regexp_replace(b, '[^\\p{{L}}\\p{{N}}]', '', 'g')) as a, length(regexp_replace(b, '[^|/\\\\+\\-=_*#<>:^~\\[\\](){{}}]', '', 'g')) as n, length(regexp_replace(b, '[^|]', '', 'g')) as p from (select *, {_BARE} as b from ({_RAW_LINES})))""")
def drop_ascii_art(spark, sf_dir):
    return _raw_lines(spark, sf_dir).select("file_path", "file_hash", "line_no", cleaning.is_ascii_art(F.col("l")).alias("art"), cleaning.is_separator(F.col("l")).alias("separator"))


@_query(f"""select file_path, file_hash, line_no, case when contains(l, '|') and len(c) > 0 then array_to_string(c, ' | ') else l end as text from (select *, list_filter(list_transform(string_split(regexp_replace({_BARE}, '^\\|+|\\|+$', '', 'g'), '|'), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> '') as c from ({_RAW_LINES}))""")
def table_rows(spark, sf_dir):
    return _raw_lines(spark, sf_dir).select("file_path", "file_hash", "line_no", cleaning.table_row(F.col("l")).alias("text"))


@_query()
def clean_full(spark, sf_dir):
    return spread(_t(spark, sf_dir, "raw_documents")).select("file_path", "file_hash", cleaning.clean(F.col("raw_text")).alias("text"))


# --- chunking ---------------------------------------------------------------------------------------------------------

_WORD = "[^\\s\\x1c-\\x1f\\x{85}\\p{Z}]+"


@_query(f"select doc_id, (case when coalesce(text, '') = '' then 0 else greatest(1, len(regexp_extract_all(text, '{_WORD}'))) end)::int as tokens from documents")
def token_len(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", chunking.token_len(F.col("text")).alias("tokens"))


@_query("""select doc_id, len(s)::int as sentences, md5(array_to_string(s, '¦')) as digest from (select doc_id, string_split(regexp_replace(text, '([.!?。！？])[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+', '\\1' || chr(1), 'g'), chr(1)) as s from documents where text is not null)""")
def sentences(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", chunking.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "¦")).alias("digest"))


@_query(f"""select doc_id, i::int as window_no, array_to_string(w[i * 260 + 1 : i * 260 + 300], ' ') as text from (select doc_id, regexp_extract_all(text, '{_WORD}') as w from documents where text is not null), lateral (select unnest(range(0, ((len(w) - 1) // 260 + 1)::bigint)) as i) where len(w) > 0""")
def word_windows(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(chunking.word_windows(F.col("text"), 300, 40)).alias("window_no", "text"))


@_query("select chunk_id, chunk_index, extracted_at, left(sha256(coalesce(file_hash, '') || '::' || coalesce(section_path, '') || '::' || coalesce(text, '')), 32) as computed from chunks")
def chunk_ids(spark, sf_dir):
    return _t(spark, sf_dir, "chunks").select("chunk_id", "chunk_index", "extracted_at", chunking.chunk_id(F.col("file_hash"), F.col("section_path"), F.col("text")).alias("computed"))


@_query()
def chunk_documents(spark, sf_dir):
    r = spread(_t(spark, sf_dir, "raw_documents")).withColumn("text", cleaning.clean(F.col("raw_text")))
    return chunking.chunk_documents(r).select("chunk_id", "file_hash", "chunk_index", "total_chunks", "section_path", "text")


# --- sessions and prompts ---------------------------------------------------------------------------------------------

_ONE_SESSION = "select session_id, max(updated_at) as updated_at, arg_max(title, (updated_at, title, summary, created_at)) as title, arg_max(created_at, (updated_at, title, summary, created_at)) as created_at from sessions where session_id is not null group by session_id"
_BACK = "row_number() over (partition by session_id order by id desc, created_at desc nulls last, content desc nulls last)"


@_query("""with one as (select session_id, max(updated_at) as updated_at from sessions where session_id is not null group by session_id), n as (select session_id, count(*) as msg_count from messages where session_id is not null group by session_id)
select session_id, updated_at, coalesce(msg_count, 0)::bigint as msg_count from one left join n using (session_id)""")
def session_rollup(spark, sf_dir):
    return sessions.session_rollup(_t(spark, sf_dir, "messages"), _t(spark, sf_dir, "sessions")).select("session_id", "updated_at", "msg_count")


@_query("select session_id, max(updated_at) as updated_at, max(created_at) as created_at from sessions where session_id is not null group by session_id order by 2 desc nulls last, 3 desc nulls last, 1 limit 20")
def list_sessions(spark, sf_dir):
    one = _t(spark, sf_dir, "sessions").where("session_id is not null").groupBy("session_id").agg(F.max("updated_at").alias("updated_at"), F.max("created_at").alias("created_at"))
    return sessions.list_sessions(one)


@_query("select m.session_id, s.title, m.id, m.role, m.content, m.created_at from (select session_id, max((updated_at, title)) as s, arg_max(title, (updated_at, title)) as title from (select session_id, coalesce(updated_at, timestamp '0001-01-01') as updated_at, coalesce(title, '') as title from sessions where session_id is not null) group by session_id) s join messages m on s.session_id = m.session_id")
def session_detail(spark, sf_dir):
    s = _t(spark, sf_dir, "sessions").select("session_id", F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("updated_at"), F.coalesce("title", F.lit("")).alias("title"))
    return sessions.session_detail(s, _t(spark, sf_dir, "messages")).select("session_id", "title", "id", "role", "content", "created_at")


@_query(f"select session_id, id, role, content, (max(b) over (partition by session_id) - b + 1)::int as ord from (select *, {_BACK} as b from messages) where b <= 10")
def recent_messages(spark, sf_dir):
    return sessions.last_messages(_t(spark, sf_dir, "messages"), 10).select("session_id", "id", "role", "content", "ord")


@_query(f"""select session_id, (case when n > 800 then 4 else 8 end)::int as threshold from (select session_id from sessions where session_id is not null union select session_id from messages where session_id is not null)
left join (select session_id, avg(length(coalesce(content, ''))) as n from (select *, {_BACK} as b from messages where role in ('human', 'ai', 'system')) where b <= 4 group by session_id) using (session_id)""")
def summarize_threshold(spark, sf_dir):
    return sessions.summarize_threshold(_t(spark, sf_dir, "messages"), _t(spark, sf_dir, "sessions"))


@_query("""select distinct session_id, left(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim('Title: "' || coalesce(title, '') || '".'), '^(?i:session\\s*title\\s*:\\s*|title\\s*:\\s*)', ''), '^["''`]+|["''`]+$', '', 'g'), '\\s+', ' ', 'g')), '^[-:;,. ]+|[-:;,. ]+$', '', 'g'), 80) as title from sessions""")
def clean_title(spark, sf_dir):
    return _t(spark, sf_dir, "sessions").select("session_id", sessions.clean_title(F.concat(F.lit('Title: "'), F.coalesce("title", F.lit("")), F.lit('".'))).alias("title")).distinct()


@_query(f"""select session_id, string_agg('[' || coalesce(case role when 'human' then 'HumanMessage' when 'ai' then 'AIMessage' when 'system' then 'SystemMessage' when 'tool' then 'ToolMessage' else role end, 'null') || '] ' || left(coalesce(content, ''), 200), chr(10) order by b desc) as text from (select *, {_BACK} as b from messages where session_id is not null) where b <= 6 group by session_id""")
def router_window(spark, sf_dir):
    return sessions.router_window(_t(spark, sf_dir, "messages").where("session_id is not null"))


@_query(f"select session_id, id, role, content, (max(b) over (partition by session_id) - b + 1)::int as ord from (select *, {_BACK} as b from messages where role <> 'system') where b <= 2")
def keep_last_two(spark, sf_dir):
    return sessions.keep_last_two(_t(spark, sf_dir, "messages")).select("session_id", "id", "role", "content", "ord")


@_query("""select id, coalesce(session_id, '') as session, case when id % 6 >= 5 then 'END' when id % 9 >= 8 then 'summarizer' when role = 'tool' then 'retriever' when role = 'ai' then 'tool_executor' else 'END' end as node,
case when role in ('human', 'tool') then 'retriever' else 'coordinator' end as entry from messages""")
def next_node(spark, sf_dir):
    calls = F.when(F.col("role") == "tool", F.array(F.lit("retrieve"))).when(F.col("role") == "ai", F.array(F.lit("search"), F.lit("retrieve"))).otherwise(F.array().cast("array<string>"))
    route = F.when(F.col("role") == "human", "both").when(F.col("role") == "tool", "retrieve").otherwise("direct")
    return _t(spark, sf_dir, "messages").select("id", F.coalesce("session_id", F.lit("")).alias("session"), sessions.next_node(F.col("id") % 6, F.lit(5), F.col("id") % 9, F.lit(8), calls).alias("node"), sessions.entry_node(route).alias("entry"))


# --- payloads ---------------------------------------------------------------------------------------------------------


@_query("""select doc_id, concat_ws(chr(10), nullif(trim(source), ''), nullif(trim(lang), ''), 'Source: ' || nullif(trim(doc_type), '')) as text from documents""")
def format_mapping(spark, sf_dir):
    entry = F.to_json(F.struct(F.col("source").alias("title"), F.col("lang").alias("answer"), F.col("doc_type").alias("url"), F.lit(payload.UNAVAILABLE + " x").alias("page_content"), F.col("source").alias("snippet")))
    return _t(spark, sf_dir, "documents").select("doc_id", payload.format_mapping(entry).alias("text"))


@_query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def json_path(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", payload.json_path(F.col("props"), "$.k", "int").alias("k"))


@_query("select id, content as text from messages where role = 'human' and regexp_matches(content, '^[A-Za-z].*\\S$')")
def payload_texts(spark, sf_dir):
    m = _t(spark, sf_dir, "messages").where((F.col("role") == "human") & F.col("content").rlike(r"^[A-Za-z].*\S$"))
    wrapped = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("content")))
    return m.select("id", F.explode(payload.payload_texts(wrapped)).alias("text"))


@_query()
def payload_texts_all(spark, sf_dir):
    """The texts of every message, of any role, its content taken as it is: SQL cannot state the decoding."""
    return _t(spark, sf_dir, "messages").select("id", F.posexplode(payload.payload_texts(F.col("content"))).alias("pos", "text"))


@_query()
def html_text(spark, sf_dir):
    return _t(spark, sf_dir, "raw_documents").where("lower(doc_type) = 'html'").select("file_path", "file_hash", files.html_text(F.col("raw_text")).alias("text"))


# --- an extension: event-time windows ---------------------------------------------------------------------------------


@_query("select date_trunc('hour', ts)::timestamp as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, sf_dir):
    return windowed_counts(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


def queries() -> dict[str, Query]:
    return _QUERIES | operator_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | operator_queries.SQL
