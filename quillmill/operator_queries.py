"""Queries of single operators over whole tables, with DuckDB statements for the same results."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import chunking, cleaning, payload
from quillmill.functions.embedding import embed_texts
from quillmill.operators import retrieval, sessions, state
from quillmill.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# White space as Python has it, inside a bracket expression.
_W = "\\s\\x1c-\\x1f\\x0b\\x{85}\\p{Z}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def _rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{_W}]+$', '')"


# --- sources and sinks ------------------------------------------------------------------------------------------------


@_query("select file_path, file_hash, lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) in ('pdf', 'docx', 'txt', 'md', 'html', 'csv') as supported from raw_documents")
def supported_files(spark, sf_dir):
    return _t(spark, sf_dir, "raw_documents").select("file_path", "file_hash", files.supported(F.col("file_path")).alias("supported"))


@_query("""select file_path, file_hash, case lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) when 'pdf' then 'application/pdf' when 'docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' when 'txt' then 'text/plain'
when 'md' then 'text/markdown' when 'html' then 'text/html' when 'csv' then 'text/csv' else 'application/octet-stream' end as mime_type from raw_documents""")
def mime_types(spark, sf_dir):
    return _t(spark, sf_dir, "raw_documents").select("file_path", "file_hash", files.mime_type(files.extension(F.col("file_path"))).alias("mime_type"))


@_query("""with r as (select user_id::varchar as file_path, event_id as reading_no, floor(value / 100)::bigint as length from events where value is not null),
n as (select *, row_number() over (partition by file_path order by reading_no) as k from r qualify k <= 4),
g as (select *, sum(fresh) over (partition by file_path order by reading_no) as run from (select *, case when length = lag(length) over (partition by file_path order by reading_no) then 0 else 1 end as fresh from n))
select distinct file_path from (select file_path, run, count(*) as same from g group by all) where same > 2""")
def stable_files(spark, sf_dir):
    readings = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_path"), F.col("event_id").alias("reading_no"), F.floor(F.col("value") / 100).cast("bigint").alias("length"))
    return files.stable_files(readings, 2)


@_query("select chunk_id, extracted_at, chunk_index, file_path, coalesce(filename, 'none') || case when coalesce(text, '') = '' then '' else chr(10) || text end as text from chunks")
def html_pages(spark, sf_dir):
    """Texts put into pages with a script, a menu and a comment, and read out again."""
    c = _t(spark, sf_dir, "chunks")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("filename", F.lit("none")), F.lit("</title><script>if (a < b) {}</script></head><body><nav>Home</nav><!-- note --><p>"), safe, F.lit("</p><footer>end</footer></body></html>"))
    return c.select("chunk_id", "extracted_at", "chunk_index", "file_path", files.html_text(page).alias("text"))


@_query("select doc_id, text || chr(65533) || 'z' as text from documents")
def plain_bytes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", files.plain_text(F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF7A")))).alias("text"))


@_query("select p_partkey, concat_ws(' | ', 'p_partkey: ' || p_partkey, 'p_name: ' || nullif(p_name, ''), 'p_brand: ' || nullif(p_brand, ''), 'p_type: ' || nullif(p_type, ''), 'p_size: ' || p_size, 'p_retailprice: ' || cast(p_retailprice as decimal(12, 2))) as text from part")
def csv_all_columns(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(12,2)"))
    return p.select("p_partkey", files.csv_text(p, p.columns).alias("text"))


@_query("select collection, count(*) as chunks from chunks where collection in ('operations', 'training', 'none such') group by collection")
def chosen_collections(spark, sf_dir):
    wanted = files.configured_collections(" operations, training,,none such ")
    return state.collection_counts(_t(spark, sf_dir, "chunks").where(F.col("collection").isin(wanted)))


@_query("select chunk_id, chunk_index, extracted_at, file_hash from chunks where file_hash is null or file_hash not in (select file_hash from raw_documents where lower(doc_type) = 'pdf' and file_hash is not null)")
def delete_files(spark, sf_dir):
    gone = _t(spark, sf_dir, "raw_documents").where("lower(doc_type) = 'pdf'")
    return sinks.without_files(_t(spark, sf_dir, "chunks"), gone).select("chunk_id", "chunk_index", "extracted_at", "file_hash")


_NEW_FROM = "timestamp '2025-06-01 00:00:00'"


@_query(f"""with one as (select session_id, max(updated_at) as updated_at, max(msg_count) as msg_count from sessions where session_id is not null group by session_id),
n as (select session_id, count(*) as n, max(created_at) as at_ from messages where session_id is not null and created_at >= {_NEW_FROM} group by session_id)
select session_id, (coalesce(msg_count, 0) + coalesce(n, 0))::bigint as msg_count, case when at_ is null then updated_at when updated_at is null then at_ else greatest(updated_at, at_) end as updated_at from one left join n using (session_id)""")
def message_append(spark, sf_dir):
    one = _t(spark, sf_dir, "sessions").where("session_id is not null").groupBy("session_id").agg(F.max("updated_at").alias("updated_at"), F.max("msg_count").alias("msg_count"))
    m = _t(spark, sf_dir, "messages")
    return sinks.append_messages(one, m.where("created_at < '2025-06-01' or created_at is null"), m.where("created_at >= '2025-06-01'"))[0].select("session_id", "msg_count", "updated_at")


@_query("select session_id, arg_max(title, (updated_at, title)) as title, max(updated_at) as updated_at from sessions where session_id is not null and title is not null and updated_at is not null group by session_id")
def title_updates(spark, sf_dir):
    events = _t(spark, sf_dir, "sessions").where("title is not null and updated_at is not null").select("session_id", "title", F.col("updated_at").alias("at"))
    return sinks.last_values(events, "title")


@_query("select session_id, count(*) as n from (select session_id from sessions where session_id is not null union all select distinct session_id from messages m where session_id is not null and not exists (select 1 from sessions s where s.session_id = m.session_id)) group by session_id")
def session_insert(spark, sf_dir):
    old = _t(spark, sf_dir, "sessions").where("session_id is not null").select("session_id")
    return sinks.add_sessions(old, _t(spark, sf_dir, "messages").select("session_id")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@_query("select session_id, updated_at, title, 'en' as lang, 0 as pinned from sessions")
def column_migration(spark, sf_dir):
    return sinks.with_columns(_t(spark, sf_dir, "sessions"), {"title": "none", "lang": "en", "pinned": 0}).select("session_id", "updated_at", "title", "lang", "pinned")


# --- cleaning ---------------------------------------------------------------------------------------------------------


def _pages(x: str) -> str:
    return f"regexp_replace({x}, '(?m)^[{_W}]*[-–—]?[{_W}]*\\p{{Nd}}+[{_W}]*[-–—]?[{_W}]*$', '', 'g')"


def _wrapped(x: str) -> str:
    """Line feeds behind a stop and white space are hidden while the others are looked at."""
    return f"replace(regexp_replace(regexp_replace({x}, '([.!?:][{_W}])\\n', '\\1' || chr(1), 'g'), '\\n([a-z])', ' \\1', 'g'), chr(1), chr(10))"


@_query(f"select file_path, file_hash, {_pages('raw_text')} as text from raw_documents")
def page_numbers(spark, sf_dir):
    return _t(spark, sf_dir, "raw_documents").select("file_path", "file_hash", cleaning.drop_page_numbers(F.col("raw_text")).alias("text"))


@_query(f"select file_path, file_hash, {_wrapped('raw_text')} as text from raw_documents")
def wrapped_lines(spark, sf_dir):
    return _t(spark, sf_dir, "raw_documents").select("file_path", "file_hash", cleaning.join_wrapped_lines(F.col("raw_text")).alias("text"))


@_query(f"select file_path, file_hash, {_strip(f'''array_to_string(list_transform(string_split(raw_text, chr(10)), lambda x: {_rstrip('x')}), chr(10))''')} as text from raw_documents where raw_text is not null")
def trimmed_lines(spark, sf_dir):
    return _t(spark, sf_dir, "raw_documents").where("raw_text is not null").select("file_path", "file_hash", cleaning.trim_lines(F.col("raw_text")).alias("text"))


@_query(f"select doc_id, 'Intro' || chr(10) || 'CODE_BLOCK py' || chr(10) || regexp_replace(text, '^\\n+|\\n+$', '', 'g') || chr(10) || 'END_CODE_BLOCK' || chr(10) || 'and' || chr(10) || 'TILDE_BLOCK' || chr(10) || regexp_replace(coalesce(source, 'none'), '^\\n+|\\n+$', '', 'g') || chr(10) || 'END_TILDE_BLOCK' || chr(10) as text from documents where text not like '%`%' and text not like '%~%'")
def code_blocks(spark, sf_dir):
    """Texts in a fence of back-ticks and sources in one of tildes; texts that hold such signs themselves are left out."""
    d = _t(spark, sf_dir, "documents").where("text not like '%`%' and text not like '%~%'")
    fenced = F.concat(F.lit("Intro```  py \n"), "text", F.lit("\n```and~~~\n"), F.coalesce("source", F.lit("none")), F.lit("\n~~~"))
    return d.select("doc_id", cleaning.keep_code_blocks(fenced).alias("text"))



def _flat_lines(t: str) -> str:
    """flatten_tables, line by line."""
    lines = f"string_split(regexp_replace({t}, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10))"
    kept = f"list_filter(list_transform({lines}, lambda x: {_rstrip('x')}), lambda x: x = '' or not regexp_matches(x, '^[{_W}]*\\|?([{_W}]*:?-{{3,}}:?[{_W}]*\\|)+[{_W}]*:?-{{3,}}:?[{_W}]*\\|?[{_W}]*$'))"
    bare = f"regexp_replace({_strip('x')}, '^\\|+|\\|+$', '', 'g')"
    cells = f"list_filter(list_transform(string_split({bare}, '|'), lambda y: {_strip('y')}), lambda y: y <> '')"
    rows = f"list_transform({kept}, lambda x: case when contains(x, '|') and len({cells}) > 0 then array_to_string({cells}, ' | ') else x end)"
    letters, pipes = "length(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))", "length(regexp_replace(x, '[^|]', '', 'g'))"
    noise = "length(regexp_replace(x, '[^|/\\\\+\\-=_*#<>:^~\\[\\](){}]', '', 'g'))"
    drawn = f"length({_strip('x')}) >= 6 and (({letters} = 0 and {noise} >= 4) or ({noise} >= 8 and {letters} <= 2) or ({pipes} >= 2 and {letters} <= 3) or regexp_matches({_strip('x')}, '^[-=*_#~|+ ]*$'))"
    same = "|".join(f"{c}([{_W}]*{c}){{4,}}" for c in ("=", "-", "_", "\\*", "#", "~"))
    return f"array_to_string(list_filter({rows}, lambda x: x = '' or not (({drawn}) or regexp_matches(x, '^[{_W}]*({same})[{_W}]*$'))), chr(10))"


_NO_NOTES = "regexp_replace(raw_text, '(?s)<!--.*?-->', '', 'g')"
_NO_CONTROL = f"regexp_replace({_NO_NOTES}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
_PLAIN = f"regexp_replace({_NO_CONTROL}, '`([^`\\n]+)`', '\\1', 'g')"


@_query(f"""with a as materialized (select file_path, file_hash, {_wrapped(_pages(_PLAIN))} as t from raw_documents where raw_text not like '%```%' and raw_text not like '%~~~%'),
b as (select file_path, file_hash, {_flat_lines('t')} as t from a)
select file_path, file_hash, {_strip("regexp_replace(regexp_replace(t, '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} as text from b""")
def clean_plain(spark, sf_dir):
    """The whole pipeline but for Unicode normalisation, which SQL lacks; texts with code fences have a query of their own."""
    r = _t(spark, sf_dir, "raw_documents").where("raw_text not like '%```%' and raw_text not like '%~~~%'")
    return r.select("file_path", "file_hash", cleaning.clean(F.col("raw_text"), normalize=False).alias("text"))


# --- chunking ---------------------------------------------------------------------------------------------------------

_HEADING = "'^(#{1,6})[\\s\\p{Z}]+(.+?)[\\s\\p{Z}]*$'"


@_query(f"""with r as (select distinct file_path, file_hash, extracted_at, raw_text from raw_documents where raw_text is not null and not regexp_matches(raw_text, '[\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')),
l as materialized (select file_path, file_hash, extracted_at, unnest(string_split(raw_text, chr(10))) as line, generate_subscripts(string_split(raw_text, chr(10)), 1) as n from r),
k as materialized (select *, regexp_matches(line, {_HEADING}) as head, sum(regexp_matches(line, {_HEADING})::int) over (partition by file_path, file_hash, extracted_at order by n) as part from l),
h as (select file_path, file_hash, extracted_at, list([length(regexp_extract(line, {_HEADING}, 1))::varchar, {_strip(f"regexp_extract(line, {_HEADING}, 2)")}] order by n) as hs from k where head group by all),
b as (select file_path, file_hash, extracted_at, part, {_strip("string_agg(line, chr(10) order by n) filter (not head)")} as body from k group by all),
s as (select b.file_path, b.file_hash, b.extracted_at, b.part, coalesce(b.body, '') as body, case when hs is null or part = 0 then '' else array_to_string(list_reduce(list_prepend([]::varchar[], hs[1 : part::bigint]), lambda a, x: list_append(a[1 : x[1]::bigint - 1], x[2])), ' > ') end as path
  from b left join h on h.file_path is not distinct from b.file_path and h.file_hash is not distinct from b.file_hash and h.extracted_at is not distinct from b.extracted_at),
f as (select *, count(*) over (partition by file_path, file_hash, extracted_at) as whole from s where body <> '')
select file_path, file_hash, (row_number() over (partition by file_path, file_hash, extracted_at order by part) - 1)::int as section_no, path, md5(body) as digest from f""")
def sections(spark, sf_dir):
    """Sections with a body; texts of headings only, of which the table has none, are left to the tests."""
    r = _t(spark, sf_dir, "raw_documents").where("raw_text is not null").where(~F.col("raw_text").rlike("[\r\x0b\x0c\x1c-\x1e\x85  ]"))
    once = r.select("file_path", "file_hash", "extracted_at", "raw_text").distinct()
    return once.select("file_path", "file_hash", F.posexplode(chunking.sections(F.col("raw_text"))).alias("section_no", "s")).select("file_path", "file_hash", "section_no", "s.path", F.md5("s.body").alias("digest"))


@_query(f"""select file_path, file_hash, (i - 1)::int as block_no, b[i] as block from (select file_path, file_hash, list_filter(list_transform(string_split(regexp_replace(raw_text, '\\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') as b from raw_documents where raw_text is not null), lateral (select unnest(range(1, len(b) + 1)) as i)""")
def blocks(spark, sf_dir):
    return _t(spark, sf_dir, "raw_documents").where("raw_text is not null").select("file_path", "file_hash", F.posexplode(chunking.blocks(F.col("raw_text"))).alias("block_no", "block"))


_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(coalesce({_strip('text')}, ''), '([.!?。！？])[{_W}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"


@_query(f"""select doc_id, case when len(s) = 0 then '' else array_to_string(s[len(s) - greatest(1, len(list_filter(range(1, len(s) + 1), lambda k: list_sum(n[len(s) - k + 1 : len(s)]) <= 40))) + 1 : len(s)], ' ') end as tail
from (select doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '[^{_W}]+'))) as n from (select doc_id, {_SENTENCES} as s from documents))""")
def overlap_tails(spark, sf_dir):
    @F.arrow_udf("string")
    def tail(texts: pa.Array) -> pa.Array:
        return pa.array([chunking.overlap_tail(t or "", 40) for t in texts.to_pylist()], pa.string())

    return _t(spark, sf_dir, "documents").select("doc_id", tail(F.col("text")).alias("tail"))


@_query("select doc_id, tokens from (select doc_id, (case when coalesce(text, '') = '' then 0 else greatest(1, len(regexp_extract_all(text, '[^" + _W + "]+'))) end)::int as tokens from documents) where tokens > 512")
def over_limit(spark, sf_dir):
    return chunking.over_limit(_t(spark, sf_dir, "documents")).select("doc_id", "tokens")


@_query(f"""select chunk_id, chunk_index, extracted_at, file_path, 'Document: ' || filename || case when coalesce(section_path, '') <> '' then chr(10) || 'Section: ' || section_path else '' end as prefix from chunks where filename is not null""")
def context_prefix(spark, sf_dir):
    return _t(spark, sf_dir, "chunks").where("filename is not null").select("chunk_id", "chunk_index", "extracted_at", "file_path", chunking.context_prefix(F.col("filename"), F.col("section_path")).alias("prefix"))


@_query(f"""with d as materialized (select doc_id, list_distinct(regexp_extract_all(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, {_HEADING})), chr(10)), '[^{_W}]+')) as w from documents where text is not null and not regexp_matches(text, '[\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'))
select doc_id, len(w)::int as distinct_words, true as fits, true as numbered from d where len(w) > 0""")
def chunk_coverage(spark, sf_dir):
    """What must hold of chunks: no word of a body is lost or made up, none measures more than the limit, and numbers run from 0 without gaps."""
    d = _t(spark, sf_dir, "documents").where("text is not null").where(~F.col("text").rlike("[\r\x0b\x0c\x1c-\x1e\x85  ]"))
    made = chunking.chunk_documents(d.select(F.col("doc_id").cast("string").alias("file_hash"), F.lit("p").alias("file_path"), F.lit("f").alias("filename"), "doc_type", "text"))
    body = F.regexp_replace("text", r"(?s)^Document: f(\nSection: [^\n]*)?\n\n", "")
    own = made.select("file_hash", "chunk_index", "total_chunks", (chunking.token_len(F.col("text")) <= 512).alias("fits"), F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))).alias("w"))
    words = own.select("file_hash", F.explode("w").alias("word")).groupBy("file_hash").agg(F.countDistinct("word").cast("int").alias("distinct_words"))
    facts = own.groupBy("file_hash").agg(F.min("fits").alias("fits"), ((F.min("chunk_index") == 0) & (F.max("chunk_index") == F.count(F.lit(1)) - 1) & (F.min("total_chunks") == F.count(F.lit(1)))).alias("numbered"))
    return words.join(facts, "file_hash").select(F.col("file_hash").cast("bigint").alias("doc_id"), "distinct_words", "fits", "numbered")


# --- embedding --------------------------------------------------------------------------------------------------------


@_query("select doc_id, length(coalesce(text, '')) as ratio, 1.0::double as norm from documents")
def embedded_lengths(spark, sf_dir):
    """Texts through the embedding boundary with a model whose vectors are (length, 1), made unit vectors: their direction and length are looked at."""
    e = embed_texts(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", embed=lambda texts: [[float(len(t)), 1.0] for t in texts], batch_size=32)
    x, y = (F.col("embedding")[k].cast("double") for k in range(2))
    return e.select("doc_id", F.round(x / y).cast("bigint").alias("ratio"), F.round(x * x + y * y, 3).alias("norm"))


# --- retrieval: results and texts -------------------------------------------------------------------------------------


@_query("""select chunk_id as query_id, chunk_index as n, extracted_at, chunk_id, coalesce(text, '') as text, coalesce(file_hash, '') as file_hash, '' as file_path, coalesce(filename, '') as filename, coalesce(doc_type, '') as doc_type, coalesce(chunk_index, 0) as chunk_index, 0 as total_chunks from chunks""")
def decoded_results(spark, sf_dir):
    c = _t(spark, sf_dir, "chunks")
    meta = F.map_filter(F.create_map(*(x for k in ("file_hash", "filename", "doc_type") for x in (F.lit(k), F.col(k))), F.lit("chunk_index"), F.col("chunk_index").cast("string")), lambda k, v: v.isNotNull())
    packed = c.select(F.col("chunk_id").alias("query_id"), F.col("chunk_index").alias("n"), "extracted_at", F.array("chunk_id").alias("ids"), F.array("text").alias("documents"), F.array(meta).alias("metadatas"))
    return retrieval.decode_result(packed)


_SESSION_HITS = """select session_id as query_id, row_number() over (partition by session_id order by id, created_at nulls first, content nulls first)::int as rank, content, role from messages where session_id is not null qualify rank <= 3"""


def _session_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _t(spark, sf_dir, "messages").where("session_id is not null").select(F.col("session_id").alias("query_id"), "id", "created_at", "content", "role")
    return retrieval.top_by(m, ["query_id"], [F.asc("id"), F.asc_nulls_first("created_at"), F.asc_nulls_first("content")], 3, "rank")


@_query(f"""select query_id, coalesce(text, 'No relevant documents found for this query.') as text from (select session_id as query_id from sessions where session_id is not null union select session_id from messages where session_id is not null) left join
(select query_id, string_agg('[score=' || printf('%.3f', rank / 4.0) || ' | source=' || coalesce(role, 'unknown') || ']' || chr(10) || coalesce(content, ''), chr(10) || chr(10) order by rank) as text from ({_SESSION_HITS}) group by query_id) using (query_id)""")
def hits_text(spark, sf_dir):
    hits = _session_hits(spark, sf_dir).select("query_id", "rank", (F.col("rank") / 4.0).alias("distance"), "content", F.col("role").alias("source"))
    asked = _t(spark, sf_dir, "sessions").select("session_id").union(_t(spark, sf_dir, "messages").select("session_id")).where("session_id is not null").distinct()
    return retrieval.with_fallback(asked.select(F.col("session_id").alias("query_id")), retrieval.hits_to_text(hits))


@_query(f"""select query_id, 'Retrieved chunks from the retriever:' || chr(10) || chr(10) || string_agg(rank || '. [score=' || printf('%.3f', rank / 8.0) || ' | source=' || coalesce(nullif(role, ''), 'unknown') || ', page ' || rank || ']' || chr(10) || coalesce(content, ''), chr(10) || chr(10) order by rank) as text from ({_SESSION_HITS}) group by query_id""")
def context_blocks(spark, sf_dir):
    hits = _session_hits(spark, sf_dir).select("query_id", "rank", (F.col("rank") / 8.0).alias("score"), "content", F.lit("").alias("source"), F.col("role").alias("filename"), F.lit(None).cast("int").alias("page"), F.col("rank").alias("page_number"))
    return retrieval.context_block(hits)


@_query("select session_id, id, role, created_at, case when role = 'tool' then 'asked: ' || coalesce(session_id, '') else content end as query from messages")
def query_override(spark, sf_dir):
    m = _t(spark, sf_dir, "messages")
    call = lambda name, q: F.struct(F.lit(name).alias("name"), q.alias("query"))
    calls = F.when(F.col("role") == "tool", F.array(call("search", F.lit("other")), call("retrieve", F.concat(F.lit("asked: "), F.coalesce("session_id", F.lit("")))), call("retrieve", F.lit("later")))).otherwise(F.array(call("search", F.lit("other"))))
    return m.select("session_id", "id", "role", "created_at", retrieval.chosen_query(calls, F.col("content")).alias("query"))


# --- sessions and prompts ---------------------------------------------------------------------------------------------

_BACK = "row_number() over (partition by session_id order by id desc, created_at desc nulls last, content desc nulls last)"
_ONE = "select session_id, max(summary) as summary, max(title) as title, max(msg_count) as msg_count from sessions where session_id is not null group by session_id"


def _one_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "sessions").where("session_id is not null").groupBy("session_id").agg(*(F.max(c).alias(c) for c in ("summary", "title", "msg_count")))


@_query("select session_id, title, msg_count, updated_at from sessions where session_id = (select min(session_id) from sessions)")
def session_by_id(spark, sf_dir):
    s = _t(spark, sf_dir, "sessions")
    return sessions.session_by_id(s, s.agg(F.min("session_id")).first()[0]).select("session_id", "title", "msg_count", "updated_at")


@_query(f"""select session_id, 0 as ord, 'system' as role, summary as content from ({_ONE}) where coalesce(summary, '') <> '' union all
select session_id, ord, role, content from (select *, (max(b) over (partition by session_id) - b + 1)::int as ord from (select *, {_BACK} as b from messages) where b <= 10) where role in ('human', 'ai', 'system')""")
def session_state(spark, sf_dir):
    return sessions.session_state(_one_session(spark, sf_dir), _t(spark, sf_dir, "messages")).select("session_id", "ord", "role", "content")


@_query(f"""select session_id, case when coalesce(title, '') <> '' then title when msg_count = 1 then left('About ' || session_id, 80) else '' end as title from ({_ONE})""")
def title_choice(spark, sf_dir):
    return _one_session(spark, sf_dir).select("session_id", sessions.title_for(F.col("title"), F.col("msg_count"), F.concat(F.lit('Title: "About '), "session_id", F.lit('"'))).alias("title"))


@_query("""select session_id, row_number() over (partition by session_id order by id, created_at nulls first, line) as seq, line from (select session_id, id, created_at, case role when 'human' then 'HumanMessage' else 'AIMessage' end || ': ' || left(coalesce(content, ''), 400) as line from messages where role in ('human', 'ai') and session_id is not null)""")
def summarizer_lines(spark, sf_dir):
    return sessions.summarizer_input(_t(spark, sf_dir, "messages"))


@_query("""select session_id, id, role, created_at, content, array_to_string(list_filter(['search', case when role = 'ai' then 'search' when role = 'tool' then 'lookup' end], lambda x: x is not null)[1 : case when role = 'tool' then 2 else 1 end], ',') as tools from messages""")
def tools_used(spark, sf_dir):
    names = F.when(F.col("role") == "ai", F.array(F.lit("retrieve"), F.lit("search"))).when(F.col("role") == "tool", F.array(F.lit("lookup"), F.lit("retrieve"), F.lit("lookup")))
    return _t(spark, sf_dir, "messages").select("session_id", "id", "role", "created_at", "content", F.array_join(sessions.tools_used(F.array(F.lit("search")), names), ",").alias("tools"))


@_query(f"""with k as (select session_id, list(role || '=' || coalesce(content, '') order by ord) as m from (select *, (max(b) over (partition by session_id) - b + 1)::int as ord from (select *, {_BACK} as b from messages where session_id is not null) where b <= 10) where role is not null and role <> 'system' group by session_id),
j as (select k.session_id, list_concat(list_concat(['system=p'], case when coalesce(summary, '') <> '' then ['system=' || summary] else [] end), m) as h from k left join ({_ONE}) o using (session_id))
select session_id, array_to_string(list_concat(list_concat(h[1 : 2], ['human=block']), h[3 :]), chr(10)) as text from j""")
def prompt_order(spark, sf_dir):
    m = sessions.last_messages(_t(spark, sf_dir, "messages").where("session_id is not null"), 10).where("role is not null")
    packed = m.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "role", F.coalesce("content", F.lit("")).alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    both = packed.where(F.exists("m", lambda x: x["role"] != "system")).join(_one_session(spark, sf_dir), "session_id", "left")
    out = sessions.prompt_messages(F.col("m"), F.lit("p"), F.col("summary"), F.lit("block"))
    return both.select("session_id", F.array_join(F.transform(out, lambda x: F.concat(x["role"], F.lit("="), x["content"])), "\n").alias("text"))


@_query("select session_id, id, role, created_at, content, case when id % 5 >= 3 then 'retrieval limit reached after ' || (id % 5) else '' end as note, case when role = 'human' then 'no tools' when role = 'tool' then 'prefer the most specific tool' else '' end as hint from messages")
def notes(spark, sf_dir):
    route = F.when(F.col("role") == "human", "direct").when(F.col("role") == "tool", "both").otherwise("retrieve")
    return _t(spark, sf_dir, "messages").select("session_id", "id", "role", "created_at", "content", sessions.iteration_note(F.col("id") % 5).alias("note"), sessions.route_note(route).alias("hint"))


@_query(f"select session_id, id, role, created_at, content, case when {_strip('''coalesce(content, '')''')} <> '' then content when role = 'tool' then 'from text' else 'from answer' end as answer from messages")
def answers(spark, sf_dir):
    m = _t(spark, sf_dir, "messages")
    first = F.struct(F.lit("question").alias("content"))
    result = F.struct(F.array(first, F.struct("content")).alias("messages"), F.when(F.col("role") == "tool", "from text").otherwise(" ").alias("text"), F.lit("from answer").alias("answer"))
    return m.select("session_id", "id", "role", "created_at", "content", sessions.answer_of(result).alias("answer"))


# --- payloads ---------------------------------------------------------------------------------------------------------


@_query(f"select session_id, id, role, created_at, content, {_strip('''('x ' || coalesce(content, ''))''')} as text from messages")
def payload_decoded(spark, sf_dir):
    """Text blocks written as JSON in JSON in JSON."""
    m = _t(spark, sf_dir, "messages")
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("x "), F.coalesce("content", F.lit(""))).alias("text"))))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)  # noqa: E731 - a JSON string of the text
    return m.select("session_id", "id", "role", "created_at", "content", F.explode(payload.payload_texts(quoted(quoted(block)))).alias("text"))


@_query(f"""select id, session_id, role, created_at, content, unnest([0, 1, 2])::int as pos, unnest([concat_ws(chr(10), nullif({_strip("coalesce(role, '')")}, ''), {_rstrip("'s ' || coalesce(content, '')")}, 'Source: u' || id), {_strip("'b ' || coalesce(content, '')")}, 'T' || chr(10) || 'a']) as text from messages""")
def payload_nested(spark, sf_dir):
    """A result, a list of text blocks and an answer nested in one mapping; the unavailable page gives way to its snippet."""
    m = _t(spark, sf_dir, "messages")
    body = F.coalesce("content", F.lit(""))
    result = F.struct(F.coalesce("role", F.lit("")).alias("title"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("s "), body).alias("snippet"), F.lit(payload.UNAVAILABLE + " it").alias("page_content"))
    blocks_ = F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("b "), body).alias("text")))
    whole = F.to_json(F.struct(result.alias("result"), blocks_.alias("data"), F.array(F.struct(F.lit("T").alias("title"), F.lit("a").alias("page_content"))).alias("messages")))
    return m.select("id", "session_id", "role", "created_at", "content", F.posexplode(payload.payload_texts(whole)).alias("pos", "text"))
