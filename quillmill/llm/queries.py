"""The pN_ queries: each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.conversations import Conversations
from quillmill.llm.encoding_repair import wrongly_decoded
from quillmill.llm.leakage import leaks, remove_leaks
from quillmill.llm.near_duplicates import NearDuplicates
from quillmill.llm.packing import pack_texts
from quillmill.llm.quality import prose_shares, text_statistics
from quillmill.llm.scan_repair import ScannedText
from quillmill.llm.splitting import split_records
from quillmill.plans.ordered import running_totals
from quillmill.plans.spread import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Those columns of a table of texts, with work for every core."""
    return spread(_table(spark, sf_dir, name).select(*columns))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks and raw_documents as records (tab, rec_key, file_hash, chunk_index, doc_type, text)."""
    c = _texts(spark, sf_dir, "chunks", "chunk_id", "file_hash", "chunk_index", "doc_type", "text").select(F.lit("chunks").alias("tab"), F.col("chunk_id").alias("rec_key"), "file_hash", "chunk_index", "doc_type", "text")
    r = _texts(spark, sf_dir, "raw_documents", "file_hash", "doc_type", "raw_text").select(F.lit("raw_documents").alias("tab"), F.col("file_hash").alias("rec_key"), "file_hash", F.lit(0).alias("chunk_index"), "doc_type", F.col("raw_text").alias("text"))
    return c.unionByName(r)


def _chunk_duplicates(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(_texts(spark, sf_dir, "chunks", "chunk_id", "text", "file_hash"), "chunk_id", "text", "file_hash", width=3, threshold=0.6, min_terms=20)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_duplicates(spark, sf_dir).pairs().select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_duplicates(spark, sf_dir).groups().withColumnRenamed("rec_id", "chunk_id")


def _common(spark: SparkSession, sf_dir: str) -> list[str]:
    """The table of function words, which is fixed (a few hundred rows)."""
    return [r[0] for r in _table(spark, sf_dir, "common_words").where("word is not null").select("word").distinct().collect()]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_shares(_records(spark, sf_dir), ["tab", "rec_key"], "text", _common(spark, sf_dir)).where("not is_prose").select("tab", "rec_key")


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every record; rows delivered again are given once."""
    return text_statistics(_records(spark, sf_dir).select("tab", "rec_key", "text"), "text", _common(spark, sf_dir)).distinct()


def _conversations(spark: SparkSession, sf_dir: str) -> Conversations:
    return Conversations(_table(spark, sf_dir, "messages"), _table(spark, sf_dir, "sessions"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).broken()


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).conversations()


def _scanned(spark: SparkSession, sf_dir: str) -> ScannedText:
    return ScannedText(_texts(spark, sf_dir, "raw_documents", "file_hash", "raw_text"), "file_hash", "raw_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).found()


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).text()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_records(_records(spark, sf_dir), _table(spark, sf_dir, "chunk_profile"))
    return pieces.where(F.size("pieces") > 1).select("tab", "rec_key").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record in pieces within its limit, chunk_index counted anew over the file.

    Re-deliveries of a record have the same text; they differ at most in doc_type and place, of which the least is used.
    """
    r = _records(spark, sf_dir).where("rec_key is not null and text is not null")
    # Texts are moved once, by their key; what is made of them lies the same way, so that nothing moves them again.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    same = r.repartition(width, "tab", "rec_key").groupBy("tab", "rec_key").agg(F.min(F.struct("file_hash", "chunk_index", "doc_type")).alias("p"), F.first("text").alias("text"))
    pieces = split_records(same.select("tab", "rec_key", "p.*", "text"), _table(spark, sf_dir, "chunk_profile")).select("tab", "rec_key", "file_hash", "chunk_index", "text", "pieces").persist(StorageLevel.MEMORY_AND_DISK)
    narrow = pieces.select("tab", "rec_key", "file_hash", "chunk_index", F.size("pieces").cast("bigint").alias("_n"))
    placed = running_totals(narrow, ["tab", "file_hash"], ["chunk_index", "rec_key"], {"_before": "_n"}).select("tab", "rec_key", "_before")
    whole = pieces.join(placed, ["tab", "rec_key"])
    out = whole.select("tab", "rec_key", "file_hash", "text", "_before", F.inline("pieces"))
    return out.select("tab", "rec_key", "file_hash", (F.col("_before") + F.col("piece_no")).alias("chunk_index"), "piece_no", "first_word", "words", F.expr("substring(text, char_from + 1, chars)").alias("text"))


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of pieces: (tab, rec_key, words covered, whether all keep the limit, whether each shares its overlap with the one before)."""
    pieces = split_records(_records(spark, sf_dir).where("rec_key is not null and text is not null"), _table(spark, sf_dir, "chunk_profile"))
    shared = F.expr("forall(sequence(1, greatest(size(pieces) - 1, 1)), i -> i >= size(pieces) or pieces[i].first_word = pieces[i - 1].first_word + pieces[i - 1].words - _overlap)")
    facts = pieces.where("size(pieces) > 0").select("tab", "rec_key", F.expr("aggregate(pieces, 0, (s, x) -> greatest(s, x.first_word + x.words))").alias("words"), F.expr("forall(pieces, x -> x.words <= _max)").alias("fits"), shared.alias("shared"))
    return facts.distinct()


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(_texts(spark, sf_dir, "documents", "doc_id", "text"))


def p6_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: every text that is not blank is there once, its parts follow one another, only the last is not full, and no container holds too much."""
    placed = p6_containers(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    fits = placed.groupBy("container").agg((F.sum("tokens") <= 2048).alias("fits"))
    parts = placed.join(fits, "container").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part_no").alias("parts"), F.max("part_no").alias("last"), F.min("fits").alias("fits"), F.sum(((F.col("tokens") < 2048) | (F.col("first_token") != F.col("part_no") * 2048)).cast("int")).alias("short"))
    return parts.select("doc_id", ((F.col("n") == F.col("parts")) & (F.col("last") + 1 == F.col("parts")) & (F.col("short") <= 1)).alias("once"), "fits")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_texts(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_leaks(_texts(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "eval_items"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every leaking document how many terms are removed, and whether it is dropped whole."""
    return p7_removed(spark, sf_dir).select("doc_id", "removed", "dropped")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrongly_decoded(_texts(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrongly_decoded(_texts(spark, sf_dir, "documents", "doc_id", "text"))


_TERMS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_WORDS = "[^\\s\\x1c-\\x1f\\x{85}\\p{Z}]+"
_RECORDS = "select 'chunks' as tab, chunk_id as rec_key, doc_type, text from chunks union all select 'raw_documents', file_hash, doc_type, raw_text from raw_documents"

_SQL = {
    "p1_found": f"""with t as materialized (select chunk_id, file_hash, w from (select distinct chunk_id, file_hash, {_TERMS.format("text")} as w from chunks where text is not null) where len(w) >= 20),
s as materialized (select distinct chunk_id, file_hash, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select *, unnest(range(1, len(w) - 1)) as i from t)),
n as (select chunk_id, count(distinct g) as n from s group by chunk_id),
both_ as (select a.chunk_id as a, b.chunk_id as b, count(distinct a.g) as k from s a join s b on a.g = b.g and a.chunk_id < b.chunk_id and a.file_hash <> b.file_hash group by all)
select a as chunk_id_a, b as chunk_id_b from both_ join n x on x.chunk_id = a join n y on y.chunk_id = b where k >= 0.6 * (x.n + y.n - k) - 1e-9""",
    "p1_groups": f"""with recursive t as materialized (select distinct chunk_id, {_TERMS.format("text")} as w from chunks where text is not null and chunk_id is not null),
m as materialized (select chunk_id, md5(array_to_string(list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))), '|')) as c, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from t where len(w) >= 20),
k as materialized (select c, any_value(len(g)) as n, count(distinct chunk_id) as copies, min(chunk_id) as least from m group by c),
s as materialized (select distinct c, unnest(g) as g from m),
e as materialized (select a.c as a, b.c as b from s a join s b on a.g = b.g and a.c <> b.c join k x on x.c = a.c join k y on y.c = b.c group by a.c, b.c, x.n, y.n having count(*) >= 0.6 * (x.n + y.n - count(*)) - 1e-9),
reach as (select c as a, c as b from k union select r.a, e.b from reach r join e on e.a = r.b),
head as (select a as c, min(least) as group_id from reach join k on k.c = reach.b group by a)
select distinct m.chunk_id, group_id, copies, (select count(*) from e where e.a = m.c) as links from m join k using (c) join head using (c)""",
    "p2_statistics": f"""with c as (select list(distinct word) as words from common_words where word is not null),
r as (select tab, rec_key, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', '', 'g') as bare, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from ({_RECORDS})),
l as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', '', 'g') <> '') as lines from r)
select distinct tab, rec_key, len(w)::int as word_count, round(length(bare) / nullif(len(w), 0), 6) as mean_word_length, round(length(regexp_replace(bare, '[\\p{{L}}\\p{{N}}]', '', 'g')) / nullif(length(bare), 0), 6) as symbol_ratio,
round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;…]["''”’»)]*[\\s\\p{{Z}}]*$'))) / nullif(len(lines), 0), 6) as ended_lines,
round(len(list_filter(w, lambda x: list_contains(words, regexp_replace(lower(x), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')))) / nullif(len(w), 0), 6) as common_words from l, c""",
    "p3_found": """with m as (select *, case lower(regexp_replace(role, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) when 'human' then 'human' when 'user' then 'human' when 'ai' then 'ai' when 'assistant' then 'ai' when 'system' then 'system' when 'tool' then 'tool' end as kind from messages where session_id is not null),
named as (select session_id from m union select session_id from sessions where session_id is not null),
bad as (select distinct session_id from m where created_at is null or kind is null),
kept as (select session_id, role, kind, content, created_at, min(id) as id from m where kind in ('human', 'ai') and created_at is not null and coalesce(regexp_replace(content, '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+', '', 'g'), '') <> '' group by all),
seen as (select *, lag(kind) over w as before, lead(kind) over w as after from kept window w as (partition by session_id order by created_at, id, role, content)),
wrong as (select distinct session_id from seen where (before is null and kind = 'ai') or (kind = 'human' and coalesce(after, 'human') = 'human'))
select session_id from named where session_id in (select session_id from bad) or session_id in (select session_id from wrong) or session_id not in (select session_id from kept)""",
    "p5_found": f"""select distinct tab, rec_key from (select tab, rec_key, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) as n, case when lower(doc_type) in (select lower(doc_type) from chunk_profile) then lower(doc_type) else 'txt' end as kind from ({_RECORDS})) r
join chunk_profile p on lower(p.doc_type) = kind where n > max_tokens""",
    "p3_conversations": """with m as (select *, case lower(regexp_replace(role, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) when 'human' then 'human' when 'user' then 'human' when 'ai' then 'ai' when 'assistant' then 'ai' when 'system' then 'system' when 'tool' then 'tool' end as kind from messages where session_id is not null),
bad as (select distinct session_id from m where created_at is null or kind is null),
kept as (select session_id, role, kind, content, created_at, min(id) as id from m where kind in ('human', 'ai') and created_at is not null and coalesce(regexp_replace(content, '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+', '', 'g'), '') <> '' group by all),
placed as (select *, row_number() over w as seq, (count(*) filter (kind = 'human') over w)::bigint as exchange from kept window w as (partition by session_id order by created_at, id, role, md5(content) rows between unbounded preceding and current row)),
fine as (select session_id from (select session_id, exchange, count(*) as n from placed group by all) group by session_id having bool_and(exchange > 0 and n > 1))
select session_id, seq, exchange, id, kind as role, content, created_at from placed where session_id in (select session_id from fine) and session_id not in (select session_id from bad)""",
    "p5_coverage": f"""select distinct tab, rec_key, n::int as words, true as fits, true as shared from (select tab, rec_key, len(regexp_extract_all(text, '{_WORDS}')) as n from ({_RECORDS}) where text is not null and rec_key is not null) where n > 0""",
    "p6_whole": "select distinct doc_id, true as once, true as fits from documents where doc_id is not null and regexp_replace(text, '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+', '', 'g') <> ''",
    "p7_found": f"""with i as (select item_id, {_TERMS.format("passage")} as w from eval_items where passage is not null), d as (select doc_id, {_TERMS.format("text")} as w from documents where text is not null),
gi as materialized (select distinct item_id, array_to_string(w[k : k + 11], ' ') as g from (select *, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12)),
gd as (select doc_id, array_to_string(w[k : k + 11], ' ') as g from (select *, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12))
select distinct doc_id, item_id from gd join gi using (g)""",
    "p7_counts": f"""with i as (select {_TERMS.format("passage")} as w from eval_items where passage is not null), d as (select doc_id, {_TERMS.format("text")} as w from documents where text is not null),
gi as materialized (select distinct array_to_string(w[k : k + 11], ' ') as g from (select *, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12)),
gd as (select doc_id, len(w) as n, k, array_to_string(w[k : k + 11], ' ') as g from (select *, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12)),
t as (select distinct doc_id, n, unnest(range(k, k + 12)) as at_ from gd join gi using (g))
select doc_id, count(*) as removed, count(*) > 0.5 * n as dropped from t group by doc_id, n""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_statistics, p3_found, p3_conversations, p4_found, p4_text, p5_found, p5_pieces, p5_coverage, p6_containers, p6_whole, p7_found, p7_removed, p7_counts, p8_found, p8_restored)}


def oracle_sql() -> dict[str, str]:
    """Statements for whole tables; the other queries are tested against brute force, round trips and labelled texts."""
    return dict(_SQL)
