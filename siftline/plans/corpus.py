"""Queries over documents, pages, conversations and events: text, chunks, sync, answers, memory, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import analyze as A
from ..functions.text import html_strip as strip, html_to_text as to_text, normalize_whitespace, text_hash, token_count, tokenize
from ..operators import answer, chunk, evaluate, memory, sections, suggest, sync
from . import query, spread, table
from .retrieval import ASKED, TOK

PARTS = "p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 chunk_index, trim(line) content FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) pos, unnest(l) line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) l FROM documents)) WHERE trim(line) <> '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.split_paragraphs(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


@query(f"SELECT doc_id, len(t) n_tokens, md5(array_to_string(t, ' ')) terms_md5 FROM (SELECT doc_id, {TOK.format('text')} t FROM documents)")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(_docs(spark, sf_dir)).select("doc_id", tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query(f"SELECT term, count(DISTINCT doc_id) df, count(*) tf FROM (SELECT doc_id, unnest({TOK.format('text')}) term FROM documents) GROUP BY term")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spread(_docs(spark, sf_dir)).select("doc_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return w.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 0 THEN greatest(1, floor(length(text) / 2.3))::BIGINT ELSE 0 END tokens, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(9), ' '), chr(13), ' '), chr(160), ' '), ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g'))) clean_chars, sha256(concat(lang, chr(31), source)) key_hash FROM documents")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_docs(spark, sf_dir)).select("doc_id", token_count(F.col("text")).alias("tokens"), F.length(normalize_whitespace(F.col("text"))).cast("long").alias("clean_chars"), text_hash(F.col("lang"), F.col("source")).alias("key_hash"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<head\b.*?</head>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) text_md5 FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(strip(F.col("html"))).alias("text_md5"))


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", to_text("html").alias("text"))
    return t.select("page_id", F.size(F.split("text", "\n")).alias("n_lines"), F.length("text").alias("n_chars"), "text")


@query(r"SELECT page_id, md5(regexp_replace('</ Sources><system x><USER>' || html || '<instruction></assistant><systems>', '(?i)<(/?\s*(?:sources?|system|instructions?|user|assistant)\b[^>]*)>', '‹\1›', 'g')) safe_md5 FROM pages")
def sanitize_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages between tags that look like a prompt's own, and one that doesn't."""
    text = F.concat(F.lit("</ Sources><system x><USER>"), "html", F.lit("<instruction></assistant><systems>"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(answer.sanitize(text)).alias("safe_md5"))


@query()
def url_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", answer.strip_urls(F.concat("html", F.lit(" "), "url"), F.array("url")).alias("text"))
    return p.select("page_id", F.contains("text", F.col("url")).alias("keeps_own"), F.size(F.regexp_extract_all("text", F.lit("(https?://)"), F.lit(1))).alias("n_urls"))


@query(f"WITH {PARTS} SELECT doc_id, chunk_index, content FROM p")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")).select(F.col("id").alias("doc_id"), "chunk_index", "token_count", "content_hash")


@query()
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third line is a section, the two after it are its subsections; the source stands for the title."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("title"))
    place = F.floor(F.col("chunk_index") / 3).cast("int")
    first = F.col("chunk_index") % 3 == 0
    path = F.when(first, F.array(place)).otherwise(F.array(place, (F.col("chunk_index") % 3).cast("int")))
    number = F.when(first, place + 1).otherwise(F.col("chunk_index") % 3).cast("string")
    units = _parts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), path.alias("path"), F.when(first, "section").otherwise("subsection").alias("kind"), number.alias("number"), F.when(first, F.substring_index("content", " ", 4)).alias("heading"), "content")
    out = sections.chunk_units(docs, units)
    return out.select(F.col("id").cast("long").alias("doc_id"), "chunk_index", "role", F.size("covers").alias("n_covers"), "token_count", "content_hash")


@query(f"WITH {PARTS}, r AS (SELECT *, sum(length(content)) OVER (PARTITION BY doc_id ORDER BY chunk_index) used FROM p) SELECT doc_id, count(*) blocks, sum(length(content))::BIGINT chars FROM r WHERE chunk_index = 0 OR used <= 2000 GROUP BY doc_id")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = answer.pack_context(_parts(spark, sf_dir), "doc_id", [F.asc("chunk_index")], F.length("content"), 2000)
    return kept.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH {PARTS}, b AS (SELECT doc_id, chunk_index // 3 sec, min(chunk_index) AS first_at FROM p WHERE length(content) % 7 = 0 GROUP BY ALL), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_at, sec) n FROM b) WHERE n <= 3) SELECT f.doc_id, n, p.chunk_index, md5(content) content_md5 FROM f JOIN p ON f.doc_id = p.doc_id AND f.sec = p.chunk_index // 3")
def expand_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in runs of three are sections; lines of a length divisible by seven are hits, ranked as they stand."""
    parts = _parts(spark, sf_dir).withColumn("sec", F.floor(F.col("chunk_index") / 3)).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    hits = parts.where(F.length("content") % 7 == 0).select(F.col("doc_id").alias("query_id"), "doc_id", "sec", F.col("chunk_index").alias("rank"))
    return answer.expand_siblings(hits, parts, ["doc_id", "sec"]).select("doc_id", F.col("n").cast("long").alias("n"), "chunk_index", F.md5("content").alias("content_md5"))


@query(f"WITH {PARTS} SELECT doc_id, count(*) chunks, count(DISTINCT md5(content)) sections FROM p GROUP BY doc_id")
def coverage_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.countDistinct(F.md5("content")).alias("sections"))


CITED = r"""WITH t AS (SELECT conv_id, turn, text || ' [' || (turn + 1) || '] 【' || (conv_id % 12) || '†L1-L5】〔 3 〕［' || (turn % 4) || '］ [ 4 ] [0005] [২] [' || (turn + 1) || ']' t FROM conversations),
n AS (SELECT conv_id, turn, replace(regexp_replace(t, '[【［〔]\s*([0-9০-৯]{1,2})\s*(?:†[^】］〕\n]{0,40})?[】］〕]', '[\1]', 'g'), '[২]', '[2]') t FROM t),
l AS (SELECT conv_id, turn, t, list_transform(regexp_extract_all(t, '\[([0-9]{1,2})\]', 1), lambda x: x::INT) l FROM n)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: x BETWEEN 1 AND 9 AND list_position(l, x) = i), ',') cited, md5(list_reduce(list_concat([list_reduce(list_concat([t], list_transform(list_distinct(list_filter(l, lambda x: x NOT BETWEEN 1 AND 9)), lambda x: '[' || x || ']')), lambda s, x: replace(s, x, ''))], ['1','2','3','4','5','6','7','8','9']), lambda s, x: regexp_replace(s, '(\[' || x || '\])(\s*\[' || x || '\])+', '\1', 'g'))) text_md5 FROM l"""


@query(CITED)
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that cite by their turn and conversation numbers in all sorts of brackets, the first one again at the end."""
    k = F.concat(F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("]"))
    marks = F.concat("text", k, F.lit(" 【"), (F.col("conv_id") % 12).cast("string"), F.lit("†L1-L5】〔 3 〕［"), (F.col("turn") % 4).cast("string"), F.lit("］ [ 4 ] [0005] [২]"), k)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(answer.citations(marks, F.lit(9)).cast("array<string>"), ",").alias("cited"), F.md5(answer.cited_text(marks, F.lit(9))).alias("text_md5"))


@query("SELECT o_orderstatus kind, total, n, o_orderkey FROM (SELECT o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) total, row_number() OVER (PARTITION BY o_orderstatus ORDER BY year(o_orderdate) DESC NULLS LAST, o_orderkey) n, o_orderkey FROM orders) WHERE n <= 15")
def structured_count_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), F.year("o_orderdate").alias("year"), "o_orderkey")
    total, listed = answer.count_and_list(o, "kind", "year", "o_orderkey")
    return listed.join(total, "kind").select("kind", "total", "n", "o_orderkey")


@query("SELECT source, lang, count(*) n FROM documents GROUP BY ALL")
def doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT count(*) total, count(*) FILTER (quality = 1) ready, count(*) - count(*) FILTER (quality = 1) pending FROM documents LEFT JOIN labels USING (doc_id)")
def chunk_counts_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("ready")).withColumn("pending", F.col("total") - F.col("ready"))


@query("SELECT conv_id, array_to_string(array_agg(role ORDER BY turn), ',') roles, count(*) n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def ordered_array_agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.count("*").alias("n"))
    return a.where("n > 1").select("conv_id", F.array_join(F.col("r.role"), ",").alias("roles"), "n")


@query("SELECT source, md5(string_agg(m, ',' ORDER BY b)) mark FROM (SELECT source, doc_id // 1000 b, md5(string_agg(doc_id || ':' || md5(text), ',' ORDER BY doc_id)) m FROM documents GROUP BY ALL) GROUP BY source")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ranges of a thousand ids first, then of those: no array holds a whole source's rows."""
    d = _docs(spark, sf_dir).select("source", "doc_id", F.floor(F.col("doc_id") / 1000).alias("b"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.md5("text")).alias("m"))
    joined = lambda by: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "m"))), lambda x: x["m"]), ","))
    return d.groupBy("source", "b").agg(joined("doc_id").alias("m")).groupBy("source").agg(joined("b").alias("mark"))


@query("SELECT conv_id, turn, back FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) back FROM conversations) WHERE back <= 6")
def conv_recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.recent(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "back")


@query("WITH f AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) t FROM conversations), l AS (SELECT conv_id, turn, role || ': ' || substr(t, 1, 600) || CASE WHEN length(t) > 600 THEN '…' ELSE '' END line FROM f), u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) back, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn DESC) used FROM l) SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) transcript, count(*) turns FROM u WHERE back = 1 OR used <= 2500 GROUP BY conv_id")
def conv_render_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.transcript(table(spark, sf_dir, "conversations"))


LEANS = A.LEANS.replace("(?=[\\s?।,.!]|$)", "([\\s?।,.!]|$)")
DEPENDENT = f"(regexp_matches(text, '(?i){LEANS}') OR len(list_distinct({ASKED.format('text')})) <= 1)"


@query(f"SELECT conv_id, turn, CASE WHEN {DEPENDENT} AND prev IS NOT NULL THEN prev || ' — ' || text ELSE text END standalone FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) prev FROM conversations WHERE role = 'user')")
def conv_fallback_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.standalone(table(spark, sf_dir, "conversations"), A.looks_dependent(F.col("text"))).select("conv_id", "turn", "standalone")


@query("SELECT user_id, max(ts) updated_at FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def conv_purge_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return memory.purge(last, F.lit(now), 7)


@query(f"SELECT conv_id, turn, {DEPENDENT} dependent FROM conversations WHERE role = 'user'")
def looks_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", A.looks_dependent(F.col("text")).alias("dependent"))


def _says(pattern: str) -> str:
    return f"regexp_matches(t, '(?i){pattern}')"


ANALYZED = f"""WITH q AS (SELECT conv_id, turn, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) t FROM conversations),
a AS (SELECT *, {_says(A.DEFINITION)} wants_definition, {_says(A.ALL_SECTIONS)} wants_all_sections, {_says(A.DETAIL)} d, {_says(A.ABOUT_ACT)} o, {_says(A.GREETING[5:])} hello, {_says(A.COUNT)} AND ({" OR ".join(f"contains(lower(t), '{w}')" for w in A.KINDS)}) counted FROM q)
SELECT conv_id, turn, try_cast(nullif(regexp_extract(t, '(?:^|[^0-9])(1[89][0-9]{{2}}|20[0-9]{{2}})(?:[^0-9]|$)', 1), '') AS INT) "year", wants_definition, wants_all_sections, wants_all_sections OR d wants_detail, wants_all_sections OR o wants_act_overview, CASE WHEN hello THEN 'smalltalk' WHEN counted THEN 'structured' ELSE 'rag' END route,
  len(list_distinct(list_concat({ASKED.format('t')}, CASE WHEN wants_definition THEN ['সংজ্ঞা:*', 'অর্থ'] ELSE [] END))) n_terms, md5(array_to_string({TOK.format('t')}, ' ')) form_md5 FROM a"""


@query(ANALYZED)
def analyze_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = A.analyze(table(spark, sf_dir, "conversations"), "text")
    return q.select("conv_id", "turn", "year", "wants_definition", "wants_all_sections", "wants_detail", "wants_act_overview", "route", F.size("terms").alias("n_terms"), F.md5("normalized").alias("form_md5"))


FORM = f"array_to_string({TOK}, ' ')"
SUGGEST = rf"""q AS (SELECT * FROM (SELECT item_id query_id, {FORM.format('substr(text, 1 + item_id % 7, 12)')} a FROM benchmark) WHERE length(a) >= 2),
w AS (SELECT query_id, item_id id, b.text, a, {FORM.format('b.text')} t FROM q, benchmark b),
h AS (SELECT *, string_split(a, ' ') words, string_split(t, ' ') have FROM w),
i AS (SELECT *, len(words) n, len(list_filter(words, lambda x, i: CASE WHEN i = len(words) THEN len(list_filter(have, lambda y: starts_with(y, x))) > 0 ELSE list_contains(have, x) END)) hit FROM h),
s AS (SELECT query_id, id, text, CASE WHEN starts_with(t, a) THEN 1.0 WHEN contains(t, a) THEN 0.85 WHEN hit > 0 AND 2 * hit >= n THEN round(0.6::DOUBLE * hit / n, 6) ELSE 0.0 END score FROM i)"""


@query(f"WITH {SUGGEST} SELECT query_id, id, score, rank FROM (SELECT query_id, id, score::DOUBLE score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(text), id) rank FROM s WHERE score > 0) WHERE rank <= 5")
def suggest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve characters of each item are typed, from one of its first seven places on: from inside words, too."""
    b = table(spark, sf_dir, "benchmark")
    typed = b.select(F.col("item_id").alias("query_id"), F.substring("text", (1 + F.col("item_id") % 7).cast("int"), F.lit(12)).alias("typed"))
    return suggest.suggest(typed, b.select(F.col("item_id").alias("id"), "text"))


OLD_NEW = "o AS (SELECT doc_id, sha256(text) h, source = 'src5' deleted, source FROM documents WHERE lang <> 'es'), n AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN sha256(text || ' (edited)') ELSE sha256(text) END h, source FROM documents WHERE source <> 'src3'), c AS (SELECT coalesce(o.doc_id, n.doc_id) id, coalesce(o.source, n.source) source, o.h IS NOT NULL AND NOT o.deleted live, CASE WHEN n.h IS NULL THEN CASE WHEN o.deleted THEN 'gone' ELSE 'missing' END WHEN o.h IS NULL THEN 'created' WHEN o.h = n.h AND NOT o.deleted THEN 'unchanged' ELSE 'updated' END status FROM o FULL JOIN n ON o.doc_id = n.doc_id)"


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old: all but Spanish, src5 deleted; new: all but src3, French texts edited."""
    d = _docs(spark, sf_dir)
    old = d.where("lang <> 'es'").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"), (F.col("source") == "src5").alias("deleted"))
    new = d.where("source <> 'src3'").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, sync.diff(old, new)


@query(f"WITH {OLD_NEW} SELECT id, status FROM c")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)[1]


@query(f"WITH {OLD_NEW}, g AS (SELECT source, count(*) FILTER (live) live, count(*) FILTER (status = 'missing') missing FROM c GROUP BY source) SELECT source, live, missing, live >= 10 AND missing > 0.3 * live refused FROM g")
def soft_delete_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, changes = _changes(spark, sf_dir)
    rows = changes.join(old.select("id", (~F.col("deleted")).alias("alive")), "id", "left").join(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source"), "id")
    return sync.delete_guard(rows, F.coalesce("alive", F.lit(False)), "source")


@query("SELECT d.doc_id, o.v vector_of FROM documents d LEFT JOIN (SELECT sha256(text) h, min(doc_id) v FROM documents WHERE lang <> 'es' GROUP BY 1) o ON sha256(d.text) = o.h")
def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors are those of all but Spanish documents; the vector's name is the id it was made for."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    old = d.where("lang <> 'es'").select(F.col("doc_id").alias("id"), "content_hash", F.lit("m").alias("model"), F.col("doc_id").alias("v"))
    return sync.reuse_vectors(d.select("doc_id", "content_hash"), old, "m", ["content_hash"]).select("doc_id", F.col("v").alias("vector_of"))


@query("SELECT doc_id, model FROM (SELECT d.doc_id, quality v, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'm' ELSE 'other' END model FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE v IS NULL OR model <> 'm'")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = j.select("doc_id", F.col("quality").alias("v"), F.when(F.col("toxic") == 1, None).when(F.col("quality") == 1, "m").otherwise("other").alias("model"))
    return sync.pending(rows, "m").select("doc_id", "model")


@query("SELECT doc_id, duplicates FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) n, count(*) OVER (PARTITION BY sha256(text)) - 1 duplicates FROM documents) WHERE n = 1")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))
    return sync.last_wins(d, "h", F.col("doc_id")).select("doc_id", "duplicates")


@query("SELECT user_id, epoch(date_trunc('minute', ts))::BIGINT \"minute\", count(*) hits, count(*) > 1 limited FROM events GROUP BY ALL")
def rate_limit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import rate_windows

    r = rate_windows(table(spark, sf_dir, "events"))
    return r.select("user_id", F.unix_timestamp("minute").alias("minute"), "hits", (F.col("hits") > 1).alias("limited"))


@query("SELECT event_id, count, count <= 2 allowed, 86400 - s % 86400 reset FROM (SELECT event_id, floor(epoch(ts))::BIGINT s, row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 86400 ORDER BY ts, event_id) count FROM events)")
def rate_limit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events a user and day are allowed."""
    from ..streaming import rate_limits

    return rate_limits(table(spark, sf_dir, "events"), 2, 86_400).select("event_id", "count", "allowed", "reset")


@query("SELECT lang, n, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('s1' || doc_id), doc_id) n FROM documents) WHERE n <= 20")
def eval_set_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sample(_docs(spark, sf_dir), "lang", "doc_id", 20).select("lang", "n", "doc_id")


@query("SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) n FROM events) WHERE n <= 20")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").withColumn("n", F.row_number().over(w)).where("n <= 20").drop("n")


@query("WITH r AS (SELECT user_id run, bool_or(event_type <> 'error') fetched, count(*) FILTER (value < 1) errors, event_type FROM events GROUP BY user_id, event_type) SELECT run, CASE WHEN count(*) FILTER (fetched) = 0 THEN 'failed' WHEN sum(errors) > 0 OR count(*) FILTER (fetched) < count(*) THEN 'partial' ELSE 'succeeded' END status FROM r GROUP BY run")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's kinds of events are a run's fetches; values under 1 are errors."""
    r = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), "event_type").agg(F.bool_or(F.col("event_type") != "error").alias("fetched"), F.count_if(F.col("value") < 1).alias("errors"))
    return sync.run_status(r)
