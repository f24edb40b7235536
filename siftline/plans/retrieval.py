"""Retrieval queries: every vector whose id is divisible by 100, and every benchmark item, asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ASCII_DIGITS, BN_DIGITS, BN_STOPWORDS, EN_STOPWORDS, VARIANTS, ZERO_WIDTH, lexical_coverage, query_terms, tokenize
from ..functions.analyze import check_filters
from ..operators import embed, evaluate, postings, retrieval as R, vector_index
from ..operators.keep import kept, spent, stored
from . import query, spread, table

# SQL shared by the queries below
VARIANT = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VARIANTS.items()) + " ELSE t END"
TOK = rf"list_transform(list_filter(regexp_extract_all(lower(translate(translate(nfc_normalize({{}}), '{ZERO_WIDTH}', ''), '{BN_DIGITS}', '{ASCII_DIGITS}')), '[\p{{{{L}}}}\p{{{{N}}}}_ঀ-৿]+'), lambda t: t <> '_'), lambda t: {VARIANT})"
STOP = ", ".join(f"'{w}'" for w in [*BN_STOPWORDS, *EN_STOPWORDS])
#: Terms of a question without Bengali letters (those have endings, which literal tests cover)
ASKED = f"list_transform(list_filter({TOK}, lambda t: t NOT IN ({STOP})), lambda t: CASE WHEN length(t) >= 4 AND NOT regexp_full_match(t, '\\p{{{{Nd}}}}+') THEN t || ':*' ELSE t END)"
VSIM = """e AS (SELECT vec_id, embedding::DOUBLE[] v, label FROM embeddings),
s AS (SELECT q.vec_id query_id, q.label ql, d.vec_id id, d.label, round(list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v,q.v)) * sqrt(list_dot_product(d.v,d.v))), 6) score FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)"""
TOP = "SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank FROM {}) WHERE rank <= {}"
TERMS = f"terms AS (SELECT DISTINCT item_id query_id, unnest({ASKED.format('text')}) term FROM benchmark)"
HEAD, REST = "split_part(text, chr(10), 1)", "substr(text, length(split_part(text, chr(10), 1)) + 2)"


def meets(words: str, terms: str) -> str:
    """Rows (query_id, term, word): the distinct words that each query's terms are or begin."""
    return f"""SELECT DISTINCT query_id, t.term, v.term word FROM {words} v JOIN {terms} t ON v.term = t.term UNION
  SELECT DISTINCT query_id, t.term, v.term FROM {words} v JOIN {terms} t ON substr(v.term, 1, 4) = substr(t.term, 1, 4) AND ends_with(t.term, ':*') AND starts_with(v.term, substr(t.term, 1, length(t.term) - 2))"""


LEX = f"""{TERMS},
dt AS (SELECT d.doc_id id, coalesce(quality, 0) * 100 authority, {TOK.format(HEAD)} tt, {TOK.format(REST)} bt FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
wu AS (SELECT id, authority, len(tt) + len(bt) len, unnest(list_concat(list_transform(tt, lambda x: {{'t': x, 'w': 1.0::DOUBLE}}), list_transform(bt, lambda x: {{'t': x, 'w': 0.4::DOUBLE}}))) u FROM dt),
w AS (SELECT id, authority, len, u.t term, sum(u.w) w FROM wu GROUP BY ALL), voc AS (SELECT DISTINCT term FROM w),
vt AS (SELECT DISTINCT query_id, word FROM ({meets("voc", "terms")})),
ls AS (SELECT query_id, id, authority, round(r / (r + 1), 6) score FROM (SELECT query_id, id, authority, sum(w) / ln(1.0 + len) r FROM w JOIN vt ON word = w.term GROUP BY query_id, id, authority, len))"""
LEXTOP = "SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, authority DESC, id) rank FROM ls) WHERE rank <= {}"
HEX = "(strpos('0123456789abcdef', substr(md5(p), 30, 1)) - 1) * 256 + (strpos('0123456789abcdef', substr(md5(p), 31, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(p), 32, 1)) - 1"
HASHED = f"""pc AS (SELECT 'd' k, doc_id id, unnest(list_distinct(list_concat(t, list_transform(t, lambda x: x[1:4])))) p FROM (SELECT doc_id, {TOK.format('text')} t FROM documents)
  UNION ALL SELECT 'q', item_id, unnest(list_distinct(list_concat(t, list_transform(t, lambda x: x[1:4])))) FROM (SELECT item_id, {TOK.format('text')} t FROM benchmark)),
hv AS (SELECT k, id, ({HEX}) % 1024 dim, count(*)::DOUBLE x FROM pc GROUP BY ALL),
nm AS (SELECT k, id, sqrt(sum(x*x)) n FROM hv GROUP BY ALL),
hs AS (SELECT query_id, z.id, round(dot / (a.n * b.n), 6) score FROM (SELECT q.id query_id, d.id id, sum(q.x * d.x) dot FROM hv q JOIN hv d ON q.dim = d.dim WHERE q.k = 'q' AND d.k = 'd' GROUP BY ALL) z JOIN nm a ON a.k = 'q' AND a.id = query_id JOIN nm b ON b.k = 'd' AND b.id = z.id WHERE dot > 0)"""
NORM = "SELECT query_id, id, rank, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END score FROM {} WINDOW w AS (PARTITION BY query_id)"
TWO = f"""{VSIM}, a AS ({TOP.format('s', 30)}), bs AS (SELECT query_id, id, score * (1 + 0.1::DOUBLE * ((label + id) % 7)) score FROM s), b AS ({TOP.format('bs', 30)})"""
BOTH = "coalesce(a.query_id, b.query_id) query_id, coalesce(a.id, b.id) id"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    return e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v", "label"), e


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of the same candidates: by cosine, and by cosine weighted with a rule over label and id."""
    q, e = _vectors(spark, sf_dir)
    return R.vector_topk(q, e), R.vector_topk(q, e.withColumn("w", 1 + 0.1 * ((F.col("label") + F.col("id")) % 7)), weight="w")


@query(f"WITH {VSIM} {TOP.format('s', 10)}")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_topk(*_vectors(spark, sf_dir), k=10)


@query(f"WITH {VSIM} SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank FROM s WHERE ql = label) WHERE rank <= 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_topk(*_vectors(spark, sf_dir), k=10, same="label")


@query(f"WITH {VSIM}, t AS ({TOP.format('s', 30)}) SELECT query_id, count(*) FILTER (score >= 0.2) n_above, max(score) best FROM t GROUP BY query_id")
def vector_similarity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_topk(*_vectors(spark, sf_dir)).groupBy("query_id").agg(F.count_if(F.col("score") >= 0.2).alias("n_above"), F.max("score").alias("best"))


@query(f"WITH {LEX} {LEXTOP.format(30)}")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_topk(*_lexical(spark, sf_dir))


def _lexical(spark: SparkSession, sf_dir: str, text: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The items' terms, and documents (or what they are said to say) with their first line as title and their quality as authority."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(query_terms(F.col("text"))).alias("term"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 100).alias("authority"))
    head = F.substring_index("text", "\n", 1)
    rest = F.substring("text", F.length(head) + 2, F.length("text"))
    docs = spread(table(spark, sf_dir, "documents")).withColumn("text", F.col("text") if text is None else text).join(labels, "doc_id", "left")
    return asked, docs.select(F.col("doc_id").alias("id"), tokenize(head).alias("title"), tokenize(rest).alias("body"), F.coalesce("authority", F.lit(0)).alias("authority"))


@query(f"""WITH {LEX}, t AS ({LEXTOP.format(30)}), q AS (SELECT query_id, count(*) n FROM terms GROUP BY query_id),
tw AS (SELECT id, unnest(list_distinct(list_concat(tt, bt))) word FROM dt WHERE id IN (SELECT id FROM t)),
h AS (SELECT t.query_id, t.id, count(DISTINCT m.term) hits FROM t JOIN tw USING (id) JOIN ({meets("voc", "terms")}) m ON m.query_id = t.query_id AND m.word = tw.word GROUP BY ALL)
SELECT h.query_id, h.id, round(hits / n, 6) coverage FROM h JOIN q ON q.query_id = h.query_id""")
def lexical_coverage_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.lexical_topk(*_lexical(spark, sf_dir)).select("query_id", "id")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), query_terms(F.col("text")).alias("qt"))
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text")
    told = top.join(q, "query_id").join(d, "id").withColumn("t", tokenize(F.col("text")))
    return told.select("query_id", "id", F.round(lexical_coverage(F.col("qt"), F.col("t")), 6).alias("coverage"))


@query("SELECT d.doc_id, lang, source FROM documents d WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src5') AND length(text) % 100 + 1900 = 1950")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stand for types of documents, sources for categories, lengths for years."""
    d = table(spark, sf_dir, "documents").withColumns({"doc_type": F.col("lang"), "category": F.col("source"), "year": F.length("text") % 100 + 1900})
    return R.metadata_filter(d, check_filters({"doc_types": ["en", "fr"], "categories": ["src1", "SRC2 ", "src5"], "year": 1950})).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def metadata_filter_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "lang", "source").join(good, "doc_id", "left_semi")


@query(f"WITH {TWO} SELECT {BOTH}, round(coalesce(0.6 / (60 + a.rank), 0) + coalesce(0.4 / (60 + b.rank), 0), 9) fused FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id")
def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse_rrf(R.union_candidates(*_two(spark, sf_dir))).select("query_id", "id", F.round("fused", 9).alias("fused"))


LINEAR = f"{TWO}, an AS ({NORM.format('a')}), bn AS ({NORM.format('b')}), f AS (SELECT {BOTH.replace('a.', 'an.').replace('b.', 'bn.')}, 0.7 * coalesce(an.score, 0) + 0.3 * coalesce(bn.score, 0) fused, coalesce(an.rank, 1000000 + bn.rank) place FROM an FULL JOIN bn ON an.query_id = bn.query_id AND an.id = bn.id)"


@query(f"WITH {LINEAR} SELECT query_id, id, round(fused, 6) fused FROM f")
def fuse_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse_linear(*_two(spark, sf_dir)).select("query_id", "id", F.round("fused", 6).alias("fused"))


BOOST = f"{LINEAR}, bo AS (SELECT query_id, f.id, place, round(fused * (1 + 0.02 * label * 10 / 100) * CASE WHEN f.id % 9 = query_id % 9 THEN 1.25 ELSE 1.0 END * CASE WHEN f.id % 11 = 0 THEN 0.6 ELSE 1.0 END, 6) fused FROM f JOIN embeddings e ON e.vec_id = f.id)"


def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fuse_linear(*_two(spark, sf_dir)).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return R.boost(f, F.col("label") * 10, F.col("id") % 9 == F.col("query_id") % 9, F.col("id") % 11 == 0).withColumn("fused", F.round("fused", 6))


@query(f"WITH {BOOST} SELECT query_id, id, fused FROM bo")
def boost_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir).select("query_id", "id", "fused")


@query(f"WITH {BOOST}, p AS (SELECT query_id, id, place, CASE WHEN id % 13 = 0 THEN greatest(fused, t * 1.25 - (id % 5) * 1e-9) ELSE fused END fused FROM (SELECT *, CASE WHEN max(fused) OVER (PARTITION BY query_id) = 0 THEN 1e-6 ELSE max(fused) OVER (PARTITION BY query_id) END t FROM bo)) SELECT query_id, id, round(fused, 6) fused, fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, place, id) fused_rank FROM p) WHERE fused_rank <= 20")
def promote_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.promote(_boosted(spark, sf_dir), F.when(F.col("id") % 13 == 0, F.col("id") % 5))
    return R.pool(p).select("query_id", "id", F.round("fused", 6).alias("fused"), "fused_rank")


HYBRID = f"""{LEX}, b AS ({LEXTOP.format(30)}), {HASHED}, a AS ({TOP.format('hs', 30)}),
an AS ({NORM.format('a')}), bn AS ({NORM.format('b')}),
f AS (SELECT {BOTH.replace('a.', 'an.').replace('b.', 'bn.')}, 0.7 * coalesce(an.score, 0) + 0.3 * coalesce(bn.score, 0) fused, coalesce(an.rank, 1000000 + bn.rank) place FROM an FULL JOIN bn ON an.query_id = bn.query_id AND an.id = bn.id),
g AS (SELECT f.query_id, f.id, place, round(fused * (1 + 0.02 * coalesce(quality, 0) * 100 / 100), 6) fused FROM f LEFT JOIN labels l ON l.doc_id = f.id),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, place, id) fused_rank FROM g) WHERE fused_rank <= 20)"""


def _hybrid_pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(the pool of each question, the documents with their tokens)."""
    asked, docs = _lexical(spark, sf_dir)
    docs = kept(docs)  # both sides read the tokens
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokenize(F.col("text")).alias("tokens"))
    vector = embed.hash_topk(queries, docs.select("id", F.concat("title", "body").alias("tokens"))).where("score > 0")
    fused = R.fuse_linear(vector, R.lexical_topk(asked, docs))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    boosted = R.boost(fused.join(labels, "id", "left"), F.coalesce("quality", F.lit(0)) * 100, F.lit(False), F.lit(False))
    return R.pool(boosted.withColumn("fused", F.round("fused", 6))), docs


@query(f"WITH {HYBRID} SELECT query_id, p.id, fused, fused_rank, lang, source FROM pool p JOIN documents d ON d.doc_id = p.id WHERE fused_rank <= 5")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: vector and lexical candidates, fused, boosted by quality, the five best with their documents' fields."""
    best = _hybrid_pool(spark, sf_dir)[0].where("fused_rank <= 5")
    return best.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source"), "id").select("query_id", "id", "fused", "fused_rank", "lang", "source")


@query(f"""WITH {HYBRID}, q AS (SELECT item_id query_id, list_distinct({TOK.format('text')}) qt FROM benchmark),
r AS (SELECT query_id, p.id, fused_rank, round(len(list_intersect(qt, {TOK.format('d.text')})) / len(qt) * (1 + 0.05 * coalesce(quality, 0) * 100 / 100), 6) rerank FROM pool p JOIN q USING (query_id) JOIN documents d ON d.doc_id = p.id LEFT JOIN labels l ON l.doc_id = p.id)
SELECT query_id, id, rerank, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, fused_rank) final_rank FROM r) WHERE final_rank <= 5""")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, docs = _hybrid_pool(spark, sf_dir)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(tokenize(F.col("text"))).alias("qt"))
    both = pool.select("query_id", "id", "fused_rank", "quality").join(q, "query_id").join(docs.select("id", F.concat("title", "body").alias("t")), "id")
    return R.rerank(both, lexical_coverage(F.col("qt"), F.col("t")), F.coalesce("quality", F.lit(0)) * 100).select("query_id", "id", "rerank", "final_rank")


@query(f"""WITH p AS (SELECT doc_id, {TOK.format(HEAD)} tokens, string_split(text, chr(10)) l FROM documents),
c AS (SELECT doc_id, CAST(pos AS VARCHAR) section FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) pos FROM p)),
q AS (SELECT doc_id query_id, CAST(doc_id // 100 % 8 + 1 AS VARCHAR) section, {ASKED.format(HEAD)} t, 1800 + doc_id % 300 "year" FROM documents WHERE doc_id % 100 = 0),
terms AS (SELECT DISTINCT query_id, unnest(t) term FROM q), n AS (SELECT query_id, count(*) n FROM terms GROUP BY query_id),
w AS (SELECT doc_id, unnest(list_distinct(tokens)) term FROM p), voc AS (SELECT DISTINCT term FROM w),
h AS (SELECT m.query_id, w.doc_id, count(DISTINCT m.term) hits FROM ({meets("voc", "terms")}) m JOIN w ON w.term = m.word GROUP BY ALL),
k AS (SELECT h.query_id, h.doc_id, q.section, hits / n cov, list_contains(p.tokens, CAST("year" AS VARCHAR)) dated, -len(p.tokens) short FROM h JOIN n ON n.query_id = h.query_id JOIN q ON q.query_id = h.query_id JOIN p ON p.doc_id = h.doc_id JOIN c ON c.doc_id = h.doc_id AND c.section = q.section WHERE 2 * hits >= n),
t AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY cov DESC, dated DESC, short DESC) r FROM k) WHERE r = 1),
o AS (SELECT query_id FROM t GROUP BY query_id HAVING count(DISTINCT doc_id) <= 2)
SELECT query_id, doc_id, section, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) rank, round(cov, 6) coverage FROM t WHERE query_id IN (SELECT query_id FROM o)""")
def provision_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines are its provisions, its first line its title; each hundredth document asks for one of its first
    eight lines by its title's terms."""
    docs = spread(table(spark, sf_dir, "documents"))
    head = F.substring_index("text", "\n", 1)
    titles = docs.select("doc_id", tokenize(head).alias("tokens"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    chunks = lines.select((F.col("doc_id") * 1_000_000 + F.col("i")).alias("id"), "doc_id", (F.col("i") + 1).cast("string").alias("section"), F.col("i").alias("chunk_index"), F.array().cast("array<string>").alias("numbers"), "content")
    none = F.lit(None).cast("string")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), (F.floor(F.col("doc_id") / 100) % 8 + 1).cast("string").alias("section"), none.alias("subsection"), none.alias("clause"), (1800 + F.col("doc_id") % 300).cast("int").alias("year"), query_terms(head).alias("terms"))
    found = R.provision_lookup(asked, titles, chunks)
    section = (F.col("id") - F.col("doc_id") * 1_000_000 + 1).cast("string")
    return found.select("query_id", "doc_id", section.alias("section"), F.col("rank").cast("long").alias("rank"), F.round("coverage", 6).alias("coverage"))


METRICS = f"{VSIM}, t AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank, ql = label rel FROM s), m AS (SELECT query_id, min(rank) FILTER (rel) f, count(*) FILTER (rel AND rank <= 1) n1, count(*) FILTER (rel AND rank <= 5) n5, count(*) FILTER (rel AND rank <= 10) n10 FROM t WHERE rank <= 10 GROUP BY query_id), x AS (SELECT q.vec_id query_id, q.label, count(d.vec_id) n FROM embeddings q LEFT JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL), r AS (SELECT query_id, label, round(coalesce(1.0 / f, 0), 6) mrr, " + ", ".join(f"CASE WHEN coalesce(n{k},0) > 0 THEN 1 ELSE 0 END hit_at_{k}, round(CASE WHEN n > 0 THEN coalesce(n{k},0) / n ELSE 0 END, 6) recall_at_{k}, round(coalesce(n{k},0) / {k}, 6) precision_at_{k}" for k in (1, 5, 10)) + " FROM x LEFT JOIN m USING (query_id))"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = _vectors(spark, sf_dir)
    size = e.groupBy("label").agg((F.count("*") - 1).alias("n_expected"))
    told = R.vector_topk(q, e, k=10).join(e.select("id", F.col("label").alias("own")), "id").join(q.select("query_id", "label"), "query_id")
    return evaluate.retrieval_metrics(told.select("query_id", "rank", (F.col("own") == F.col("label")).alias("relevant")), q.join(size, "label").select("query_id", "n_expected"))


@query(f"WITH {METRICS} SELECT * EXCLUDE (label) FROM r")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


@query(f"WITH {METRICS} SELECT 'label ' || label tag, count(*) n, round(avg(mrr), 4) mrr, " + ", ".join(f"round(avg({m}_at_{k}), 4) {m}_at_{k}" for k in (1, 5, 10) for m in ("hit", "recall", "precision")) + " FROM r GROUP BY label")
def metrics_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.array(F.concat(F.lit("label "), F.col("label").cast("string"))).alias("tags"))
    return evaluate.summary(_metrics(spark, sf_dir).join(tags, "query_id"), "tags")


GATE = "CASE WHEN query_id % 300 = 0 THEN 0.0 ELSE score END vector, CASE WHEN query_id % 200 = 0 THEN score * (id % 3) / 10 END rerank, (id % 10) / 10.0 coverage, id % 50 = 0 exact"


@query(f"WITH {VSIM}, t AS ({TOP.format('s', 5)}), g AS (SELECT query_id, {GATE} FROM t), m AS (SELECT query_id, max(vector) vector, max(rerank) rerank, max(coverage) coverage, bool_or(exact) exact FROM g GROUP BY query_id) SELECT query_id, vector::DOUBLE vector, rerank::DOUBLE rerank, coverage::DOUBLE coverage, exact, CASE WHEN exact THEN true WHEN rerank IS NOT NULL THEN rerank >= 0.05 WHEN vector > 0 THEN vector >= 0.5 ELSE coverage >= 0.6 END sufficient FROM m")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second query has rerank scores, every third no similarities; coverage is a rule over ids."""
    from ..operators.answer import evidence_gate as gate

    i, q = F.col("id"), F.col("query_id")
    hits = R.vector_topk(*_vectors(spark, sf_dir), k=5).select("query_id", F.when(q % 300 == 0, 0.0).otherwise(F.col("score")).alias("vector"), F.when(q % 200 == 0, F.col("score") * (i % 3) / 10).alias("rerank"), ((i % 10) / 10.0).alias("coverage"), (i % 50 == 0).alias("exact"))
    return gate(hits).select("query_id", "vector", "rerank", "coverage", "exact", "sufficient")


@query(f"WITH {LEX} {LEXTOP.format(30)}")
def lexical_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search through a positional index of all documents."""
    asked, docs = _lexical(spark, sf_dir)
    return postings.Search(stored(postings.build(docs)), asked).hits


CHANGED = LEX.replace("FROM documents d LEFT JOIN", "FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN text || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id % 11 <> 5) d LEFT JOIN")


@query(f"WITH {CHANGED} {LEXTOP.format(30)}")
def lexical_index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a sync: each eleventh document is gone, each seventh says everything twice."""
    asked, docs = _lexical(spark, sf_dir)
    index = stored(postings.build(docs))
    more = docs.where("id % 7 = 3 and id % 11 <> 5")
    _, twice = _lexical(spark, sf_dir, F.concat("text", F.lit("\n"), "text"))
    changed = twice.join(more.select("id"), "id", "left_semi")
    after = stored(postings.replaced(index, changed, docs.where("id % 11 = 5")))
    spent(index)
    return postings.Search(after, asked).hits


COVERS = rf"""q AS (SELECT query_id, list_filter(t, lambda x, i: list_position(t, x) = i) t FROM (SELECT item_id query_id, {TOK.format('text')} t FROM benchmark)), qq AS (SELECT query_id, t[1] a, t[2] b FROM q WHERE len(t) > 1),
dt AS (SELECT d.doc_id id, coalesce(quality, 0) * 100 authority, {TOK.format(HEAD)} tt, {TOK.format(REST)} bt FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
w AS (SELECT id, authority, len(tt) + len(bt) len, unnest(list_concat(tt, bt)) word, generate_subscripts(list_concat(tt, bt), 1) p, len(tt) head FROM dt),
m AS (SELECT query_id, id, authority, len, word = a AS is_a, p, CASE WHEN p <= head THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END wt FROM w JOIN (SELECT query_id, a, b, unnest([a, b]) x FROM qq) z ON z.x = word),
c AS (SELECT *, lag(is_a) OVER v prev, lag(p) OVER v pp, lag(wt) OVER v pw FROM m WINDOW v AS (PARTITION BY query_id, id ORDER BY p)),
s AS (SELECT query_id, id, authority, sum((2 / (1 / wt + 1 / pw)) / (1 + p - pp - 1)) / ln(1.0 + len) r FROM c WHERE is_a <> prev GROUP BY query_id, id, authority, len),
ls AS (SELECT query_id, id, authority, round(r / (r + 1), 6) score FROM s)"""


@query(f"WITH {COVERS} {LEXTOP.format(10)}")
def lexical_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have the first two words of an item, by how near they stand; the covers of two words are neighbours in SQL."""
    _, docs = _lexical(spark, sf_dir)
    words = F.array_distinct(tokenize(F.col("text")))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("t")).where("size(t) > 1").select("query_id", F.posexplode(F.slice("t", 1, 2)).alias("part", "term"))
    return postings.covers_topk(stored(postings.build(docs)), asked, 10)


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search through inverted lists; tests measure its recall against vector_topk."""
    q, e = _vectors(spark, sf_dir)
    return vector_index.VectorIndex(e).search(q)


@query()
def vector_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among vectors of the query's own label and an even id, with cells widened until enough of them pass."""
    q, e = _vectors(spark, sf_dir)
    return vector_index.VectorIndex(e, tag="label").search(q, where=F.col("id") % 2 == 0)


@query(f"WITH {VSIM}, t AS ({TOP.format('s', 30)}) SELECT query_id, true AS enough FROM t GROUP BY query_id")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether nine in ten of all queries' thirty nearest vectors are found, said for each query."""
    q, e = _vectors(spark, sf_dir)
    true = kept(R.vector_topk(q, e))
    found = vector_index.VectorIndex(e).search(q).select("query_id", "id", F.lit(1).alias("hit"))
    each = true.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    share = each.agg((F.sum("hits") / F.sum("n")).alias("share"))
    return each.crossJoin(F.broadcast(share)).select("query_id", (F.col("share") >= 0.9).alias("enough"))
