"""Queries on retrieval: BM25, vectors, fusion, hybrid search, contexts and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.fingerprint import simhash
from corpuslake.operators import bm25, context, dedup, evaluate, fusion, hybrid, vector
from corpuslake.operators import store as stores
from corpuslake.operators.common import materialize, small
from corpuslake.plans.literals import frame, values
from corpuslake.plans.texts import SIMHASH, documents, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _tok(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+')"


def _bm25(docs: str, top_k: int) -> str:
    """CTEs up to kw (query_id, doc, score, rank)."""
    return f"""
src AS ({docs}),
p AS (SELECT doc, token, count(*) AS tf FROM (SELECT doc, unnest({_tok('document')}) AS token FROM src) GROUP BY doc, token),
lens AS (SELECT doc, len({_tok('document')}) AS dl FROM src), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
dfs AS (SELECT token, count(*) AS df FROM p GROUP BY token),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_tok('text')}) AS token FROM benchmark),
raw AS (SELECT query_id, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s
        FROM q JOIN p USING (token) JOIN dfs USING (token) JOIN lens USING (doc), st GROUP BY query_id, doc),
kw AS (SELECT * FROM (SELECT query_id, doc, round(s, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 4) DESC, doc) AS rank FROM raw WHERE s > 0) WHERE rank <= {top_k})"""


def _vec(store: str, top_k: int) -> str:
    """CTEs up to vec (query_id, doc, score, rank); store has doc and embedding."""
    return f"""
vs AS ({store}), qv AS (SELECT item_id AS query_id, embedding AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
vscore AS (SELECT query_id, doc, greatest(0.0, least(1.0, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 4))) AS score FROM vs, qv),
vec AS (SELECT * FROM (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM vscore) WHERE rank <= {top_k})"""


ALL_DOCS = "SELECT doc_id AS doc, text AS document, source FROM documents"
STORE = "SELECT doc_id AS doc, text AS document, source, embedding FROM documents JOIN embeddings ON vec_id = doc_id"


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _asked(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _items(spark, sf_dir).join(vectors, "query_id")


def _store(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("document"), "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    return docs.join(vectors, "doc")


def _keyword(spark, sf_dir, top_k: int) -> DataFrame:
    return bm25.search(bm25.build_index(table(spark, sf_dir, "documents"), "doc_id", "text", written=True), _items(spark, sf_dir), top_k)


@query(f"WITH {_bm25(ALL_DOCS, 20)} SELECT query_id, doc, score, rank FROM kw")
def bm25_topk(spark, sf_dir):
    return _keyword(spark, sf_dir, 20)


ORDINALS = [(1, 0), (2, 5), (3, -1), (4, 10_000_000)]


@query(f"SELECT id, o.doc, coalesce(text, '') AS document FROM {values(ORDINALS, 'id, doc')} o LEFT JOIN documents ON doc_id = o.doc")
def documents_by_ordinal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bm25.documents_at(frame(spark, ORDINALS, "id int, doc bigint"), docs, "doc_id", "text").select("id", "doc", "document")


@query(f"SELECT id, o.doc, source, lang FROM {values(ORDINALS, 'id, doc')} o LEFT JOIN documents ON doc_id = o.doc")
def metadata_by_ordinal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc")
    return stores.rows_at(frame(spark, ORDINALS, "id int, doc bigint"), docs, ["source", "lang"]).select("id", "doc", "source", "lang")


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding", "label")


@query(f"WITH {_vec('SELECT vec_id AS doc, embedding FROM embeddings', 10)} SELECT * FROM vec")
def vector_topk(spark, sf_dir):
    return vector.nearest(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10)


@query(f"WITH {_vec('SELECT vec_id AS doc, embedding FROM embeddings WHERE label = 3', 5)} SELECT * FROM vec")
def vector_topk_filtered(spark, sf_dir):
    return vector.nearest(_vectors(spark, sf_dir), _asked(spark, sf_dir), 5, F.col("label") == 3)


@query(f"WITH {_vec('SELECT vec_id AS doc, embedding FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)', 1)} SELECT query_id, doc, score FROM vec WHERE score >= 0.3")
def vector_similar(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"))
    store = _vectors(spark, sf_dir).join(items, "doc", "left_anti")
    return vector.vector_duplicates(_asked(spark, sf_dir), store, 0.3)


# a near vector of each embedding, and of its first five numbers, against all embeddings and all their first five numbers
_NEAR = "list_transform({0}::DOUBLE[], lambda x, i: x + 0.004::DOUBLE * ((i * 7 + vec_id) % 3 - 1))"


@query(f"""
WITH store AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT -1 - vec_id, embedding[1:5]::DOUBLE[] FROM embeddings),
asked AS (SELECT vec_id AS query_id, {_NEAR.format('embedding')} AS v FROM embeddings UNION ALL SELECT -1 - vec_id, {_NEAR.format('embedding[1:5]')} FROM embeddings),
scored AS (SELECT query_id, doc, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(list_cosine_similarity(s.v, a.v), 4))) AS score FROM asked a JOIN store s ON len(s.v) = len(a.v))
SELECT query_id, arg_min(doc, struct_pack(s := -score, d := doc)) AS doc, max(score) AS score FROM scored WHERE score >= 0.98 GROUP BY query_id""")
def vector_duplicates(spark, sf_dir):
    """Vectors of two lengths at the threshold that indexing uses."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = rows.unionByName(rows.select((-1 - F.col("vec_id")).alias("vec_id"), F.slice("v", 1, 5).alias("v")))
    place = F.when(F.col("vec_id") < 0, -1 - F.col("vec_id")).otherwise(F.col("vec_id"))
    near = F.transform("v", lambda x, i: x + F.lit(0.004) * (((i + 1) * 7 + place) % 3 - 1))
    return vector.vector_duplicates(both.select(F.col("vec_id").alias("query_id"), near.alias("vector")), both.select(F.col("vec_id").alias("doc"), F.col("v").alias("embedding")), 0.98)


# the second half of the documents as new chunks, the first half's vectors as the store
DUAL = 0.45
_NEW = "text IS NOT NULL AND doc_id % 2 = 1"


@query(f"""
WITH RECURSIVE {SIMHASH},
o AS MATERIALIZED (SELECT doc_id, CAST(u AS UBIGINT) AS s, row_number() OVER (ORDER BY doc_id) AS rn FROM sh JOIN documents USING (doc_id) JOIN embeddings ON vec_id = doc_id WHERE trim(text) <> '' AND {_NEW}),
r(i, kept, doc_id, keep) AS (
  SELECT 0::BIGINT, []::UBIGINT[], NULL::BIGINT, false
  UNION ALL
  SELECT r.i + 1, CASE WHEN len(list_filter(r.kept, lambda k: bit_count(xor(k, o.s)) <= 3)) = 0 THEN list_append(r.kept, o.s) ELSE r.kept END,
         o.doc_id, len(list_filter(r.kept, lambda k: bit_count(xor(k, o.s)) <= 3)) = 0
  FROM r JOIN o ON o.rn = r.i + 1),
by_hash AS (SELECT doc_id, embedding AS v FROM r JOIN embeddings ON vec_id = doc_id WHERE keep),
scored AS (SELECT b.doc_id, vec_id, greatest(0.0, least(1.0, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 4))) AS score FROM by_hash b, embeddings WHERE vec_id % 2 = 0)
SELECT b.doc_id, arg_min(vec_id, vec_id) FILTER (score = top) AS duplicate_of, max(top) FILTER (top >= {DUAL}) AS score
FROM by_hash b LEFT JOIN (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM scored) s ON s.doc_id = b.doc_id AND s.top >= {DUAL} GROUP BY b.doc_id""")
def dual_dedup(spark, sf_dir):
    """What the fingerprint layer keeps, with the stored vector that the second layer finds too near."""
    docs = documents(spark, sf_dir).filter(F.expr(_NEW)).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    kept = dedup.filter_chunks(docs.join(simhash(docs, "doc_id", "text"), "doc_id"), key="doc_id", text="text")
    kept = materialize(kept.select("doc_id", "embedding"), "kept")
    near = vector.vector_duplicates(kept.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector")), _vectors(spark, sf_dir).filter("doc % 2 = 0"), DUAL)
    return kept.select("doc_id").join(near.select(F.col("query_id").alias("doc_id"), F.col("doc").alias("duplicate_of"), "score"), "doc_id", "left")


# ---------------------------------------------------------------- fusion

POOL = 30
_LISTS = f"{_bm25(STORE, POOL)}, {_vec(STORE, POOL)}"
_RRF = f"""{_LISTS},
tagged AS (SELECT query_id, doc, rank, 0 AS list FROM kw UNION ALL SELECT query_id, doc, rank, 1 FROM vec),
summed AS (SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(list * 1000000 + rank) AS first FROM tagged GROUP BY query_id, doc),
fused AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM summed)"""
_LINEAR = f"""{_LISTS},
v AS (SELECT query_id, doc, rank AS v_rank, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END * 0.7::DOUBLE AS v FROM vec WINDOW w AS (PARTITION BY query_id)),
k AS (SELECT query_id, doc, rank AS k_rank, score / CASE WHEN max(score) OVER w <> 0 THEN max(score) OVER w ELSE 1 END * 0.3::DOUBLE AS k FROM kw WINDOW w AS (PARTITION BY query_id)),
merged AS (SELECT query_id, doc, round(coalesce(v, 0) + coalesce(k, 0), 6) AS score, v_rank, k_rank FROM v FULL JOIN k USING (query_id, doc)),
fused AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v_rank NULLS LAST, k_rank NULLS LAST) AS rank FROM merged)"""


def _fused(spark, sf_dir, method: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return hybrid.candidates(bm25.build_index(store, written=True), store, _asked(spark, sf_dir), POOL, method)


@query(f"WITH {_RRF} SELECT query_id, doc, score, rank FROM fused")
def rrf_topk(spark, sf_dir):
    return _fused(spark, sf_dir, "rrf")


@query(f"WITH {_LINEAR} SELECT query_id, doc, score, rank FROM fused")
def linear_topk(spark, sf_dir):
    return _fused(spark, sf_dir, "linear")


# two lists for each of 40 groups of documents, with many equal scores; a document is in one of them or in both
_TIED = """kw AS (SELECT doc_id % 40 AS query_id, doc_id AS doc, CAST(n_chars % 5 AS DOUBLE) AS score, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS rank FROM documents WHERE doc_id % 3 < 2),
vec AS (SELECT doc_id % 40 AS query_id, doc_id AS doc, (n_chars % 7) / 10.0::DOUBLE AS score, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id DESC) AS rank FROM documents WHERE doc_id % 3 > 0)"""


def _tied(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("doc"), "n_chars")
    group = Window.partitionBy("query_id")
    kw = docs.filter("doc % 3 < 2").select("query_id", "doc", (F.col("n_chars") % 5).cast("double").alias("score"), F.row_number().over(group.orderBy("doc")).alias("rank"))
    vec = docs.filter("doc % 3 > 0").select("query_id", "doc", ((F.col("n_chars") % 7) / F.lit(10.0)).alias("score"), F.row_number().over(group.orderBy(F.desc("doc"))).alias("rank"))
    return kw, vec


@query(f"WITH {_RRF.replace(_LISTS, _TIED)} SELECT query_id, doc, score, rank FROM fused")
def rrf_ties(spark, sf_dir):
    return fusion.reciprocal_rank(*_tied(spark, sf_dir))


@query(f"WITH {_LINEAR.replace(_LISTS, _TIED)} SELECT query_id, doc, score, rank FROM fused")
def linear_ties(spark, sf_dir):
    return fusion.linear(*_tied(spark, sf_dir))


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS rank, doc_id AS hit, (SELECT min(e.doc_id) FROM documents e WHERE e.text = d.text) AS doc FROM documents d")
def hits_to_ordinals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("document"))
    numbered = docs.select(F.col("doc").alias("query_id"), "document", F.lit(1.0).alias("score"), (F.col("doc") + 1).alias("rank"))
    return hybrid.ordinals_of_hits(numbered, docs).select("rank", F.col("query_id").alias("hit"), "doc")


# ---------------------------------------------------------------- hybrid


def _hybrid(spark, sf_dir, **options) -> DataFrame:
    store = _store(spark, sf_dir)
    found = hybrid.search(bm25.build_index(store, written=True), store, _asked(spark, sf_dir), **{"dedup": False, **options})
    return found.select("query_id", "doc", "source", "score", "rank")


_TOP = "SELECT query_id, fused.doc, source, score, rank FROM fused LEFT JOIN src ON src.doc = fused.doc"


@query(f"WITH {_RRF} {_TOP} WHERE rank <= 5")
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(f"WITH {_RRF} {_TOP} WHERE rank <= 5 AND score >= 0.02")
def hybrid_threshold_nofill(spark, sf_dir):
    return _hybrid(spark, sf_dir, threshold=0.02, backfill=False)


@query(f"WITH {_RRF} {_TOP} WHERE rank <= 5")
def hybrid_threshold_backfill(spark, sf_dir):
    return _hybrid(spark, sf_dir, threshold=0.35)


# walks each query's candidates in rank order: texts kept so far, and for each kept place its prefix, source, score and document
_DEDUPED = f"""{_RRF},
cand AS MATERIALIZED (SELECT query_id, fused.doc, score, rank, coalesce(source, '') AS source, coalesce(document, '') AS document,
  regexp_replace(left(coalesce(document, ''), 80), '^\\s+|\\s+$', '', 'g') AS prefix FROM fused LEFT JOIN src ON src.doc = fused.doc),
walk(query_id, rank, texts, kept) AS (
  SELECT DISTINCT query_id, 0::BIGINT, []::VARCHAR[], []::STRUCT(prefix VARCHAR, source VARCHAR, score DOUBLE, doc BIGINT)[] FROM cand
  UNION ALL
  SELECT query_id, rank, CASE WHEN act = 'add' THEN list_append(texts, document) ELSE texts END,
    CASE act WHEN 'add' THEN list_append(kept, one) WHEN 'swap' THEN list_concat(list_append(kept[:place - 1], one), kept[place + 1:]) ELSE kept END
  FROM (SELECT *, CASE WHEN list_contains(texts, document) THEN 'drop' WHEN place IS NULL OR (one.source <> '' AND kept[place].source = one.source) THEN 'add'
                       WHEN one.score > kept[place].score THEN 'swap' ELSE 'drop' END AS act
        FROM (SELECT w.query_id, c.rank, w.texts, w.kept, c.document, {{'prefix': c.prefix, 'source': c.source, 'score': c.score, 'doc': c.doc}} AS one,
                CASE WHEN c.prefix <> '' THEN list_max(list_filter(range(1, len(w.kept) + 1), lambda i: w.kept[i].prefix = c.prefix)) END AS place
              FROM walk w JOIN cand c ON c.query_id = w.query_id AND c.rank = w.rank + 1))),
last AS (SELECT query_id, kept FROM walk WHERE rank = (SELECT max(rank) FROM cand WHERE cand.query_id = walk.query_id)),
top AS (SELECT query_id, unnest(kept) AS k, generate_subscripts(kept, 1) AS rank FROM last)"""


@query(f"WITH RECURSIVE {_DEDUPED} SELECT query_id, k.doc AS doc, k.source AS source, k.score AS score, rank FROM top WHERE rank <= 5")
def hybrid_deduped(spark, sf_dir):
    return _hybrid(spark, sf_dir, dedup=True)


# ranked hits of 40 groups of documents, whose texts agree wholly, in their first 80 characters, or not at all
_HIT_TEXT = "concat(rpad(concat('text ', doc_id % 6), 80, '-'), ' ', n_chars % 3)"
_HIT_ROWS = f"SELECT doc_id % 40 AS query_id, doc_id AS doc, (n_chars % 100) / 100.0 AS score, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS rank, source, {_HIT_TEXT} AS document FROM documents"
_WALK = _DEDUPED[_DEDUPED.index("walk(query_id") :]


@query(f"""WITH RECURSIVE cand AS MATERIALIZED (SELECT query_id, doc, CAST(score AS DOUBLE) AS score, rank, coalesce(source, '') AS source, document, left(document, 80) AS prefix FROM ({_HIT_ROWS})),
{_WALK} SELECT query_id, c.document AS document, k.source AS source, k.score AS score, top.rank AS rank FROM top JOIN (SELECT doc, document FROM cand) c ON c.doc = k.doc""")
def result_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id % 40 AS query_id", "n_chars % 100 / 100D AS score", "doc_id", "source", f"{_HIT_TEXT} AS document")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).drop("doc_id")
    return hybrid.dedup_results(ranked).select("query_id", "document", "source", "score", "rank")


# ---------------------------------------------------------------- contexts


def _hits(spark, sf_dir, top_k: int = 5) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("document"), "source")
    return small(materialize(_keyword(spark, sf_dir, top_k), "found")).join(docs, "doc")  # few rows: no text is shuffled


_PARTS = f"WITH {_bm25(ALL_DOCS, 5)}, parts AS (SELECT query_id, rank, score, source, document, '[来源 ' || rank || ' - ' || source || ']' || chr(10) || document AS part FROM kw JOIN src USING (doc))"
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@query(f"{_PARTS} SELECT query_id, string_agg(part, {_SEP} ORDER BY rank) AS context FROM parts GROUP BY query_id")
def context_pack(spark, sf_dir):
    return context.pack(context.parts(_hits(spark, sf_dir)))


_TRIM = f"""{_PARTS},
run AS (SELECT *, sum(length(part) + 7) OVER (PARTITION BY query_id ORDER BY rank) - 7 AS total, count(*) OVER (PARTITION BY query_id) AS n FROM parts),
mis AS (SELECT query_id, min(rank) AS m FROM run WHERE total > 2730 GROUP BY query_id),
cut AS (SELECT query_id, rank, CASE WHEN m IS NULL OR rank < m THEN part WHEN rank = m AND (n = 1 OR 2730 - (total - length(part)) > 100) THEN substr(part, 1, CAST(2730 - (total - length(part)) AS BIGINT)) END AS part
        FROM run LEFT JOIN mis USING (query_id)),
trimmed AS (SELECT query_id, string_agg(part, {_SEP} ORDER BY rank) AS context FROM cut WHERE part IS NOT NULL GROUP BY query_id)"""


@query(f"{_TRIM} SELECT query_id, context FROM trimmed")
def context_trim(spark, sf_dir):
    return context.trim(context.parts(_hits(spark, sf_dir)))


@query(f"{_TRIM} SELECT query_id, context FROM trimmed")
def context_trim_text(spark, sf_dir):
    packed = context.pack(context.parts(_hits(spark, sf_dir)))
    return packed.select("query_id", context.trim_text(F.col("context")).alias("context"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"{_TRIM} SELECT item_id AS query_id, {_sql_text(context.SYSTEM_PROMPT)} || chr(10) || chr(10) || replace(replace({_sql_text(context.QUESTION_TEMPLATE)}, '{{context}}', context), '{{question}}', text) AS prompt FROM trimmed JOIN benchmark ON item_id = query_id")
def prompt_build(spark, sf_dir):
    joined = context_trim(spark, sf_dir).join(_items(spark, sf_dir), "query_id")
    return joined.select("query_id", context.prompt(F.col("context"), F.col("question")).alias("prompt"))


@query(f'{_PARTS} SELECT query_id, rank AS "index", source AS file, source AS path, score, substr(document, 1, 200) AS snippet FROM parts')
def source_list(spark, sf_dir):
    return context.source_list(_hits(spark, sf_dir))


# some contexts and questions are blank, of several white spaces, or null
_CONTEXT = "CASE doc_id % 5 WHEN 0 THEN concat(' ', chr(9)) WHEN 1 THEN NULL WHEN 2 THEN '　' ELSE text END"
_QUESTION = "CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN source ELSE left(text, 20) END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR NOT regexp_matches({_QUESTION}, '\\S') THEN 'blank question' WHEN doc_id % 5 < 3 OR NOT regexp_matches(text, '\\S') THEN 'blank context' END AS stopped FROM documents")
def qa_guards(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", context.guard(F.expr(_CONTEXT), F.expr(_QUESTION)).alias("stopped"))


# ---------------------------------------------------------------- evaluation

# each question's relevant texts: the item's words 3 to 6, and a text that no document has
_PHRASE = "array_to_string(string_split(text, ' ')[3:6], ' ')"
_DETAILS = f"""WITH {_bm25(ALL_DOCS, 5)},
ds AS (SELECT item_id AS query_id, text AS question, {_PHRASE} AS phrase FROM benchmark WHERE text <> ''),
texts AS (SELECT query_id, rank, string_agg(document, ' ') OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM kw JOIN src USING (doc)),
hit AS (SELECT query_id, min(rank) AS first FROM texts JOIN ds USING (query_id) WHERE contains(upto, phrase) GROUP BY query_id),
det AS (SELECT ds.query_id, question, phrase, coalesce(first, -1) AS first_rank FROM ds LEFT JOIN hit USING (query_id))"""


def _details(spark, sf_dir) -> DataFrame:
    phrase = F.array_join(F.slice(F.split("question", " "), 3, 4), " ")
    dataset = _items(spark, sf_dir).select("query_id", "question", F.array(phrase, F.lit("⁂ nowhere")).alias("relevant_texts"))
    return evaluate.question_hits(dataset, materialize(_hits(spark, sf_dir), "hits"))


@query(f"{_DETAILS} SELECT query_id, CAST(first_rank AS INTEGER) AS first_rank, first_rank > 0 AS recalled FROM det")
def recall_details(spark, sf_dir):
    return _details(spark, sf_dir).select("query_id", "first_rank", "recalled")


@query(f"""{_DETAILS} SELECT count(*) AS total, count(*) FILTER (first_rank > 0) AS hit_count, round(avg(CASE WHEN first_rank = 1 THEN 1.0 ELSE 0 END), 4) AS recall_1,
round(avg(CASE WHEN first_rank BETWEEN 1 AND 3 THEN 1.0 ELSE 0 END), 4) AS recall_3, round(avg(CASE WHEN first_rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0 END), 4) AS recall_5,
round(avg(CASE WHEN first_rank > 0 THEN 1.0::DOUBLE / first_rank ELSE 0 END), 4) AS mrr FROM det""")
def recall_at_k(spark, sf_dir):
    return evaluate.recall_summary(_details(spark, sf_dir))


@query(f"{_DETAILS} SELECT query_id, question, coalesce((SELECT substr(document, 1, 100) FROM kw JOIN src USING (doc) WHERE kw.query_id = det.query_id AND rank = 1), '') AS snippet FROM det WHERE first_rank < 0")
def recall_misses(spark, sf_dir):
    return evaluate.misses(_details(spark, sf_dir))


# a report for each document: fenced, among other words, cut off, or none at all
_REPORT = """concat('{"claims": [{"text": "', md5(text), '", "verdict": "支持"}, {"text": "b"}], "summary": {"total_claims": 4, "supported": ', doc_id % 3, ', "partial": ', doc_id % 2, ', "faithfulness_score": 0.75}}')"""
_RAW = f"CASE doc_id % 5 WHEN 0 THEN concat('```json', chr(10), {_REPORT}, chr(10), '```') WHEN 1 THEN concat('it says ', {_REPORT}, ' done') WHEN 2 THEN left({_REPORT}, 60) WHEN 3 THEN source ELSE {_REPORT} END"
_WHOLE = "doc_id % 5 IN (0, 1, 4)"


@query(f"""SELECT doc_id, CASE WHEN {_WHOLE} THEN 4 ELSE 0 END AS total_claims, CASE WHEN {_WHOLE} THEN CAST(doc_id % 3 AS INTEGER) ELSE 0 END AS supported, CASE WHEN {_WHOLE} THEN CAST(doc_id % 2 AS INTEGER) ELSE 0 END AS partial,
CASE WHEN {_WHOLE} THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS faithfulness_score, CASE WHEN {_WHOLE} THEN (doc_id % 3 + 0.5::DOUBLE * (doc_id % 2)) / 4 ELSE 0.0::DOUBLE END AS recomputed_score,
CASE WHEN {_WHOLE} THEN '无依据' END AS last_verdict, CASE WHEN {_WHOLE} THEN NULL ELSE 'no JSON report' END AS error FROM documents""")
def judge_parse(spark, sf_dir):
    parsed = table(spark, sf_dir, "documents").select("doc_id", evaluate.parse_report(F.expr(_RAW)).alias("r"))
    last = F.try_element_at(F.col("r.claims"), F.lit(-1))["verdict"]
    return parsed.select("doc_id", "r.total_claims", "r.supported", "r.partial", "r.faithfulness_score", "r.recomputed_score", last.alias("last_verdict"), "r.error")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS faithfulness_score, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS unsupported FROM documents WHERE regexp_matches(text, '\\S')""")
def judge_guards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\S"))
    answer, given = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(' ', chr(10)) ELSE text END"), F.expr("CASE WHEN doc_id % 3 = 1 THEN '　' ELSE concat('about ', source) END")
    return docs.select("doc_id", evaluate.judge_guard(answer, given).alias("g")).select("doc_id", "g.faithfulness_score", "g.unsupported")
