"""Queries on texts: cleaning, tokens, fingerprints, duplicates, chunks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import clean as c
from corpuslake.functions import markdown
from corpuslake.functions.fingerprint import fnv1a, simhash
from corpuslake.functions.tokens import tokens
from corpuslake.operators import bm25, chunk, dedup, pages
from corpuslake.operators.common import spread
from corpuslake.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for heavy expressions: a table of one row group is dealt to all cores first."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


# ---------------------------------------------------------------- cleaning

SQL_RULES = {
    "control_chars": r"regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g')",
    "zero_width": r"regexp_replace({}, '[\x{{200b}}-\x{{200f}}\x{{2028}}-\x{{202f}}\x{{feff}}]', '', 'g')",
    "wide_space": "replace({}, chr(12288), ' ')",
    "urls": r"regexp_replace({}, 'https?://\S+|ftp://\S+|www\.\S+', '[链接]', 'g')",
    "emails": r"regexp_replace({}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}', '[邮箱]', 'g')",
    "long_numbers": r"regexp_replace({}, '\b\d{{15,}}\b', '[ID]', 'g')",
    "spaces": "regexp_replace({}, ' {{2,}}', ' ', 'g')",
    "newlines": r"regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g')",
    "line_ends": r"regexp_replace({}, '[ \t\r\f\v]+(\n|$)', '\1', 'g')",
    "quotes": "(SELECT CASE WHEN strpos(q, '\"') > 0 THEN left(q, strpos(q, '\"') - 1) || '“' || replace(substr(q, strpos(q, '\"') + 1), '\"', '”') ELSE q END FROM (SELECT {} AS q))",
    "ocr_patterns": r"regexp_replace(regexp_replace({}, '(\d)l([a-z])', '\1I\2', 'g'), '一{{2,}}', '——', 'g')",
}


def _sql_words(x: str) -> str:
    for a, b in c.OCR_WORDS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sql_clean(x: str) -> str:
    for name, _ in c.BASIC:
        x = SQL_RULES[name].format(x)
    x = SQL_RULES["ocr_patterns"].format(_sql_words(x))
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _rule_query(name: str, rule: str, tab: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    def run(spark, sf_dir):
        return table(spark, sf_dir, tab).select(key, c.rule(rule)(F.col(column)).alias("cleaned"))

    run.__name__ = name
    query(f"SELECT {key}, {SQL_RULES[rule].format(column)} AS cleaned FROM {tab}")(run)


for _name, _rule in (("clean_controls", "control_chars"), ("clean_email", "emails"), ("clean_long_ids", "long_numbers"), ("clean_spaces", "spaces"), ("clean_newlines", "newlines"), ("clean_lines", "line_ends"), ("clean_quotes", "quotes")):
    _rule_query(_name, _rule)
_rule_query("clean_urls", "urls", "pages", "page_id", "url")


@query(f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents")
def clean_full(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", c.clean(F.col("text")).alias("cleaned"))


def _sql_deltas() -> str:
    """Each rule's step as a CTE, so that its SQL is said once."""
    names = [n for n, _ in c.TextCleaner().rules]
    steps = ["s0 AS (SELECT doc_id, text FROM documents)"]
    for i, name in enumerate(names):
        done = _sql_words("text") if name == "ocr_words" else SQL_RULES[name].format("text")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT doc_id, {done} AS text FROM s{i})")
    columns = ", ".join(f"length(s{i}.text) - length(s{i + 1}.text) AS {n}" for i, n in enumerate(names))
    joins = " ".join(f"JOIN s{i + 1} USING (doc_id)" for i in range(len(names)))
    return f"WITH {', '.join(steps)} SELECT doc_id, {columns} FROM s0 {joins}"


@query(_sql_deltas())
def clean_deltas(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *c.TextCleaner().deltas(F.col("text")))


# the given texts with some letters as characters that the rules change; the expression means the same to Spark and DuckDB
_MISREAD = "translate(text, 'abcdefghijkmnopqr', '己经末来大阳干万白勺因力下木文昨一')"
_MARKED = "translate(text, 'aeiou', '　​﻿‮　')"


def _rule_on(name: str, derived: str, sql: str, *rules: str) -> None:
    def run(spark, sf_dir):
        x = F.expr(derived)
        for r in rules:
            x = c.rule(r)(x)
        return documents(spark, sf_dir).select("doc_id", x.alias("cleaned"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql} AS cleaned FROM (SELECT doc_id, {derived} AS text FROM documents)")(run)


_rule_on("ocr_fixes", _MISREAD, SQL_RULES["ocr_patterns"].format(_sql_words("text")), "ocr_words", "ocr_patterns")
_rule_on("cjk_space", _MARKED, SQL_RULES["wide_space"].format("text"), "wide_space")
_rule_on("zero_width", _MARKED, SQL_RULES["zero_width"].format("text"), "zero_width")


@query("SELECT page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') AS cleaned FROM pages")
def html_comment_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markdown.comments(F.col("html")).alias("cleaned"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS cleaned FROM pages")
def html_tag_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markdown.tags(F.col("html")).alias("cleaned"))


def _word(i: int) -> str:
    """A word made from a document's text, the same in Spark and DuckDB."""
    return f"substr(md5(text), {2 * i + 1}, 5)"


# a page of Markdown for each document, with its words under every kind of mark; of three stars emphasis leaves one
_MARKDOWN = f"""concat('---', chr(10), 'title: ', source, chr(10), '---', chr(10), '# Head **', {_word(0)}, '**', chr(10), chr(10), 'to [', {_word(1)}, '](http://a/', doc_id, ') and ![', {_word(2)}, '](p.png)', chr(10),
'> ', {_word(3)}, chr(10), '* ', {_word(4)}, chr(10), '- ', {_word(5)}, chr(10), CASE doc_id % 3 WHEN 0 THEN '----' WHEN 1 THEN '***' ELSE '=====' END, chr(10), '## ~~', {_word(6)}, '~~ __', {_word(7)}, '__', chr(10),
'<b>', {_word(8)}, '</b> <!-- no', chr(10), 'way -->', {_word(9)}, '   ', chr(10), chr(10), chr(10), chr(10), {_word(10)})"""
_PLAIN = f"""concat('Head ', {_word(0)}, chr(10), chr(10), 'to ', {_word(1)}, ' and ', {_word(2)}, chr(10), {_word(3)}, chr(10), {_word(4)}, chr(10), {_word(5)}, chr(10), CASE WHEN doc_id % 3 = 1 THEN concat('*', chr(10)) ELSE '' END, {_word(6)}, ' ', {_word(7)}, chr(10),
{_word(8)}, ' ', {_word(9)}, chr(10), chr(10), {_word(10)})"""


@query(f"SELECT doc_id, {_PLAIN} AS cleaned FROM documents")
def markdown_strip(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", markdown.strip_markdown(F.expr(_MARKDOWN)).alias("cleaned"))


# ---------------------------------------------------------------- files

# a path for each document, of several types and odd forms, and a size over the limit for some
_PATH = """concat('/', source, CASE WHEN doc_id % 11 = 0 THEN '.txt/' ELSE '/' END, CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat('f', doc_id) END,
CASE doc_id % 7 WHEN 0 THEN '.MD' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' WHEN 3 THEN '.DOCX' WHEN 4 THEN '' WHEN 5 THEN '.tar.txt' ELSE '.bin' END)"""
_LENGTH = "CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars * (doc_id % 3) * 100000 END"
_FILES = f"(SELECT doc_id, {_PATH} AS path, {_LENGTH} AS length FROM documents)"
_TYPE = "CASE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) WHEN '.md' THEN 'markdown' WHEN '.txt' THEN 'text' WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'word' ELSE 'unknown' END"


def _files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PATH} AS path", f"CAST({_LENGTH} AS BIGINT) AS length")


@query(f"SELECT doc_id, {_TYPE} AS file_type FROM {_FILES}")
def file_types(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", files.file_type(F.col("path")).alias("file_type"))


@query(f"SELECT doc_id, length > 104857600 AS oversize FROM {_FILES} WHERE length > 0 AND {_TYPE} <> 'unknown'")
def valid_files(spark, sf_dir):
    return files.validated(_files(spark, sf_dir)).select("doc_id", "oversize")


# ---------------------------------------------------------------- tokens and index

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
POSTINGS = f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS token FROM documents) GROUP BY doc_id, token"


@query(f"SELECT doc_id, len({_TOK}) AS n_tokens, len(list_distinct({_TOK})) AS n_distinct FROM documents")
def token_counts(spark, sf_dir):
    split = documents(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("t"))
    return split.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


# some letters as Chinese characters; a unit is such a character, another run of letters and digits, or what lies between
_MIXED = "translate(text, 'aeiouThn', '中文检索好技术的')"
_UNITS = rf"regexp_extract_all(lower({_MIXED}), '[\x{{4e00}}-\x{{9fff}}]|[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+')"


@query(rf"""SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(u) + 1), lambda i: CASE
WHEN regexp_matches(u[i], '^[\x{{4e00}}-\x{{9fff}}]$') THEN u[i] || regexp_extract(coalesce(u[i + 1], ''), '^[\x{{4e00}}-\x{{9fff}}]')
WHEN regexp_matches(u[i], '^[\p{{L}}\p{{N}}]') THEN u[i] END), lambda t: t IS NOT NULL), '|') AS tokens FROM (SELECT doc_id, {_UNITS} AS u FROM documents)""")
def cjk_bigrams(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(tokens(F.expr(_MIXED)), "|").alias("tokens"))


def _index(spark, sf_dir) -> bm25.Index:
    return bm25.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(POSTINGS)
def postings(spark, sf_dir):
    return _index(spark, sf_dir).postings.select(F.col("doc").alias("doc_id"), "token", "tf")


@query(f"SELECT doc_id, len({_TOK}) AS dl FROM documents")
def doc_lengths(spark, sf_dir):
    return _index(spark, sf_dir).lengths.withColumnRenamed("doc", "doc_id")


@query(f"SELECT token, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM ({POSTINGS}) GROUP BY token")
def idf(spark, sf_dir):
    return bm25.token_idf(_index(spark, sf_dir)).select("token", "df", F.round("idf", 6).alias("idf"))


# ---------------------------------------------------------------- fingerprints

HASH = (
    "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, octet_length(encode(token))), "
    "lambda i: CAST('0x' || substr(hex(encode(token)), 2 * i + 1, 2) AS INTEGER)::UHUGEINT)), "
    "lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
)
_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN {0}::HUGEINT - 18446744073709551616::HUGEINT ELSE {0}::HUGEINT END AS BIGINT)"
_BITS = ", ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN tf ELSE -tf END) AS b{b}" for b in range(64))
_SUM = " + ".join(f"CASE WHEN b{b} > 0 THEN {1 << b}::HUGEINT ELSE 0::HUGEINT END" for b in range(64))
SIMHASH = f"""
p AS ({POSTINGS}), hashed AS (SELECT token, CAST({HASH} AS UBIGINT) AS h FROM (SELECT DISTINCT token FROM p)),
sums AS (SELECT doc_id, {_BITS} FROM p JOIN hashed USING (token) GROUP BY doc_id),
sh AS (SELECT d.doc_id, coalesce({_SUM}, 0::HUGEINT) AS u FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id)
"""


@query(f"SELECT token, {_SIGNED.format('h')} AS h FROM (SELECT token, {HASH}::HUGEINT AS h FROM (SELECT DISTINCT unnest({_TOK}) AS token FROM benchmark))")
def fnv_tokens(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", fnv1a(F.col("token")).alias("h"))


def _marks(spark, sf_dir) -> DataFrame:
    return simhash(documents(spark, sf_dir), "doc_id", "text")


@query(f"WITH {SIMHASH} SELECT doc_id, {_SIGNED.format('u')} AS simhash FROM sh")
def simhash_docs(spark, sf_dir):
    return _marks(spark, sf_dir)


@query(f"""WITH {SIMHASH}, cl AS (SELECT u, min(doc_id) AS class_id FROM sh GROUP BY u),
n AS (SELECT x.u, count(*) AS n FROM cl x JOIN cl y ON x.u <> y.u AND bit_count(xor(CAST(x.u AS UBIGINT), CAST(y.u AS UBIGINT))) <= 3 GROUP BY x.u)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM sh JOIN cl USING (u) LEFT JOIN n USING (u)""")
def near_dup_links(spark, sf_dir):
    from corpuslake.operators.common import materialize

    return dedup.link_counts(materialize(_marks(spark, sf_dir), "marks"), key="doc_id")


_GREEDY = f"""
WITH RECURSIVE {SIMHASH},
o AS (SELECT doc_id, CAST(u AS UBIGINT) AS s, row_number() OVER (ORDER BY doc_id) AS rn FROM sh JOIN documents USING (doc_id) WHERE trim(text) <> ''),
om AS MATERIALIZED (SELECT * FROM o),
r(i, kept, doc_id, keep) AS (
  SELECT 0::BIGINT, []::UBIGINT[], NULL::BIGINT, false
  UNION ALL
  SELECT r.i + 1, CASE WHEN len(list_filter(r.kept, lambda k: bit_count(xor(k, om.s)) <= 3)) = 0 THEN list_append(r.kept, om.s) ELSE r.kept END,
         om.doc_id, len(list_filter(r.kept, lambda k: bit_count(xor(k, om.s)) <= 3)) = 0
  FROM r JOIN om ON om.rn = r.i + 1)
"""


def _kept(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return docs, dedup.filter_chunks(docs.join(_marks(spark, sf_dir), "doc_id"), key="doc_id", text="text")


@query(_GREEDY + "SELECT doc_id FROM r WHERE keep")
def near_dup_greedy(spark, sf_dir):
    return _kept(spark, sf_dir)[1].select("doc_id")


@query(_GREEDY + "SELECT (SELECT count(*) FROM documents) AS total, count(*) AS kept FROM r WHERE keep")
def dedup_stats(spark, sf_dir):
    docs, kept = _kept(spark, sf_dir)
    return docs.agg(F.count("*").alias("total")).crossJoin(kept.agg(F.count("*").alias("kept")))


@query("SELECT md5(text) AS doc_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def doc_md5_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.md5(F.col("text").cast("binary")).alias("doc_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def already_indexed_anti(spark, sf_dir):
    return dedup.new_files(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id")


# ---------------------------------------------------------------- chunks and pages


def _sql_chunks(size: int = 512, overlap: int = 128) -> str:
    """CTEs up to chunks (doc_id, chunk_index, document).

    Lines of long paragraphs are packed first, group by group (pk walks them in order), then all pieces are packed
    into chunks (ck walks them): a chunk is the run of pieces s to i, and the next one begins with the longest tail of
    whole pieces that fits into the overlap.
    """
    trim = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    return rf"""
paras AS (SELECT doc_id, text, pn, {trim.format('p')} AS p FROM (SELECT doc_id, text, unnest(regexp_split_to_array(text, '\n{{2,}}')) AS p, generate_subscripts(regexp_split_to_array(text, '\n{{2,}}'), 1) AS pn FROM documents WHERE regexp_matches(text, '\S'))),
full_p AS (SELECT * FROM paras WHERE p <> ''),
total AS (SELECT doc_id, sum(length(p)) AS n FROM full_p GROUP BY doc_id),
lines AS (SELECT doc_id, pn, ln, line FROM (SELECT doc_id, pn, unnest(string_split(p, chr(10))) AS line, generate_subscripts(string_split(p, chr(10)), 1) AS ln FROM full_p JOIN total USING (doc_id) WHERE n > {size} AND length(p) > {size})),
parts AS (SELECT doc_id, pn, ln, unnest(CASE WHEN length(t) > {size} THEN string_split(regexp_replace(t, '([。？！；])', '\1' || chr(1), 'g'), chr(1)) ELSE [t] END) AS part,
          generate_subscripts(CASE WHEN length(t) > {size} THEN string_split(regexp_replace(t, '([。？！；])', '\1' || chr(1), 'g'), chr(1)) ELSE [t] END, 1) AS sn FROM (SELECT *, {trim.format('line')} AS t FROM lines)),
li AS MATERIALIZED (SELECT doc_id, pn, x, length(x) AS len, row_number() OVER (PARTITION BY doc_id, pn ORDER BY ln, sn) AS i FROM (SELECT *, {trim.format('part')} AS x FROM parts) WHERE x <> ''),
pk(doc_id, pn, i, held, g) AS (
  SELECT doc_id, pn, i, len, 0 FROM li WHERE i = 1
  UNION ALL
  SELECT li.doc_id, li.pn, li.i, CASE WHEN held + 2 + len <= {size} THEN held + 2 + len ELSE len END, CASE WHEN held + 2 + len <= {size} THEN g ELSE g + 1 END
  FROM pk JOIN li ON li.doc_id = pk.doc_id AND li.pn = pk.pn AND li.i = pk.i + 1),
pieces AS (
  SELECT doc_id, pn, g, string_agg(x, chr(10) || chr(10) ORDER BY i) AS piece FROM pk JOIN li USING (doc_id, pn, i) GROUP BY doc_id, pn, g
  UNION ALL SELECT doc_id, pn, 0, p FROM full_p JOIN total USING (doc_id) WHERE n > {size} AND length(p) <= {size}),
pc AS (SELECT doc_id, piece, length(piece) AS len, row_number() OVER w AS i, sum(length(piece)) OVER w AS upto FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY pn, g)),
tails AS MATERIALIZED (SELECT a.doc_id, a.i, a.len, a.upto, coalesce(min(b.i), a.i + 1) AS t FROM pc a LEFT JOIN pc b ON b.doc_id = a.doc_id AND b.i <= a.i AND a.upto - b.upto + b.len + 2 * (a.i - b.i) <= {overlap} GROUP BY a.doc_id, a.i, a.len, a.upto),
ck(doc_id, i, s, held, done, from_i) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, 1::BIGINT, 0::HUGEINT, false, 0::BIGINT FROM pc
  UNION ALL
  SELECT k.doc_id, k.i + 1,
    CASE WHEN fits THEN s ELSE nt END,
    CASE WHEN fits THEN grown ELSE greatest(kept, 0) + 2 + len END, NOT fits, s
  FROM (SELECT *, CASE WHEN nt > i THEN -2 ELSE upto - coalesce((SELECT q.upto FROM pc q WHERE q.doc_id = m.doc_id AND q.i = m.nt - 1), 0) + 2 * (i - nt) END AS kept
        FROM (SELECT ck.doc_id, ck.i, ck.s, p.len, held + p.len + CASE WHEN ck.i >= ck.s THEN 2 ELSE 0 END AS grown, grown <= {size} AS fits, coalesce(o.upto, 0) AS upto,
                     CASE WHEN ck.i < ck.s THEN ck.i + 1 ELSE greatest(ck.s, o.t) END AS nt
              FROM ck JOIN tails p ON p.doc_id = ck.doc_id AND p.i = ck.i + 1 LEFT JOIN tails o ON o.doc_id = ck.doc_id AND o.i = ck.i) m) k),
bounds AS (SELECT doc_id, from_i AS s, i - 1 AS e FROM ck WHERE done UNION ALL SELECT doc_id, s, i FROM ck WHERE i = (SELECT max(i) FROM pc WHERE pc.doc_id = ck.doc_id)),
packed AS (SELECT b.doc_id, b.e, coalesce(string_agg(piece, chr(10) || chr(10) ORDER BY i), '') AS document FROM bounds b LEFT JOIN pc ON pc.doc_id = b.doc_id AND pc.i BETWEEN b.s AND b.e GROUP BY b.doc_id, b.s, b.e),
chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS INTEGER) AS chunk_index, document FROM packed
  UNION ALL SELECT doc_id, 0::INTEGER, {trim.format('text')} FROM documents JOIN total USING (doc_id) WHERE n <= {size})"""


@query(f"WITH RECURSIVE {_sql_chunks()} SELECT doc_id, chunk_index, document FROM chunks")
def chunks_by_size(spark, sf_dir):
    return chunk.chunk_by_size(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "chunk_index", "document")


@query(f"""WITH RECURSIVE {_sql_chunks()} SELECT doc_id, source, chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks,
sha256(doc_id || '|1|' || chunk_index) AS chunk_id FROM chunks JOIN documents USING (doc_id)""")
def chunks_metadata(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return chunk.with_chunk_ids(chunk.chunk_by_size(docs)).drop("document")


# three parts for each document, made from its text: long ones of 350 characters, of which no two fit into a chunk of 512, and
# short ones of 60, which fit beside any; so a chunk ends before each long part but the first
LARGE = [f"CASE WHEN doc_id % {2 << i} >= {1 << i} THEN 1 ELSE 0 END" for i in range(3)]
BODY = [f"rpad(md5(concat(text, '{i}')), CASE WHEN doc_id % {2 << i} >= {1 << i} THEN 350 ELSE 60 END, 'x')" for i in range(3)]
PARTS_SQL = (
    "parts AS (SELECT doc_id, i, body, greatest(sum(large) OVER (PARTITION BY doc_id ORDER BY i) - 1, 0) AS chunk_index, sum(large) OVER (PARTITION BY doc_id) AS n_large FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, {i} AS i, {LARGE[i]} AS large, {BODY[i]} AS body FROM documents" for i in range(3))
    + "))"
)
_HEADS = ["concat('# A', doc_id)", "'## B'", "'# C'"]
_HEADED = "concat(" + ", chr(10), chr(10), ".join(f"{h}, chr(10), chr(10), {b}" for h, b in zip(_HEADS, BODY)) + ")"
_HEAD = f"CASE i WHEN 0 THEN {_HEADS[0]} WHEN 1 THEN {_HEADS[1]} ELSE {_HEADS[2]} END"
_SEMANTIC = f"""WITH {PARTS_SQL} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, string_agg({_HEAD} || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY i) AS document,
regexp_replace(arg_min({_HEAD}, i), '^#+ ', '') AS chapter FROM parts GROUP BY doc_id, chunk_index"""


@query(_SEMANTIC)
def chunks_semantic(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.expr(_HEADED).alias("text"))
    return chunk.chunk_by_heading(rows, size=512, overlap=0).select("doc_id", "chunk_index", "document", "chapter")


@query(f"SELECT left(chapter, 1) AS chapter, count(*) AS chunks FROM ({_SEMANTIC}) GROUP BY left(chapter, 1)")
def chapters(spark, sf_dir):
    return chunks_semantic(spark, sf_dir).groupBy(F.left("chapter", F.lit(1)).alias("chapter")).agg(F.count("*").alias("chunks"))


# with an overlap of 100 a short part that ends a chunk begins the next one too: the second one between two long ones
@query(f"""WITH {PARTS_SQL}, more AS (SELECT doc_id, i, body, chunk_index, true AS fresh FROM parts UNION ALL SELECT doc_id, i, body, 1, false FROM parts WHERE i = 1 AND doc_id % 8 = 5)
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, string_agg({_HEAD} || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY i) AS document,
regexp_replace(arg_min({_HEAD}, i) FILTER (fresh), '^#+ ', '') AS chapter FROM more GROUP BY doc_id, chunk_index""")
def chunks_overlap(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.expr(_HEADED).alias("text"))
    return chunk.chunk_by_heading(rows, size=512, overlap=100).select("doc_id", "chunk_index", "document", "chapter")


def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").cast("int").alias("page"), "text")


_OFFSETS = "SELECT source AS doc, CAST(doc_id AS INTEGER) AS page, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, length(text) AS n FROM documents"


@query(f'SELECT doc, page, start, CAST(start + n AS INTEGER) AS "end" FROM ({_OFFSETS})')
def page_offsets(spark, sf_dir):
    return pages.page_offsets(_pages(spark, sf_dir))


@query(f"""
WITH o AS ({_OFFSETS}), w AS (SELECT source AS doc, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS whole FROM documents GROUP BY source),
c AS (SELECT source AS doc, CAST(doc_id AS INTEGER) AS chunk_index, text AS document, strpos(whole, text) - 1 AS pos FROM documents JOIN w ON w.doc = source)
SELECT c.doc, chunk_index,
  coalesce(arg_min(page, start) FILTER (start <= pos AND pos < start + n + 2), 1) AS page_start,
  coalesce(arg_max(page, start) FILTER (start < pos + length(document)), 1) AS page_end
FROM c JOIN o ON o.doc = c.doc GROUP BY c.doc, chunk_index
""")
def chunk_pages(spark, sf_dir):
    p = _pages(spark, sf_dir).filter("doc IS NOT NULL")
    chunks = p.select("doc", F.col("page").alias("chunk_index"), F.col("text").alias("document"))
    return pages.chunks_on_pages(spread(chunks), p).drop("document")


# the lines of each document as those of a page; equal lines lie at equal heights
LINES_SQL = "(SELECT source AS doc, CAST(doc_id AS INTEGER) AS page, CAST(length(text) * 7 % 100 AS DOUBLE) AS y, 100.0::DOUBLE AS height, text FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text FROM documents))"


def lines(spark, sf_dir) -> DataFrame:
    split = documents(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").cast("int").alias("page"), F.explode(F.split("text", "\n", -1)).alias("text"))
    return split.select("doc", "page", (F.length("text") * 7 % 100).cast("double").alias("y"), F.lit(100.0).alias("height"), "text")


@query(rf"""
WITH l AS {LINES_SQL}, z AS (SELECT doc, page, CASE WHEN y < height * 0.15 THEN 'header' WHEN y > height * 0.85 THEN 'footer' END AS zone, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM l)
SELECT doc, zone, text, count(*) AS n FROM z WHERE zone IS NOT NULL AND text <> '' AND doc IN (SELECT doc FROM l GROUP BY doc HAVING count(DISTINCT page) >= 3) GROUP BY doc, zone, text HAVING count(*) >= 3
""")
def headers_footers(spark, sf_dir):
    return pages.headers_footers(lines(spark, sf_dir))


# the first lines of documents with their spaces as separators of a table
_ROWS = "replace(left(text, 40 + doc_id % 50), ' ', CASE doc_id % 4 WHEN 0 THEN chr(9) WHEN 1 THEN ' | ' WHEN 2 THEN '  ' ELSE ' ' END)"
_COUNT = r"""CASE WHEN strpos({0}, chr(9)) > 0 THEN len(string_split({0}, chr(9)))
WHEN strpos({0}, ' | ') > 0 OR starts_with({0}, '|') THEN len(list_filter(string_split({0}, '|'), lambda p: regexp_matches(p, '\S')))
WHEN len(list_filter(string_split({0}, '  '), lambda p: regexp_matches(p, '\S'))) >= 2 THEN len(list_filter(string_split({0}, '  '), lambda p: regexp_matches(p, '\S'))) END"""


@query(f"SELECT doc_id, CAST({_COUNT.format('line')} AS INTEGER) AS n FROM (SELECT doc_id, split_part({_ROWS}, chr(10), 1) AS line FROM documents)")
def table_columns(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", pages.column_count(F.split(F.expr(_ROWS), "\n")[0]).alias("n"))


# a page is a document: prose, a table row or two, or nothing; the column count of neighbours is equal in some
_PAGE = """CASE doc_id % 6 WHEN 0 THEN left(text, 30) WHEN 5 THEN '' ELSE concat(left(text, 9), chr(10), 'a', chr(9), substr(text, 1, 3), CASE WHEN doc_id % 4 = 0 THEN concat(chr(9), 'z') ELSE '' END) END"""
_PAGE_ROW = "CASE doc_id % 6 WHEN 3 THEN concat('x', chr(9), CAST(doc_id AS {text}), chr(10), 'y', chr(9), 'last', chr(10), ' ') ELSE " + _PAGE + " END"


@query(rf"""
WITH p AS (SELECT source AS doc, doc_id AS page, {_PAGE_ROW.format(text='VARCHAR')} AS text FROM documents),
f AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS filled FROM p),
e AS (SELECT doc, page, text, filled[1] AS top, filled[-1] AS bottom FROM f),
n AS (SELECT doc, page, text, {_COUNT.format('top')} AS a, {_COUNT.format('bottom')} AS z FROM e),
g AS (SELECT *, CASE WHEN lag(z) OVER w = a THEN 0 ELSE 1 END AS starts FROM n WINDOW w AS (PARTITION BY doc ORDER BY page)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY doc ORDER BY page) AS g FROM g)
SELECT doc, CAST(g AS INTEGER) AS page, string_agg(text, chr(10) ORDER BY page) AS text FROM i GROUP BY doc, g
""")
def table_merge(spark, sf_dir):
    page = F.expr(_PAGE_ROW.format(text="STRING"))
    return pages.merge_tables(documents(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), page.alias("text")))
