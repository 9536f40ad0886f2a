"""Queries on stores, versions and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators import store, versions
from corpuslake.plans.literals import frame, values
from corpuslake.plans.texts import table
from corpuslake.sources import datasets, files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _store(spark, sf_dir) -> DataFrame:
    """documents as chunks: the source is the file, its documents in order are its versions."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", (F.col("doc_id") % 7 + 1).cast("int").alias("version"), F.lit(True).alias("is_active"))


_STORE = "(SELECT doc_id, source, CAST(doc_id % 7 + 1 AS INTEGER) AS version, true AS is_active FROM documents)"


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS sources FROM documents")
def corpus_stats(spark, sf_dir):
    return store.stats(table(spark, sf_dir, "documents"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def sources_by_name(spark, sf_dir):
    return store.sources(table(spark, sf_dir, "documents"))


@query(f"SELECT DISTINCT source, version FROM {_STORE}")
def source_versions(spark, sf_dir):
    return store.source_versions(_store(spark, sf_dir))


@query(f"SELECT doc_id, source, version, source <> 'src3' AS is_active FROM {_STORE}")
def archive_source(spark, sf_dir):
    return store.set_active(_store(spark, sf_dir), "src3", False)


@query(f"SELECT doc_id, source, version, source <> 'src3' OR version = 2 AS is_active FROM {_STORE}")
def activate_version(spark, sf_dir):
    return store.set_active(store.set_active(_store(spark, sf_dir), "src3", False), "src3", True, 2)


@query(f"SELECT doc_id, source, version, is_active FROM {_STORE} WHERE source <> 'src3'")
def delete_source(spark, sf_dir):
    return store.without_source(_store(spark, sf_dir), "src3")


@query(f"SELECT count(*) AS deleted FROM {_STORE} WHERE source = 'src3'")
def deleted_count(spark, sf_dir):
    return store.count_source(_store(spark, sf_dir), "src3")


# ---------------------------------------------------------------- versions

_EVENTS = "(SELECT source AS doc_id, source || '.txt' AS file_name, CAST(n_chars % 50 AS INTEGER) AS chunk_count, doc_id AS seq FROM documents)"
_LOG = f"(SELECT *, CAST(row_number() OVER w AS INTEGER) AS version, CAST(lag(chunk_count, 1, 0) OVER w AS INTEGER) AS previous_chunk_count, CAST(chunk_count - lag(chunk_count, 1, 0) OVER w AS INTEGER) AS delta FROM {_EVENTS} WINDOW w AS (PARTITION BY doc_id ORDER BY seq))"
WANTED = [("src0", 2, 10_000_001), ("src1", 0, 10_000_002), ("src2", 99_999, 10_000_003), ("src3", 1, 10_000_004), ("src3", 4, 10_000_005), ("none", 1, 10_000_006)]
_WANTED = values(WANTED, "doc_id, target, seq")


def _log(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return versions.version_log(docs.select(F.col("source").alias("doc_id"), F.concat("source", F.lit(".txt")).alias("file_name"), (F.col("n_chars") % 50).cast("int").alias("chunk_count"), F.col("doc_id").alias("seq")))


def _wanted(spark) -> DataFrame:
    return frame(spark, WANTED, "doc_id string, target int, seq bigint")


@query(f"SELECT * FROM {_LOG}")
def version_log(spark, sf_dir):
    return _log(spark, sf_dir)


@query(f"SELECT doc_id, version, chunk_count FROM {_LOG}")
def version_list(spark, sf_dir):
    return versions.list_versions(_log(spark, sf_dir)).select("doc_id", "version", "chunk_count")


@query(f"SELECT w.doc_id, target, seq, coalesce(target BETWEEN 1 AND n, false) AS done FROM {_WANTED} w LEFT JOIN (SELECT doc_id, max(version) AS n FROM {_LOG} GROUP BY doc_id) USING (doc_id)")
def rollback_state(spark, sf_dir):
    return versions.rollbacks(_log(spark, sf_dir), _wanted(spark))


@query(f"""WITH l AS {_LOG}, done AS (SELECT w.doc_id, target AS version, w.seq FROM {_WANTED} w JOIN (SELECT doc_id, max(version) AS n FROM l GROUP BY doc_id) USING (doc_id) WHERE target BETWEEN 1 AND n)
SELECT doc_id, arg_max(version, seq) AS active_version FROM (SELECT doc_id, version, seq FROM l UNION ALL SELECT * FROM done) GROUP BY doc_id""")
def active_version(spark, sf_dir):
    return versions.active_versions(versions.pointers(_log(spark, sf_dir), _wanted(spark)))


@query(f"SELECT DISTINCT doc_id FROM {_LOG}")
def version_doc_ids(spark, sf_dir):
    return _log(spark, sf_dir).select("doc_id").distinct()


@query("SELECT page_id, translate(url, '/\\', '__') AS safe FROM pages")
def safe_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", versions.safe_id(F.col("url")).alias("safe"))


# ---------------------------------------------------------------- sessions, metadata, datasets


@query("SELECT conv_id, CAST(count(*) // 2 AS BIGINT) AS turns FROM conversations GROUP BY conv_id")
def session_turns(spark, sf_dir):
    return store.session_turns(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_session(spark, sf_dir):
    return store.last_message(table(spark, sf_dir, "conversations"))


@query("SELECT page_id, md5(html) AS doc_id, url AS source, regexp_extract(url, '([^/\\\\]*)$', 1) AS file_name, octet_length(encode(html)) AS file_size, 'active' AS status, 'web' AS business_line FROM pages")
def file_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.col("html").cast("binary").alias("content"), F.octet_length("html").cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return files.metadata(rows, "web").select("page_id", "doc_id", "source", "file_name", "file_size", "status", "business_line")


@query(f"SELECT * FROM {values([(i, q, '|'.join(r)) for i, (q, r) in enumerate(datasets.BUILTIN)], 'query_id, question, relevant')}")
def builtin_dataset(spark, sf_dir):
    return datasets.builtin_dataset(spark).select("query_id", "question", F.array_join("relevant_texts", "|").alias("relevant"))
