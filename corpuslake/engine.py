"""The engine: indexing, search, answers, versions and evaluation over one folder of tables.

Beside the chunks it keeps what searches read, under `search`: the chunks with ordinals, postings laid out by token,
lengths and statistics. Indexing brings them up to date: new files are appended; a change of stored chunks makes
them stale, and they are written anew once. Searches only read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake import schemas
from corpuslake.config import EngineConfig
from corpuslake.functions.fingerprint import simhash
from corpuslake.operators import bm25, chunk, context, dedup, evaluate, hybrid, store, vector, versions
from corpuslake.operators.common import materialize, small
from corpuslake.sources import clients, files

Chunker = Callable[..., DataFrame]
#: Says that the search tables are up to date; named for their layout, so that tables of an earlier one are written anew.
READY = "search/READY-blocks"


class Engine:
    def __init__(self, spark: SparkSession, home: str, embedder: clients.Embedder | None = None, model: clients.LanguageModel | None = None, config: EngineConfig | None = None, pdf_parser=None):
        self.spark, self.home = spark, home.rstrip("/")
        self.embedder, self.model = embedder or clients.HashEmbedder(), model or clients.EchoModel()
        self.config, self.pdf_parser = config or EngineConfig.from_env(), pdf_parser
        self._chunk_path = f"{self.home}/chunks"
        store.recover(spark, self._chunk_path)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def _table(self, name: str, schema: str) -> DataFrame:
        if self._exists(name):
            return self.spark.read.schema(schema).parquet(f"{self.home}/{name}")
        return self.spark.createDataFrame([], schema)

    @property
    def chunks(self) -> DataFrame:
        return store.scan(self.spark, self._chunk_path) if self._exists("chunks") else self.spark.createDataFrame([], schemas.CHUNKS)

    @property
    def fingerprints(self) -> DataFrame:
        """Fingerprints of all chunks that were kept by any run."""
        return self._table("fingerprints", schemas.FINGERPRINTS)

    @property
    def vectors(self) -> DataFrame:
        """Vectors by the hash of their text and the embedder's identity; a text is sent once."""
        return self._table("vectors", schemas.VECTORS)

    @property
    def failures(self) -> DataFrame:
        """Files that a run left out, as they couldn't be read or a text of theirs had no vector; later runs take them up again."""
        return self._table("failures", schemas.FAILURES)

    @property
    def log(self) -> DataFrame:
        return self._table("version_log", schemas.VERSION_LOG)

    @property
    def pointer_log(self) -> DataFrame:
        return self._table("pointers", schemas.POINTER_LOG)

    # ------------------------------------------------------------ indexing

    def index(self, root: str, force: bool = False, semantic: bool = False, history: bool = False) -> DataFrame:
        """Indexes the new files under root; one row of counts."""
        return self.index_files(files.scan(self.spark, root), force, semantic, history=history)

    def index_files(self, found: DataFrame, force: bool = False, semantic: bool = False, replace: bool = False, history: bool = False) -> DataFrame:
        """Scan, file dedup, archiving, loading, chunking, chunk dedup in two layers, embedding, storing and versions, as one batch.

        Chunks are held against each other's fingerprints, and against the vectors of the stored active chunks (those
        that reach cosine_duplicate are dropped; a value over 1 turns this off). A text is sent to the embedder only if no
        run has its vector yet. A file whose parser failed, or with a text that has no vector, goes to failures: it isn't
        stored, what is stored of its source stays, and a later run takes it up again. history holds them against the
        fingerprints of earlier runs too. replace deletes a source's old chunks; otherwise they stay with is_active
        false. As sources are archived before their text is known, a source that gives no text keeps archived chunks
        only. Chunks are stored before versions and fingerprints are logged; what a batch that failed between didn't log
        is logged by the next one.
        """
        if not self._ready():
            self._recover()
        valid = files.metadata(files.validated(found))
        fresh = valid if force else dedup.new_files(valid, self.chunks)
        fresh = materialize(fresh, "files")
        texts = files.load(fresh, self.pdf_parser).drop("path", "modificationTime", "length", "content", "oversize")
        texts = materialize(texts, "texts")
        unread = texts.filter("load_error IS NOT NULL").select("source", "doc_id", F.lit("load").alias("stage"), F.col("load_error").alias("error"))
        split: Chunker = chunk.chunk_by_heading if semantic else chunk.chunk_by_size
        parts = split(texts.filter("load_error IS NULL").drop("load_error"), "text", self.config.chunk_size, self.config.chunk_overlap)
        parts = materialize(parts.filter("document IS NOT NULL"), "parts")
        order = F.struct(F.lower("file_name").alias("f"), "source", "chunk_index").alias("doc")
        keyed = parts.select(order, "*")
        marks = simhash(keyed, "doc", "document")
        seen = self.fingerprints if history else None
        kept = materialize(dedup.filter_chunks(keyed.join(marks, "doc"), self.config.hamming_threshold, history=seen), "kept")
        kept, unsent = self._embedded(kept.drop("doc"))
        failed = materialize(unread.unionByName(unsent).withColumn("seq", F.unix_micros(F.current_timestamp())), "failed")
        failed.write.mode("append").parquet(f"{self.home}/failures")
        retired = self._retire(fresh.join(failed.select("doc_id"), "doc_id", "left_anti"), replace)
        kept = self._vector_layer(materialize(kept.join(failed.select("doc_id"), "doc_id", "left_anti"), "embedded"))
        counts = materialize(kept.groupBy("doc_id", "file_name").agg(F.count("*").cast("int").alias("chunk_count")), "counts")
        numbered = self._next_versions(counts)
        rows = kept.drop("simhash").join(numbered.select("doc_id", "version"), "doc_id").withColumn("is_active", F.lit(True))
        rows = materialize(chunk.with_chunk_ids(rows), "rows")
        ready = not retired and self._ready()
        self._stale()
        store.add(rows, self._chunk_path)
        kept.select("doc_id", "chunk_index", "simhash").write.mode("append").parquet(f"{self.home}/fingerprints")
        self._record(numbered)
        self._append_search(rows) if ready else self.refresh()
        return counts.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))

    def _embedded(self, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunks with vectors, failures of documents): distinct texts without a kept vector are sent, and their vectors kept."""
        made = clients.identity(self.embedder)
        hashed = kept.withColumn("text_hash", F.sha2(F.col("document").cast("binary"), 256))
        wanted = materialize(hashed.groupBy("text_hash").agg(F.first("document").alias("document")), "wanted")
        known = self.vectors.filter(F.col("embedder") == made).select("text_hash", "embedding")
        found = materialize(known.join(small(wanted.select("text_hash")), "text_hash", "left_semi").dropDuplicates(["text_hash"]), "found")
        unseen = wanted.join(found.select("text_hash"), "text_hash", "left_anti")
        sent = materialize(clients.attempted(unseen, self.embedder, "document").drop("document"), "sent")
        new = sent.filter("embedding_error IS NULL").select("text_hash", "embedding")
        new.select("text_hash", F.lit(made).alias("embedder"), "embedding").write.mode("append").parquet(f"{self.home}/vectors")
        lost = sent.filter("embedding_error IS NOT NULL").select("text_hash", "embedding_error")
        errors = hashed.join(lost, "text_hash").groupBy("source", "doc_id").agg(F.lit("embed").alias("stage"), F.min("embedding_error").alias("error"))
        return hashed.join(found.unionByName(new), "text_hash").drop("text_hash"), errors

    def _vector_layer(self, kept: DataFrame) -> DataFrame:
        """Chunks that no stored active chunk is too near to."""
        live = self.chunks.filter("is_active")
        if self.config.cosine_duplicate > 1 or live.isEmpty():
            return kept
        numbered = materialize(kept.withColumn("_id", F.monotonically_increasing_id()), "numbered")
        stored = live.select(F.xxhash64("chunk_id").alias("doc"), "embedding")  # which of them it is doesn't matter
        near = vector.vector_duplicates(numbered.select(F.col("_id").alias("query_id"), F.col("embedding").alias("vector")), stored, self.config.cosine_duplicate)
        return materialize(numbered.join(near.select(F.col("query_id").alias("_id")), "_id", "left_anti").drop("_id"), "kept")

    def _retire(self, fresh: DataFrame, replace: bool) -> bool:
        gone = fresh.select("source").distinct()
        numbers = store.buckets(self.chunks.select("source").join(gone, "source", "left_semi"))
        if not numbers:
            return False

        def change(chunks: DataFrame) -> DataFrame:
            marked = chunks.join(gone.withColumn("_gone", F.lit(True)), "source", "left")
            return (marked.filter("_gone IS NULL") if replace else marked.withColumn("is_active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("is_active")))).drop("_gone")

        self._change(numbers, change)
        return True

    def _change(self, numbers: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Writes some buckets of the chunk table anew."""
        self._stale()
        store.replace(change(store.scan(self.spark, self._chunk_path, numbers)), self._chunk_path, numbers)

    def _next_versions(self, counts: DataFrame) -> DataFrame:
        before = self.log.groupBy("doc_id").agg(F.max_by("version", "seq").alias("v"), F.max_by("chunk_count", "seq").alias("n"), F.max("seq").alias("s"))
        joined = counts.join(before, "doc_id", "left")
        new = joined.select(
            "doc_id",
            "file_name",
            (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("version"),
            "chunk_count",
            (F.col("chunk_count") - F.coalesce("n", F.lit(0))).cast("int").alias("delta"),
            F.current_timestamp().alias("created_at"),
            F.unix_micros(F.current_timestamp()).alias("seq"),
        )
        return materialize(new, "versions")

    def _record(self, new: DataFrame) -> None:
        new.write.mode("append").parquet(f"{self.home}/version_log")
        new.select("doc_id", "version", "seq").write.mode("append").parquet(f"{self.home}/pointers")

    def _recover(self) -> None:
        """Logs stored versions that the log lacks, with their fingerprints."""
        stored = self.chunks.filter("version IS NOT NULL").groupBy("doc_id", "file_name", "version").agg(F.count("*").cast("int").alias("chunk_count"))
        lost = materialize(stored.join(self.log.select("doc_id", "version"), ["doc_id", "version"], "left_anti"), "lost")
        if lost.isEmpty():
            return
        rows = self.chunks.join(lost.select("doc_id", "version"), ["doc_id", "version"], "left_semi").withColumn("doc", F.col("chunk_id"))
        marks = rows.select("doc", "doc_id", "chunk_index").join(simhash(rows, "doc", "document"), "doc")
        marks.select("doc_id", "chunk_index", "simhash").write.mode("append").parquet(f"{self.home}/fingerprints")
        counts = lost.select("doc_id", "file_name", "chunk_count")
        self._record(materialize(self._next_versions(counts).drop("version").join(lost.select("doc_id", "version"), "doc_id").select(*self.log.columns), "versions"))

    # ------------------------------------------------------------ what searches read

    def _ready(self) -> bool:
        return self._exists(READY)

    def _stale(self) -> None:
        path, fs = self._path(READY)
        fs.delete(path, False)

    def _set_ready(self) -> None:
        path, fs = self._path(READY)
        fs.create(path, True).close()

    def refresh(self) -> None:
        """Writes the search tables anew: ordinals follow the file order."""
        self._stale()
        order = F.lower("file_name"), F.col("source"), F.col("chunk_index")
        ordered = self.chunks.repartitionByRange(*order).sortWithinPartitions(*order)
        ordered.withColumn("doc", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.home}/search/store")
        bm25.build_index(self._stored(), written=True).write(f"{self.home}/search")
        self._set_ready()

    def _append_search(self, rows: DataFrame) -> None:
        """Adds new chunks behind the ordinals there are."""
        base = self._stored().agg(F.coalesce(F.max("doc") + 1, F.lit(0))).first()[0]
        columns = self._stored().columns
        placed = self.chunks.join(rows.select("chunk_id"), "chunk_id", "left_semi")
        order = F.lower("file_name"), F.col("source"), F.col("chunk_index")
        placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.lit(base) + F.monotonically_increasing_id())
        placed = materialize(placed.select(*columns), "placed")
        placed.write.mode("append").parquet(f"{self.home}/search/store")
        bm25.build_index(placed, written=True).append(f"{self.home}/search")
        self._set_ready()

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{schemas.CHUNKS}, doc bigint").parquet(f"{self.home}/search/store")

    def search_tables(self) -> tuple[DataFrame, bm25.Index]:
        """(chunks with ordinals, index), read from their tables; written first only if chunks have changed since."""
        if not self._ready():
            self.refresh()
        return self._stored(), bm25.Index.read(self.spark, f"{self.home}/search")

    # ------------------------------------------------------------ search and answers

    def query_frame(self, questions: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(questions)), "query_id bigint, question string")
        return clients.embedded(rows, self.embedder, "question", "vector")

    def search(self, questions: list[str] | DataFrame, top_k: int | None = None, **options) -> DataFrame:
        asked = self.query_frame(questions) if isinstance(questions, list) else questions
        rows, index = self.search_tables()
        return hybrid.search(index, rows, asked, top_k=top_k or self.config.top_k, **options)

    def prompts(self, questions: list[str], top_k: int | None = None, threshold: float | None = None) -> DataFrame:
        """(query_id, question, context, prompt, stopped); the threshold is the configured one unless told."""
        hits = self.search(questions, top_k, threshold=self.config.similarity_threshold if threshold is None else threshold)
        contexts = context.trim(context.parts(hits), self.config.context_chars)
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id bigint, question string")
        joined = asked.join(contexts, "query_id", "left").withColumn("stopped", context.guard(F.col("context"), F.col("question")))
        return joined.withColumn("prompt", F.when(F.col("stopped").isNull(), context.prompt(F.col("context"), F.col("question"))))

    def ask(self, questions: list[str], top_k: int | None = None, threshold: float | None = None) -> DataFrame:
        return clients.answered(self.prompts(questions, top_k, threshold), self.model)

    # ------------------------------------------------------------ management

    def stats(self) -> DataFrame:
        return store.stats(self.chunks)

    def delete(self, source: str) -> int:
        """Deletes a source's chunks and tells how many they were."""
        if not self._exists("chunks"):
            return 0
        numbers = [store.bucket_of(self.spark, source)]
        n = store.scan(self.spark, self._chunk_path, numbers).filter(F.col("source") == source).count()
        if n:
            self._change(numbers, lambda chunks: store.without_source(chunks, source))
        return n

    def delete_all(self) -> int:
        n = self.chunks.count()
        if n:
            self._change(list(range(store.BUCKETS)), lambda chunks: chunks.limit(0))
        return n

    def versions(self, doc_id: str | None = None) -> DataFrame:
        return versions.list_versions(self.log, doc_id)

    def documents_of(self, source: str) -> list[str]:
        """The ids that a source's chunks have or had, by its path, its URI or its file name; one for each content it had."""
        bare = source.rsplit("/", 1)[-1]
        path = F.regexp_replace("source", "^[a-z]+:/*/", "/")
        mine = (F.col("source") == source) | (path == F.lit(source)) | ((F.col("file_name") == source) if bare == source else F.lit(False))
        return [r.doc_id for r in self.chunks.filter(mine).select("doc_id").distinct().orderBy("doc_id").collect()]  # the contents of one file

    def source_versions(self, source: str) -> DataFrame:
        """Versions of a file by its path or name, over all contents it had."""
        return versions.list_versions(self.log).filter(F.col("doc_id").isin(self.documents_of(source)))

    def rollback_source(self, source: str, version: int) -> bool:
        """Rolls back the document of a file that has this version; of several the one logged last."""
        wanted = self.log.filter(F.col("doc_id").isin(self.documents_of(source)) & (F.col("version") == version)).orderBy(F.desc("seq")).first()
        return bool(wanted) and self.rollback(wanted.doc_id, version)

    def active_version(self, doc_id: str) -> int:
        one = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        return versions.active_versions(self.pointer_log, one).first()["active_version"]

    def rollback(self, doc_id: str, version: int) -> bool:
        """Points at an earlier version and makes just its chunks active; False if there is no such version."""
        wanted = self.spark.createDataFrame([(doc_id, version)], "doc_id string, target int").withColumn("seq", F.unix_micros(F.current_timestamp()))
        done = versions.rollbacks(self.log, wanted).first()["done"]
        if done:
            wanted.select("doc_id", F.col("target").alias("version"), "seq").write.mode("append").parquet(f"{self.home}/pointers")
            mine = F.col("doc_id") == doc_id
            numbers = store.buckets(self.chunks.filter(mine).select("source"))
            self._change(numbers, lambda chunks: chunks.withColumn("is_active", F.when(mine, F.col("version") == version).otherwise(F.col("is_active"))))
        return done

    # ------------------------------------------------------------ evaluation

    def evaluate_recall(self, dataset: DataFrame, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
        """(details, summary) of a dataset (query_id, question, relevant_texts)."""
        asked = clients.embedded(dataset.select("query_id", "question").filter("question <> ''"), self.embedder, "question", "vector")
        details = materialize(evaluate.question_hits(dataset, self.search(asked, top_k), top_k), "details")
        return details, evaluate.recall_summary(details, top_k)

    def evaluate_faithfulness(self, questions: list[str], top_k: int | None = None, threshold: float | None = None) -> DataFrame:
        """The judging model's report on the engine's own answers: claims, counts, faithfulness_score and error beside each question."""
        return evaluate.faithfulness(materialize(self.ask(questions, top_k, threshold), "answers"), self.model)

    def index_tables(self) -> bm25.Index:
        return self.search_tables()[1]
