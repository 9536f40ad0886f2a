"""Context assembly, trimming, prompts and source lists, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.functions.strings import basename, is_blank

CONFIG = EngineConfig()

# The separator, the label of a part, the remainder worth filling, and a snippet's length.
SEPARATOR = "\n\n---\n\n"
LABEL = ("[来源 ", " - ", "]\n")
LEAST_REMAINDER = 100
SNIPPET = 200

SYSTEM_PROMPT = (
    "Answer from the numbered reference passages alone. Support each statement by a passage and cite it as [来源:n]. "
    "Where the passages contradict each other or are incomplete, say so; where they don't hold the answer, say that it can't be given and what is missing."
)
QUESTION_TEMPLATE = "References:\n\n{context}\n\nQuestion:\n\n{question}\n\nAnswer:"


def parts(hits: DataFrame) -> DataFrame:
    """(query_id, rank, part) of hits (query_id, rank, source, document)."""
    return hits.select("query_id", "rank", F.concat(F.lit(LABEL[0]), F.col("rank").cast("string"), F.lit(LABEL[1]), basename(F.col("source")), F.lit(LABEL[2]), F.col("document")).alias("part"))


def pack(rows: DataFrame) -> DataFrame:
    """(query_id, context): the parts (query_id, rank, part) in order of rank."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"])
    return rows.groupBy("query_id").agg(F.array_join(ordered, SEPARATOR).alias("context"))


def trim(rows: DataFrame, limit: int = CONFIG.context_chars) -> DataFrame:
    """(query_id, context) of at most limit characters: whole parts while they fit, then as much of the next one as leaves over LEAST_REMAINDER."""
    w = Window.partitionBy("query_id").orderBy("rank")
    sep = len(SEPARATOR)
    total = F.sum(F.length("part") + sep).over(w) - sep
    alone = F.count("*").over(Window.partitionBy("query_id")) == 1
    first_misfit = F.min(F.when(F.col("total") > limit, F.col("rank"))).over(Window.partitionBy("query_id"))
    sized = rows.withColumn("total", total).withColumn("alone", alone).withColumn("misfit", first_misfit)
    left = F.lit(limit) - (F.col("total") - F.length("part"))
    cut = F.when(F.col("misfit").isNull() | (F.col("rank") < F.col("misfit")), F.col("part")).when((F.col("rank") == F.col("misfit")) & (F.col("alone") | (left > LEAST_REMAINDER) | ((F.col("total") == F.length("part")) & (left > 0))), F.substring(F.col("part"), F.lit(1), left.cast("int")))
    kept = sized.select("query_id", "rank", cut.alias("part")).filter("part IS NOT NULL")
    return pack(kept)


def trim_text(context: Column, limit: int = CONFIG.context_chars) -> Column:
    """trim() of one joined context, as an expression."""
    sep = len(SEPARATOR)
    pieces = F.split(context, r"\n\n---\n\n", -1)
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, part: Column) -> Column:
        glue = F.when(acc["n"] > 0, F.lit(SEPARATOR)).otherwise(F.lit(""))
        room = F.lit(limit) - F.length(acc["kept"]) - F.when(acc["n"] > 0, F.lit(sep)).otherwise(F.lit(0))
        fits = F.length(part) <= room
        taken = F.when(fits, F.concat(acc["kept"], glue, part)).when(room > LEAST_REMAINDER, F.concat(acc["kept"], glue, F.substring(part, F.lit(1), room))).otherwise(acc["kept"])
        return F.struct(F.when(acc["full"], acc["kept"]).otherwise(taken).alias("kept"), (acc["n"] + 1).alias("n"), (acc["full"] | ~fits).alias("full"))

    packed = F.aggregate(pieces, start, step, lambda a: a["kept"])
    return F.when(F.length(context) <= limit, context).when(F.size(pieces) <= 1, F.substring(context, 1, limit)).otherwise(F.when(packed == "", F.substring(context, 1, limit)).otherwise(packed))


def prompt(context: Column, question: Column) -> Column:
    """The whole prompt as one text."""
    filled = F.replace(F.lit(QUESTION_TEMPLATE), F.lit("{context}"), context)
    return F.concat(F.lit(SYSTEM_PROMPT + "\n\n"), F.replace(filled, F.lit("{question}"), question))


def guard(context: Column, question: Column) -> Column:
    """What stops a call: 'blank question', 'blank context' or null."""
    return F.when(is_blank(question), F.lit("blank question")).when(is_blank(context), F.lit("blank context"))


def source_list(hits: DataFrame) -> DataFrame:
    """(query_id, index, file, path, score, snippet) for display."""
    return hits.select("query_id", F.col("rank").alias("index"), basename(F.col("source")).alias("file"), F.col("source").alias("path"), "score", F.substring("document", 1, SNIPPET).alias("snippet"))
