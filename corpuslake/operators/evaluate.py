"""Evaluation: recall and reciprocal rank of retrieval, and reports of a judging model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake import schemas
from corpuslake.functions.strings import is_blank
from corpuslake.sources import clients

NO_EVIDENCE = "无依据"  # fixed value: the verdict of a claim that names none


def hit_at(docs: Column, relevant: Column, k: int) -> Column:
    """Whether a relevant text lies in the first k documents joined by spaces."""
    text = F.array_join(F.slice(docs, 1, k), " ")
    return F.exists(relevant, lambda x: F.contains(text, x))


def question_hits(dataset: DataFrame, hits: DataFrame, top_k: int = 5) -> DataFrame:
    """(query_id, question, docs, top_k_hits, first_rank, recalled) for every valid row of dataset (query_id, question, relevant_texts)."""
    lists = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))), lambda x: x["document"]).alias("docs"))
    valid = dataset.filter((F.coalesce(F.length("question"), F.lit(0)) > 0) & (F.coalesce(F.size("relevant_texts"), F.lit(0)) > 0))
    joined = valid.join(lists, "query_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    flags = F.array(*(hit_at(F.col("docs"), F.col("relevant_texts"), k) for k in range(1, top_k + 1)))
    out = joined.select("query_id", "question", "docs", flags.alias("flags"))
    first = F.array_position("flags", True)
    hit_map = F.map_from_arrays(F.array(*map(F.lit, range(1, top_k + 1))), F.col("flags"))
    return out.select("query_id", "question", "docs", hit_map.alias("top_k_hits"), F.when(first > 0, first).otherwise(-1).cast("int").alias("first_rank"), F.element_at("flags", -1).alias("recalled"))


def recall_summary(details: DataFrame, top_k: int = 5) -> DataFrame:
    """One row: total, hit_count, recall_1, recall_3, recall_5 and mrr; 0 for a depth beyond top_k and for no rows."""

    def share(k: int) -> Column:
        return F.round(F.coalesce(F.avg(F.element_at("top_k_hits", F.lit(k)).cast("double")), F.lit(0.0)), 4) if k <= top_k else F.lit(0.0)

    mrr = F.round(F.coalesce(F.avg(F.when(F.col("first_rank") > 0, 1.0 / F.col("first_rank")).otherwise(0.0)), F.lit(0.0)), 4)
    return details.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("recalled").cast("long")), F.lit(0)).alias("hit_count"), *(share(k).alias(f"recall_{k}") for k in (1, 3, 5)), mrr.alias("mrr"))


def misses(details: DataFrame) -> DataFrame:
    """(query_id, question, snippet): questions that found nothing, with what came first."""
    return details.filter(~F.col("recalled")).select("query_id", "question", F.coalesce(F.substring(F.get("docs", F.lit(0)), 1, 100), F.lit("")).alias("snippet"))


def parse_report(raw: Column) -> Column:
    """A judge's report from the outermost braces of its answer; `error` is set where there is no JSON.

    Counts of the summary win over the claims; recomputed_score is (supported + partial / 2) / total.
    """
    data = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schemas.JUDGE, {"mode": "PERMISSIVE"})
    claims = F.coalesce(data["claims"], F.array().cast("array<struct<text:string,verdict:string,evidence:string,citation_check:struct<citations_found:array<string>,accuracy:string>>>"))
    claims = F.transform(
        claims,
        lambda c: F.struct(F.coalesce(c["text"], F.lit("")).alias("text"), F.coalesce(c["verdict"], F.lit(NO_EVIDENCE)).alias("verdict"), F.coalesce(c["evidence"], F.lit("")).alias("evidence"), c["citation_check"].alias("citation_check")),
    )
    s = data["summary"]
    found = ~(data["claims"].isNull() & s.isNull())
    count = lambda k: F.coalesce(s[k], F.lit(0)).alias(k)
    total = F.coalesce(s["total_claims"], F.size(claims))
    recomputed = F.when(total > 0, (F.coalesce(s["supported"], F.lit(0)) + 0.5 * F.coalesce(s["partial"], F.lit(0))) / total).otherwise(0.0)
    error = F.when(~F.coalesce(found, F.lit(False)) & (~raw.rlike(r"(?s)\{.*\}") | F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)).isNull()), F.lit("no JSON report"))
    return F.struct(
        claims.alias("claims"),
        F.when(error.isNull(), total).otherwise(0).alias("total_claims"),
        *(count(k) for k in ("supported", "contradicted", "unsupported", "partial", "citation_correct", "citation_wrong", "citation_fabricated")),
        F.coalesce(s["faithfulness_score"], F.lit(0.0)).alias("faithfulness_score"),
        recomputed.alias("recomputed_score"),
        error.alias("error"),
    )


def judge_guard(answer: Column, context: Column) -> Column:
    """What a blank answer or context gives without a call: a struct of score, unsupported and error; else null."""
    kind = "struct<faithfulness_score:double,total_claims:int,unsupported:int,error:string>"
    make = lambda score, n, error: F.struct(F.lit(score).alias("faithfulness_score"), F.lit(n).alias("total_claims"), F.lit(n).alias("unsupported"), F.lit(error).alias("error")).cast(kind)
    return F.when(is_blank(answer), make(1.0, 0, "blank answer")).when(is_blank(context), make(0.0, 1, "blank context"))


JUDGE_TEMPLATE = """Check whether an answer keeps to its numbered reference passages.
1. Take the answer apart into claims that can each be checked.
2. Give each claim a verdict (支持, 矛盾, 无依据 or 部分支持) with the passage that shows it.
3. Check each citation [来源:n]: does that passage hold the claim (正确), not hold it (错误), or not exist (虚构)?
Reply with JSON only: {"claims": [{"text", "verdict", "evidence", "citation_check": {"citations_found": [], "accuracy"}}],
"summary": {"total_claims", "supported", "contradicted", "unsupported", "partial", "citation_correct", "citation_wrong", "citation_fabricated", "faithfulness_score"}}
where faithfulness_score = (supported + 0.5 * partial) / total_claims.

References:
{context}

Question:
{question}

Answer:
{answer}"""


def judge_prompt(context: Column, question: Column, answer: Column) -> Column:
    out = F.lit(JUDGE_TEMPLATE)
    for name, value in (("context", context), ("question", question), ("answer", answer)):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def faithfulness(df: DataFrame, model: clients.LanguageModel) -> DataFrame:
    """df (with question, context and answer) and a judge's report: guarded rows make no call, failed calls give an error."""
    guarded = df.withColumn("guard", judge_guard(F.col("answer"), F.col("context")))
    asked = guarded.withColumn("judge", F.when(F.col("guard").isNull(), judge_prompt(F.col("context"), F.col("question"), F.col("answer"))))
    parsed = clients.answered(asked, model, "judge", "report").withColumn("r", parse_report(F.col("report")))
    pick = lambda k: F.coalesce(F.col(f"guard.{k}"), F.col(f"r.{k}")).alias(k)
    error = F.when(F.col("guard").isNotNull(), F.col("guard.error")).otherwise(F.coalesce("report_error", "r.error")).alias("error")
    return parsed.select(*df.columns, pick("faithfulness_score"), pick("total_claims"), pick("unsupported"), F.col("r.claims").alias("claims"), error)
