"""Benchmark decontamination: a prefix-filtered set join over item-sized windows, with DataFrame operations only.

Every window of `size` consecutive item words must occur whole (containment 1), so its necessary prefix is one
token: its rarest word, by counts over all documents. Windows with a word that no document has are pruned.
Documents give only the places of prefix tokens, each with the words around it; the join on the token fixes
where the window would begin (positional bound) and that it fits (length bound), and array equality verifies it.

Null and empty texts have no words and no hits; texts of any length are taken whole; of equally rare words of a window
the first by name is its prefix; repeated rows get equal results each; items without words have
no window; an item with a null id makes hits but isn't counted or listed; empty tables give an empty or clean result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import bitmap_of, materialize, maybe_in, row_key, without_keys, words

#: Up to so many prefix tokens are tested as a literal set within the scan, beyond by a bitmap of their hashes; and so
#: many rows of item data are broadcast; beyond, the same rows are joined by a shuffle.
LITERAL_TOKENS = 20_000
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, win): each run of `size` consecutive words; an item of fewer, but not none, is one window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    split = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("win"))


def prefix_tokens(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(win_id, win, token, at): the rarest word of each distinct window and its offset there."""
    placed = windows.select(F.posexplode("win").alias("at", "token"), "win_id", "win")
    vocabulary = materialize(placed.select("token").distinct(), "vocabulary")
    tokens = docs.select(F.explode(words(F.col("text"))).alias("token"))
    counted = tokens.join(_small(vocabulary, vocabulary.count()), "token").groupBy("token").count()
    counts = materialize(counted, "counts")
    ranked = placed.join(counts, "token", "left").select("win_id", "win", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "at").alias("rank"))
    rarest = ranked.groupBy("win_id").agg(F.first("win").alias("win"), F.min("rank").alias("rank"))
    return rarest.filter("rank.n > 0").select("win_id", "win", F.col("rank.token").alias("token"), F.col("rank.at").alias("at"))


def contained_windows(docs: DataFrame, items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """base (row_key, doc_id, n_words), hits (row_key, start, length, win_id) and owners (win_id, item_id).

    row_key stands for the id and the text, so that documents which share an id don't mix.
    """
    raw = item_windows(items, size).withColumn("win_id", F.unhex(F.md5(F.array_join("win", " ").cast("binary"))))  # 128 bits tell the windows apart
    owners = materialize(raw.select("win_id", "item_id", "win").distinct(), "windows")
    windows = owners.select("win_id", "win").distinct()
    prefixes = materialize(prefix_tokens(docs, windows), "prefixes")

    distinct = prefixes.select("token").distinct()
    few = [r.token for r in distinct.limit(LITERAL_TOKENS + 1).collect()]  # bounded: else the bitmap leaves out nearly all other words
    split = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), words(F.col("text")).alias("w"))
    places = F.sequence(F.lit(0), F.size("w") - 1)
    if len(few) <= LITERAL_TOKENS:
        places = F.filter(places, lambda i: F.get("w", i).isin(few)) if few else F.array().cast("array<int>")
    else:
        split = split.withColumn("_one", F.lit(1)).join(F.broadcast(bitmap_of(distinct)), "_one")  # one row
        places = F.filter(places, lambda i: maybe_in(F.get("w", i)))
    around = F.transform(
        F.when(F.size("w") > 0, places),
        lambda i: F.struct(i.alias("pos"), F.get("w", i).alias("token"), F.greatest(i - (size - 1), F.lit(0)).alias("first"), F.slice("w", F.greatest(i - (size - 1), F.lit(0)) + 1, 2 * size - 1).alias("near")),
    )
    base = materialize(split.select("doc_id", "row_key", F.size("w").alias("n_words"), around.alias("places")), "places")

    found = base.select("row_key", "n_words", F.explode("places").alias("p")).select("row_key", "n_words", "p.*")
    joined = found.join(_small(prefixes, prefixes.count()), "token")
    start, length = F.col("pos") - F.col("at"), F.size("win")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    same = F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, length) == F.col("win")
    hits = joined.filter(fits & same).select("row_key", start.alias("start"), length.alias("length"), "win_id").distinct()
    return base.select("row_key", "doc_id", F.col("n_words").cast("long").alias("n_words")), materialize(hits, "hits"), owners.select("win_id", "item_id")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    base, hits, owners = contained_windows(docs, items, size)
    positions = hits.select("row_key", F.explode(F.sequence("start", F.expr("start + length - 1"))).alias("pos")).distinct()
    n_hit = positions.groupBy("row_key").agg(F.count("*").alias("n_hit"))
    pairs = hits.select("row_key", "win_id").distinct().join(owners, "win_id").select("row_key", F.col("item_id").cast("string").alias("item")).distinct()
    listed = pairs.groupBy("row_key").agg(F.count("item").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    per_doc = n_hit.join(listed, "row_key", "full")
    return base.join(per_doc, "row_key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs that hold no window of any item; rows with null or empty texts stay."""
    _, hits, _ = contained_windows(docs, items, size)
    return without_keys(docs, row_key(docs.doc_id, docs.text), hits)
