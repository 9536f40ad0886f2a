"""Duplicate removal: files by hash, texts by SimHash in order, chunks by vector."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.fingerprint import hamming
from corpuslake.functions.strings import is_blank
from corpuslake.operators import vector
from corpuslake.operators.common import materialize, small, wide


def new_files(files: DataFrame, store: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of files whose key the store doesn't have."""
    return files.join(store.select(key).distinct(), key, "left_anti")


def keyed(fingerprints: DataFrame, threshold: int, blocks: int | None = None) -> DataFrame:
    """fingerprints exploded to (place, bits): the value of every choice of `blocks - threshold` blocks of bits.

    Fingerprints within the threshold differ in at most that many blocks, so they agree in one choice at least.
    More blocks mean more rows and longer keys, so fewer chance meetings.
    """
    n = blocks or threshold + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    choices = [sum(c) for c in itertools.combinations(masks, n - threshold)]
    signed = [m - 2**64 if m >= 2**63 else m for m in choices]
    parts = F.array(*(F.struct(F.lit(i).alias("place"), F.col("simhash").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))
    return fingerprints.select("*", F.explode(parts).alias("_k")).select("*", "_k.place", "_k.bits").drop("_k")


#: Fingerprints of one key that are compared with each other in one group.
PART = 2_048


def met(classes: DataFrame, name: str, other: str, threshold: int) -> DataFrame:
    """(simhash, name, other) for each two of classes (simhash, name), in both orders, that are within the threshold, once for each key they share.

    A key of very many fingerprints is parted, and each two parts meet in a group of their own, so that no task compares them all.
    """
    placed = materialize(keyed(classes, threshold), "keyed")
    many = placed.groupBy("place", "bits").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1")
    parted = placed.join(small(materialize(many, "many")), ["place", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own, every = F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = parted.select("place", "bits", "simhash", name, own.alias("mine"), every.alias("theirs"))
    two = parted.select("place", "bits", F.col("simhash").alias("other"), F.col(name).alias(other), own.alias("theirs"), every.alias("mine"))
    key, n = ["place", "bits", "mine", "theirs"], wide(classes.sparkSession)
    pairs = one.repartition(n, *key).join(two.repartition(n, *key), key)
    return pairs.filter((F.col("simhash") != F.col("other")) & (hamming(F.col("simhash"), F.col("other")) <= threshold)).select("simhash", name, other)


def near_links(fingerprints: DataFrame, threshold: int = 3, key: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(members, links): each row's class, and the links between classes within the threshold.

    A class is the rows of one fingerprint, named by its smallest key: members has key and class_id, links has a
    and b with a < b, both class names. Copies are never expanded into pairs.
    """
    classes = fingerprints.groupBy("simhash").agg(F.min(key).alias("class_id"))
    close = met(classes, "class_id", "b", threshold).filter(F.col("class_id") < F.col("b"))
    members = fingerprints.join(classes, "simhash").select(key, "class_id")
    return members, close.select(F.col("class_id").alias("a"), "b").distinct()


def link_counts(fingerprints: DataFrame, threshold: int = 3, key: str = "doc") -> DataFrame:
    """(key, class_id, n_links) of each row; n_links is how many other fingerprints are within the threshold."""
    members, links = near_links(fingerprints, threshold, key)
    ends = links.select(F.col("a").alias("class_id")).unionAll(links.select("b")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(ends, "class_id", "left").select(key, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def first_of_each(fingerprints: DataFrame, threshold: int = 3, key: str = "doc", history: DataFrame | None = None, most_rounds: int = 1_000) -> DataFrame:
    """The keys of fingerprints that a pass in key order keeps: those with no kept predecessor within the threshold.

    Only the first row of each fingerprint can be kept, so the pass runs over distinct fingerprints. Round by
    round, a fingerprint without undecided predecessors is kept, and what is near a kept one is dropped; each
    round is written, and the rounds end as the first undecided one is always decided. history (simhash) holds
    fingerprints kept before, which precede all.
    """
    firsts = fingerprints.groupBy("simhash").agg(F.min(key).alias("pos"))
    if history is not None:
        old = keyed(history.select("simhash").distinct(), threshold).select("place", "bits", F.col("simhash").alias("other"))
        near_old = keyed(firsts, threshold).join(old, ["place", "bits"]).filter(hamming(F.col("simhash"), F.col("other")) <= threshold)
        firsts = firsts.join(near_old.select("simhash").distinct(), "simhash", "left_anti")
    firsts = materialize(firsts, "firsts")
    near = met(firsts, "pos", "earlier", threshold).filter(F.col("earlier") < F.col("pos"))
    edges = materialize(near.select("pos", "earlier").distinct(), "edges")
    fresh = firsts.select("pos").join(edges.select("pos").distinct(), "pos", "left_anti")
    kept = fresh
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        dropped = edges.join(fresh.select(F.col("pos").alias("earlier")), "earlier", "left_semi").select("pos").distinct()
        undecided = edges.select("pos").distinct().join(dropped, "pos", "left_anti")
        open_edges = edges.join(dropped, "pos", "left_anti").join(dropped.select(F.col("pos").alias("earlier")), "earlier", "left_anti")
        edges = materialize(open_edges, "edges")
        fresh = materialize(undecided.join(edges.select("pos").distinct(), "pos", "left_anti"), "kept")
        kept = kept.unionAll(fresh)
    else:
        raise RuntimeError("the pass did not settle")
    return kept.select(F.col("pos").alias(key))


def filter_chunks(chunks: DataFrame, threshold: int = 3, key: str = "doc", text: str = "document", history: DataFrame | None = None) -> DataFrame:
    """chunks (with key, text and simhash) less blank texts and near repeats of kept predecessors."""
    filled = chunks.filter(~is_blank(F.col(text)))
    kept = first_of_each(filled.select(key, "simhash"), threshold, key, history)
    return filled.join(kept, key, "left_semi")


def dual_filter(chunks: DataFrame, store: DataFrame, threshold: int = 3, cosine: float = 0.98, key: str = "doc", text: str = "document") -> tuple[DataFrame, DataFrame]:
    """(kept chunks, counters): first by SimHash, then by vector against the store (doc, embedding)."""
    by_hash = materialize(filter_chunks(chunks, threshold, key, text), "by_hash")
    hits = vector.vector_duplicates(by_hash.select(F.col(key).alias("query_id"), F.col("embedding").alias("vector")), store, cosine)
    kept = by_hash.join(hits.select(F.col("query_id").alias(key)), key, "left_anti")
    counts = chunks.agg(F.count("*").alias("total")).crossJoin(by_hash.agg(F.count("*").alias("after_hash"))).crossJoin(hits.agg(F.count("*").alias("vector_duplicates")))
    return kept, counts.select("total", (F.col("total") - F.col("after_hash")).alias("simhash_duplicates"), "vector_duplicates")
