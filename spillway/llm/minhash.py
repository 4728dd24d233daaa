"""Near-duplicate documents: MinHash by fast similarity sketching, banding, and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free, pick, without
from .similar import BLOCK_BYTES, BROADCAST_BYTES, PAIRS_PER_MEMBER, Bands, connect, near_links, set_digest, shingle_batches, sketched, split_words

#: A pair at the threshold shares a band with probability 1 - (1 - 0.75**4)**32, all but 5 in a million.
BANDS = Bands(32, 4)
SHINGLE, PERCENT = 5, 75


def class_sets(texts: DataFrame, wanted: DataFrame, n: int, few: bool, limit: int = BLOCK_BYTES) -> DataFrame:
    """key (the class) and shingles of wanted classes (class, digest, key of a document that holds the set). Other
    texts under that document's key have other digests and fall away."""
    rows = texts.join(F.broadcast(wanted) if few else wanted, "key").select(F.struct("class", "digest").alias("class"), "text")

    def run(batches):
        for ids, sets in shingle_batches(batches, n, split_words, limit):
            found = [(k["class"], s.view(np.int64)) for k, s in zip(ids, sets, strict=True) if len(s) and set_digest(s) == k["digest"]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], ["key", "shingles"])

    return rows.mapInArrow(run, "key bigint, shingles array<bigint>")


def grouped(spark: SparkSession, docs: DataFrame, bands: Bands, shingle: int, percent: int, id_col: str, text_col: str, crowd: int, by_id: bool) -> DataFrame:
    """key, tag (of the text), n_shingles and name (the least key of its component) of each row. ``by_id``: a key with
    several texts connects their components."""
    scratch = Scratch(spark, "near")
    texts = pick(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("key"), F.xxhash64("text").alias("tag"), "text")
    table = scratch.save(sketched(texts, bands, shingle), "sketches")
    # one class per distinct set, with a key of its own; its least doc_id names it. Keys are fixed by writing them
    named = table.where("digest is not null and key is not null").groupBy("digest").agg(F.min("key").alias("rep"))
    classes = scratch.save(named.select(F.monotonically_increasing_id().alias("class"), "digest", "rep"), "classes")
    owned = table.join(classes, "digest", "left")
    own = owned.where("key = rep").groupBy("class").agg(F.first(F.struct("n_shingles", "keys", "marks")).alias("s"))
    reps = scratch.save(own.select(F.col("class").alias("key"), "s.*"), "reps")

    def sets_for(needed: DataFrame) -> DataFrame:
        few = needed.count() * 48 <= BROADCAST_BYTES
        wanted = classes.join(F.broadcast(needed) if few else needed, F.col("class") == F.col("key"), "left_semi")
        return class_sets(texts, wanted.select("class", "digest", F.col("rep").alias("key")), shingle, few)

    links = near_links(scratch, reps, sets_for, bands, percent, crowd)
    if by_id:
        held = owned.where("class is not null and key is not null").select("key", "class")
        several = held.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("key", "a")
        links = links.unionByName(held.join(several, "key").where("class <> a").select("a", F.col("class").alias("b")).distinct())
    component = scratch.save(connect(scratch, links, "whole"), "components")
    placed = classes.join(component, F.col("class") == F.col("key"), "left").select("class", "rep", "component")
    least = placed.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    names = placed.join(least, "component", "left").select("class", F.coalesce("least", "rep").alias("name"))
    return owned.select("key", "tag", "n_shingles", "class").join(names, "class", "left").select("key", "tag", "n_shingles", F.coalesce("name", "key").alias("name"))


def near_duplicates(spark: SparkSession, docs: DataFrame, bands: Bands = BANDS, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", crowd: int = PAIRS_PER_MEMBER) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts link if 100 * intersection >= percent * union of their distinct shingles, confirmed on the full sets. A text of
    fewer words than a shingle is one shingle; null texts and texts without words have an empty set and link with
    nothing. Rows that repeat a doc_id link with each other, whatever their texts, and each set links for itself. A row
    with a null doc_id links nobody: it gets the component of its set where another row has that, else null, and is
    kept. doc_id must be integral.
    """
    out = grouped(spark, docs, bands, shingle, percent, id_col, text_col, crowd, True)
    out = out.select(F.col("key").alias("doc_id"), "n_shingles", F.col("name").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, bands: Bands = BANDS, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", crowd: int = PAIRS_PER_MEMBER) -> DataFrame:
    """docs without all but the least id of each group; other columns stay as they are, whatever their names.

    Rows that repeat a doc_id are judged by their own texts: one without near-duplicates stays, whatever else its id has.
    Rows with a null doc_id stay.
    """
    rows = grouped(spark, docs, bands, shingle, percent, id_col, text_col, crowd, False)
    key, tag = free(docs, "__gone", "__tag")
    gone = rows.where("key <> name").select(F.col("key").alias(key), F.col("tag").alias(tag)).distinct()
    return without(spark, docs, gone, lambda: (F.col(id_col).cast("bigint") == F.col(key)) & (F.xxhash64(F.col(text_col)) == F.col(tag)))
