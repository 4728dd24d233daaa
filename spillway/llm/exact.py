"""Exact deduplication as a stateful stream: keyed state without expiry, checked byte for byte on hits.

Arriving rows are reduced to digest, identifier and locator. A streaming aggregation keeps one state row per digest in
a RocksDB store on the executors' disks, snapshotted to the shared checkpoint folder; it never expires. Rows of a hot
digest combine before the shuffle. Digests that were seen more than once are hits: they are broadcast while they are few,
so that only texts with a hit leave their task, and these are checked byte for byte by a grouping on (digest, text), which
combines before its shuffle; a collision of digests can't merge texts. A row without a hit is its own group and needs no
partner. Only DataFrame operations run on executors.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ANTI_BYTES, Scratch, free, pick, without

#: The store keeps state on the executors' disks; all stores of an executor share this much memory.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # else each of many small stores reserves megabytes of disk for its logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # else an executor keeps the stores of all its partitions open, with their native memory, into the steps that follow
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
ARRIVALS = "digest binary, doc_id bigint, locator string"
#: Memory of a hit's state row in a broadcast: digest, id, locator and the table's own share.
HIT_BYTES = 320


def sha256(text: Column) -> Column:
    """32 bytes of the text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def arrivals(docs: DataFrame, digest=sha256, id_col: str = "doc_id", text_col: str = "text", locator: Column | None = None) -> DataFrame:
    """digest, doc_id, locator of each row, of a batch or a stream. The locator says where the content lies."""
    where = place_of(docs) if locator is None else locator
    return docs.select(digest(F.col(text_col)).alias("digest"), F.col(id_col).cast("bigint").alias("doc_id"), where.alias("locator"))


def place_of(docs: DataFrame) -> Column:
    """file#row of rows read from Parquet, else their file, empty where they come from none."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.input_file_name()
    return F.concat("_metadata.file_path", F.lit("#"), "_metadata.row_index")


def keyed_state(stream: DataFrame) -> DataFrame:
    """The state: per digest the largest doc_id that came so far, its locator and the number of rows."""
    last = F.max(F.struct("doc_id", "locator"))
    return stream.groupBy("digest").agg(last.alias("last"), F.count("*").alias("seen"))


def run_stream(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str) -> None:
    """Takes all that is there, and resumes from the checkpoint folder. A batch writes the state rows that it changed to
    a folder of its own, so that a repeated batch overwrites what it wrote before."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:

        def write(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

        query = keyed_state(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest(spark: SparkSession, target: str) -> DataFrame:
    """digest, last, seen: the newest state row of each digest."""
    rows = spark.read.schema("digest binary, last struct<doc_id:bigint, locator:string>, seen bigint, batch int").parquet(target)
    return rows.groupBy("digest").agg(F.max_by(F.struct("last", "seen"), "batch").alias("s")).select("digest", "s.*")


def exact_groups(spark: SparkSession, docs: DataFrame, digest=sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, locator (of the row that stays).

    Texts are equal when identical; null counts as empty. The largest doc_id of a group stays. Rows that repeat doc_id
    and text all count in group_size, and are all kept if theirs is the largest. A null doc_id comes before all others:
    such a row is kept only where its group has no other id, with keep_id null. ``digest`` may be any deterministic
    expression; texts that share one without being equal are told apart.
    """
    scratch = Scratch(spark, "exact")
    came = scratch.save(arrivals(docs, digest, id_col, text_col), "arrivals")
    run_stream(spark, spark.readStream.schema(ARRIVALS).parquet(scratch.path("arrivals")), scratch.path("state"), scratch.path("checkpoint"))
    state = scratch.save(latest(spark, scratch.path("state")), "latest") if not came.isEmpty() else came.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("last"), F.count("*").alias("seen"))

    rows = pick(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("digest", digest(F.col("text")))
    hits = state.where("seen > 1")
    if hits.count() * HIT_BYTES <= ANTI_BYTES:
        hits = F.broadcast(hits)
    full = keyed.join(hits.select("digest"), "digest", "left_semi").groupBy("digest", "text").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n"))
    checked = full.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    collided = scratch.save(checked.where("texts > 1").select("digest"), "collided")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256"), place_of(docs).alias("own"))
    # of hits the state names the row that stays
    shared = hits.select("digest", F.col("last.doc_id").alias("last_id"), F.col("last.locator").alias("last_at"), "seen")

    def settled(rows: DataFrame) -> DataFrame:
        said = [F.when(F.col("seen").isNull(), a).otherwise(F.col(b)).alias(c) for a, b, c in ((F.col("doc_id"), "last_id", "keep_id"), (F.col("own"), "last_at", "locator"), (F.lit(1), "seen", "group_size"))]
        return rows.join(shared, "digest", "left").select("digest", "doc_id", "text_sha256", *said)

    if collided.isEmpty():
        out = settled(named)
    else:
        rest = keyed.join(collided, "digest", "left_semi").join(full.withColumnsRenamed({"keep": "keep_id", "n": "group_size"}), ["digest", "text"])
        rest = rest.join(state.select("digest", F.col("last.locator").alias("locator")), "digest").withColumn("text_sha256", F.sha2("text", 256))
        out = settled(named.join(collided, "digest", "left_anti")).unionByName(rest.select("digest", "doc_id", "text_sha256", "keep_id", "locator", "group_size"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "locator")


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, that of the largest doc_id; of repeats of that id one, and any one where all are null."""
    key, digest = free(docs, "__id", "__sha")
    groups = exact_groups(spark, docs, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(key), F.unhex("text_sha256").alias(digest), "kept")
    groups = Scratch(spark, "exact-drop").save(groups, "groups")
    i, sha = F.col(id_col).cast("bigint"), sha256(F.col(text_col))
    same = lambda: i.eqNullSafe(F.col(key)) & (sha == F.col(digest))
    left = without(spark, docs, groups.where("not kept").select(key, digest).distinct(), same)
    # rows that repeat id and text: in a table with unique ids there are none, and texts aren't shuffled
    twice = groups.where("kept").groupBy(key, digest).agg(F.count("*").alias("n")).where("n > 1").select(key, digest)
    if twice.isEmpty():
        return left
    again = left.join(twice, same(), "left_semi")
    unique = again.groupBy(i.alias(key), sha.alias(digest)).agg(F.first(F.struct(*again.columns)).alias("__row")).select("__row.*")
    return left.join(twice, same(), "left_anti").unionByName(unique)
