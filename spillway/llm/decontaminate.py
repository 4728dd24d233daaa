"""Benchmark decontamination: find every benchmark word window in every document, then drop spans or documents.

Normalised benchmark windows form a broadcast hash table keyed by an anchor, one pair of neighbouring words of each
window. Each pair of neighbours in a document probes the table, and a hit is verified against all words of the window;
only verified hits are shuffled. A benchmark too large to be broadcast is joined by its anchors: pairs of neighbours are
shuffled without their texts, and texts meet their candidates once. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free, pick, without

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A benchmark whose windows take more bytes than this is joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 64 << 20


def words_of(text):
    """Words of a text after lower-casing A-Z; null and empty texts have none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS)
    return F.array_remove(parts, "")


def windows_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, win (words), and the anchor's offset and words of each distinct window.

    The anchor is the pair of neighbours with most letters, so that frequent short words seldom probe successfully;
    a window of one word has that word and an empty one.
    """
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    wins = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("win")).distinct()
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("win") - 2, F.lit(0))),
        lambda i: F.struct((F.length(F.get("win", i)) + F.coalesce(F.length(F.get("win", i + 1)), F.lit(0))).alias("n"), (-i).alias("at")),
    )
    at = -F.array_max(pairs)["at"]
    return wins.withColumn("at", at).select("item_id", "win", "at", F.get("win", F.col("at")).alias("a1"), F.coalesce(F.get("win", F.col("at") + 1), F.lit("")).alias("a2"))


def hits_of(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, digest, item_id, from, upto (word positions, upto exclusive): one row per occurrence of a window.

    One small row about the windows comes to the driver: their bytes decide on the broadcast, and the second scan, for
    windows of one word, runs only where there are any.
    """
    about = windows.agg(F.coalesce(F.sum(F.length(F.array_join("win", " ")) + 64), F.lit(0)).alias("n"), F.count(F.when(F.col("a2") == "", 1)).alias("singles")).first()
    fits = about["n"] <= BROADCAST_BYTES

    def probe(wins: DataFrame, second) -> DataFrame:
        if not fits:
            return probe_by_shuffle(docs, wins, second)
        table = F.broadcast(wins)
        # outer: else the optimiser adds a filter on the array's size, which splits every text once more
        spread = docs.select("doc_id", "digest", "w", F.posexplode_outer("w").alias("pos", "p1"))
        start, size = F.col("pos") - F.col("at"), F.size("win")
        same = (start >= 0) & (F.get("w", start) == F.get("win", F.lit(0))) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, size) == F.col("win"))
        return spread.withColumn("p2", second).join(table, (F.col("p1") == F.col("a1")) & (F.col("p2") == F.col("a2")) & same).select("doc_id", "digest", "item_id", start.alias("from"), (start + size).alias("upto"))

    hits = probe(windows.where("a2 <> ''"), F.coalesce(F.get("w", F.col("pos") + 1), F.lit("")))
    return hits.unionByName(probe(windows.where("a2 = ''"), F.lit(""))) if about["singles"] else hits


def probe_by_shuffle(docs: DataFrame, wins: DataFrame, second) -> DataFrame:
    """Hits of windows that aren't broadcast: anchors first, by words alone, then each text with all its candidates."""
    spread = docs.select("doc_id", "digest", "w", F.posexplode_outer("w").alias("pos", "p1")).select("doc_id", "digest", "pos", "p1", second.alias("p2"))
    met = spread.join(wins, (F.col("p1") == F.col("a1")) & (F.col("p2") == F.col("a2"))).select("doc_id", "digest", "item_id", "win", (F.col("pos") - F.col("at")).alias("from")).where(F.col("from") >= 0)
    # rows that repeat an id and its text have the same candidates
    found = met.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("item_id", "from", "win")).alias("met")).select(F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest"), "met")
    each = docs.join(found, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest")))
    true = F.filter("met", lambda c: F.slice("w", c["from"] + 1, F.size(c["win"])) == c["win"])
    hit = each.select("doc_id", "digest", F.explode(true).alias("c"))
    return hit.select("doc_id", "digest", F.col("c.item_id").alias("item_id"), F.col("c.from").alias("from"), (F.col("c.from") + F.size("c.win")).alias("upto"))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, text_digest.

    Null and empty texts have no words and are never contaminated. Items without words never hit. Rows that repeat a
    doc_id with its text share their hits and each get a row; the same doc_id with another text is judged apart. A null
    doc_id is a value like any other. An empty benchmark hits nothing; an empty table gives an empty result.
    """
    keyed = pick(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("w"))
    hits = hits_of(keyed, windows_of(benchmark, window=window))
    # words covered by the union of a document's intervals: each adds what lies beyond all that started before it
    before = F.coalesce(F.max("upto").over(Window.partitionBy("doc_id", "digest").orderBy("from", "upto").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.groupBy("doc_id", "digest", "from", "upto").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    added = F.greatest(F.col("upto") - F.greatest("from", before), F.lit(0))
    found = spans.withColumn("added", added).groupBy("doc_id", "digest").agg(F.sum("added").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    counted = keyed.select("doc_id", "digest", F.size("w").cast("long").alias("n_words"))
    f = found.select(F.col("doc_id").alias("f_id"), F.col("digest").alias("f_digest"), "n_hit", "item_ids")
    joined = counted.join(f, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        ids.alias("item_ids"),
        F.col("digest").alias("text_digest"),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or (mode "spans") with every hit word replaced by nothing in all documents.

    Columns of docs stay as they are, whatever their names; null texts stay null. In mode "spans" the words around a
    removed span keep their separators.
    """
    i, t = F.col(id_col), F.col(text_col)
    key, digest, spans = free(docs, "__id", "__digest", "__spans")
    if mode == "documents":
        judged = contamination(spark, docs, benchmark, window, id_col, text_col).where("contaminated")
        bad = judged.select(F.col("doc_id").alias(key), F.col("text_digest").alias(digest)).distinct()
        return without(spark, docs, bad, lambda: i.eqNullSafe(F.col(key)) & (F.xxhash64(t) == F.col(digest)))
    keyed = pick(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("w"))
    hits = hits_of(keyed, windows_of(benchmark, window=window))
    per_doc = hits.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("from", "upto")).alias(spans)).withColumnsRenamed({"doc_id": key, "digest": digest})
    with_spans = docs.join(per_doc, i.eqNullSafe(F.col(key)) & (F.xxhash64(t) == F.col(digest)), "left")
    pieces = F.regexp_extract_all(t, F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(0))
    clean = F.array_join(
        F.transform(pieces, lambda p, k: F.when(F.exists(spans, lambda s: (s["from"] <= k) & (k < s["upto"])), F.regexp_replace(p, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "")).otherwise(p)),
        "",
    )
    return with_spans.select(*[F.when(F.col(spans).isNull(), t).otherwise(clean).alias(text_col) if c == text_col else F.col(c) for c in docs.columns])
