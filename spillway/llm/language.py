"""Language identification by compression: a text is encoded with one zstandard raw-content dictionary per language and
goes to the language whose encoding is smallest; where the margin is narrow, it is rejected.

Dictionaries come from a bounded sample of labelled rows: per language the documents with the least hashed ids, whole,
until the dictionary is full. Prediction is map-only and reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, give_back, pick

UNDECIDED = "und"
#: Bounds of the sample: documents of a language, bytes of a dictionary, and of all of them: more languages share those,
#: down to the least size of one.
DOCUMENTS, DICTIONARY_BYTES, TOTAL_BYTES, LEAST_BYTES = 400, 96 << 10, 6 << 20, 1 << 10
LEVEL = 6
#: Texts whose two best languages differ by less than this part are rejected by the query and the pipeline.
MARGIN = 0.001
#: Margins below this get a second look, with each of so many parts of the dictionaries.
NARROW, PARTS = 0.05, 8
#: Texts are encoded in windows of so many bytes, each against the dictionaries anew: a dictionary saves only so much, and
#: over a long text in one piece that would be a part near 0.
WINDOW_BYTES = 32 << 10
NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words of letters, one space between: marks, digits and case say nothing about a language."""
    return NO_LETTERS.sub(" ", text.lower()).strip()


def learn(labelled: DataFrame, documents: int = DOCUMENTS, size: int = DICTIONARY_BYTES, total: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Dictionary bytes per language from columns doc_id, text, lang; rows without text or lang teach nothing.

    Every language is learned. At most ``documents`` rows of each come to the driver, each cut to the size of a
    dictionary: ``size``, or an equal share of ``total``. They are chosen by rank within the rows whose hashed id is below
    a threshold that the counts give, so no group is sorted whole.
    """
    rows = labelled.where("lang is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return {}
    size = min(size, max(LEAST_BYTES, total // len(counts)))
    share = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * documents / r["n"] + 0.0)) for r in counts], "lang string, share double")
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(F.broadcast(share), "lang").where(spot < F.col("share")).where("text is not null").select("lang", "text", "doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))
    picked = few.withColumn("rank", rank).where(F.col("rank") <= documents).select("lang", "rank", F.substring("text", 1, size).alias("text"))
    texts: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for row in picked.orderBy("lang", "rank").toLocalIterator():
        if sizes.get(row["lang"], 0) < size:
            said = letters(row["text"])
            texts.setdefault(row["lang"], []).append(said)
            sizes[row["lang"]] = sizes.get(row["lang"], 0) + len(said.encode())
    return {lang: " ".join(said).encode()[:size] for lang, said in texts.items() if any(said)}


def encoder(data: bytes, level: int):
    import zstandard as z

    kept = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(level=level)
    return z.ZstdCompressor(level=level, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    """Sizes are whole bytes, so short texts often tie. Where the margin is narrow, the sizes of encodings with each part
    of a dictionary are added, which tells languages apart more finely; what is narrow then stays so."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.languages = sorted(dictionaries)
        self.encoders = [encoder(dictionaries[k], level) for k in self.languages]
        cut = lambda data: [data[len(data) * k // PARTS : len(data) * (k + 1) // PARTS] for k in range(PARTS)]
        self.parts = [[encoder(part, level) for part in cut(dictionaries[k]) if len(part) >= 8] for k in self.languages]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the part by which the next best encoding is longer, 0 to 1. Of equal ones the first
        language in order of names; with one language the score is 1."""
        said = letters(text) if text else ""
        if not said or not self.languages:
            return UNDECIDED, 0.0
        data = said.encode("utf-8", "replace")
        windows = [data[k : k + WINDOW_BYTES] for k in range(0, len(data), WINDOW_BYTES)]
        size = lambda e: sum(len(e.compress(w)) for w in windows)
        sizes = [size(e) for e in self.encoders]
        best, score = self.least(sizes)
        if score < NARROW:
            best, score = self.least([n + sum(map(size, parts)) for n, parts in zip(sizes, self.parts, strict=True)])
        return self.languages[best], score

    @staticmethod
    def least(sizes: list[int]) -> tuple[int, float]:
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((n for k, n in enumerate(sizes) if k != best), default=0)
        return best, (rest - sizes[best]) / rest if rest else 1.0


def identify(spark: SparkSession, docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.0, id_col: str = "doc_id", text_col: str = "text", limit: int = 4 << 20) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, rejected.

    lang_pred is ``und`` where the text is null, empty or has no letter, or nothing was learned. rejected: und, or the
    score is below ``margin``. The dictionaries' size is bounded by TOTAL_BYTES, or LEAST_BYTES a language if that is more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for ids, texts in blocks(batches, limit):
            said = [classifier.predict(t.decode("utf-8") if t else None) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array([s[0] == UNDECIDED or s[1] < margin for s in said], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    texts = pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return texts.mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def keep_identified(spark: SparkSession, docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.0, text_col: str = "text") -> DataFrame:
    """docs without the rejected rows, judged row by row in place: other columns stay, nothing is joined or shuffled."""
    names = list(docs.columns)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            said = [classifier.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([s[0] != UNDECIDED and s[1] >= margin for s in said], pa.bool_()))
        del classifier
        give_back()

    return docs.mapInArrow(run, docs.schema)
