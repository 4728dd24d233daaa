
import corpus_pipeline
from spillway.llm import language, queries, sentencepiece

from . import helpers
from .test_exact_and_benchmark import contaminated


def test_run_is_that_of_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    judge = language.Classifier(language.learn(queries.training_rows(docs)))
    said = {k: judge.predict(t) for k, t in rows}
    rows = [(k, t) for k, t in rows if said[k][0] != "und" and said[k][1] >= corpus_pipeline.MARGIN]
    last = {t or "": max(k for k, u in rows if (u or "") == (t or "")) for _, t in rows}
    rows = [(k, t) for k, t in rows if last[t or ""] == k]
    near = helpers.near(rows)
    rows = [(k, t) for k, t in rows if near[k][2]]
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    bad = {r[0] for r in contaminated(rows, items) if r[5]}
    want = {k: t for k, t in rows if k not in bad}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    codec = sentencepiece.Codec(sentencepiece.read_model(queries.PIECES))
    assert {r["doc_id"] for r in out} == set(want) and len(out) == len(want)
    assert all(codec.decode(r["ids"]) == (want[r["doc_id"]] or "") and r["round_trip"] for r in out)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_queries_have_one_row_per_document(spark, sf_dir):
    ids = sorted(r[0] for r in queries.table(spark, sf_dir, "documents").select("doc_id").collect())
    for name, query in queries.queries().items():
        if name.split("_")[0] not in ("op2", "op6"):
            assert sorted(r["doc_id"] for r in query(spark, sf_dir).select("doc_id").collect()) == ids, name
