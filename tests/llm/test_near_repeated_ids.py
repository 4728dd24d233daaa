import random

from spillway.llm import minhash

from . import helpers


def test_each_text_of_a_repeated_id_links(spark):
    rng = random.Random(2)
    for seed in range(2):  # whichever of A and B has the lesser digest
        a, b = helpers.prose(rng, 80), helpers.prose(rng, 80)
        docs = [(7, a), (7, b), (9, b), (10, helpers.edited(rng, b, 1)), (11, helpers.edited(rng, a, 1)), (12, helpers.prose(rng, 80))]
        out = minhash.near_duplicates(spark, spark.createDataFrame(docs, helpers.SCHEMA)).collect()
        assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in out} == {k: (7, k == 7) for k in (7, 9, 10, 11)} | {12: (12, True)}
