from spillway.llm import language


def test_every_language_is_learned(spark):
    said = [(k, f"w{k % 70}a w{k % 70}b w{k % 70}c " * 40, f"l{k % 70}") for k in range(140)]
    docs = spark.createDataFrame(said, "doc_id bigint, text string, lang string")
    known = language.learn(docs, total=70 << 10)
    assert set(known) == {f"l{k}" for k in range(70)} and max(map(len, known.values())) <= 1 << 10
    assert len(language.learn(docs)) == 70
