import random

import corpus_pipeline
from spillway.llm import language, queries


def test_long_clean_texts_are_kept(spark, sf_dir):
    """Words of one language, dealt anew: some megabytes that hold no copies of themselves."""
    docs = queries.table(spark, sf_dir, "documents")
    said = language.Classifier(language.learn(queries.training_rows(docs)))
    rng = random.Random(4)
    for lang in said.languages:
        words = " ".join(r["text"] for r in docs.where(f"lang = '{lang}' and text is not null").collect()).split()
        long = " ".join(rng.choices(words, k=600_000))
        (guess, score), (near, less) = said.predict(long), said.predict(long[:30_000])
        assert guess == near == lang and score > 10 * corpus_pipeline.MARGIN, (lang, len(long), guess, score)
        assert score > less / 3  # the margin doesn't fall with length
