import numpy as np

from mailquarry.ml import models
from pyspark.sql import functions as F


def test_word_vectors_are_those_of_word_ngrams(spark):
    """One count of the terms serves every split; vectors are the ones of a pipeline fitted to each."""
    texts = ["Pay the bill now", "pay the bill, pay it now", "the bill is late", "Meeting at noon", "meeting the team at noon é ök", "x", "", "now pay now", "the team is late at noon"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").repartition(3).cache()
    splits = [F.col("id") < 6, F.col("id") % 2 == 0]
    words = models.RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False).transform(rows)
    made, stages = models.word_vectors(words.drop("text"), splits, max_df=0.6)
    size = made.first()["present"].size
    for inside, text in zip(splits, stages):
        model = models.word_ngrams("text", max_df=0.6).fit(rows.where(inside))
        then = {r["id"]: sorted(np.round(r["text_vector"].values, 9)) for r in model.transform(rows).collect()}
        now = {r["id"]: sorted(np.round(v[v != 0], 9)) for r in text.fit(made).transform(made).collect() if (v := r["text_vector"].values) is not None}
        assert now == then and size >= len(model.stages[3].vocabulary) > 3
