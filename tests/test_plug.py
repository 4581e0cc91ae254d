"""The slots for a caller's tokenizer and embedder."""

from pyspark.sql import functions as F

from memspark.functions import plug


def test_slots(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "Deploy to Mars?")], "id int, content string")
    count = plug.token_counter(lambda: lambda ts: [len(t.split()) for t in ts])
    assert [r.n for r in df.select(count("content").alias("n")).collect()] == [3, 0, 3]
    embed = plug.embedder(lambda: lambda ts: [[float(len(t)), 1.0] for t in ts], batch=1)
    rows = {r.id: r for r in plug.encode(df, embed, importance=F.lit(0.5)).collect()}
    assert rows[1].embedding == [5.0, 1.0] and rows[2].embedding is None and rows[3].text_metadata.has_question and rows[3].importance == 0.5
