"""Awkward documents that every text operator has to stand."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for their own columns
    T.StructField("n_tokens", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("row", T.StringType()), T.StructField("component_id", T.StringType()),
])

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, "The quick brown fox jumps over the lazy dog."),
    (3, None), (4, ""), (5, " "), (6, "a"), (7, " leading, double  space and trailing "),
    (8, "tabs\tand\nnew lines\r\n\n end"), (9, "Ünïcödé ﬁ Å ẞ İ 中文字 かな 한국어 😀 "),
    (10, "special <|endoftext|> strings <s> </s> <|startoftext|>"), (11, "word " * 40_000), (12, "x" * 30_000),
    (13, "e.g. mail jane.doe@mail3.example.com or +1 (443) 555-5793, card 4363 3617 5661 9572, host 10.0.0.255."),
    (None, "no id"), (None, "no id"), (14, "\x00\x01 control ▁ under ▁ score"), (15, "   "), (16, "don't I'll we've it's"),
    (7, "the id 7 again"), (2, "The quick brown fox jumps over the lazy dog."),
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en", "src0", None if t is None else len(t), "a", "b", "c", "d", "e", "f") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
