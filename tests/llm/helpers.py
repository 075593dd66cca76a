"""Small frames that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Extra columns with names that operators use inside.
CLASHING = ["size", "bits", "label", "key", "range", "component_id", "copies", "n", "h", "shard", "score", "kept", "text_key", "at", "spans", "term", "part", "seq", "fate", "copies", "pos", "class", "length"]


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING})


def awkward(spark):
    long = "word ab12 " * 30000
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, long), (7, "Ünï cödé ☃ 漢字 text\nline two\nline two"), (None, "no id"), (8, "tie tie tie", None, None), (9, "tie tie tie", None, None)]
    return docs(spark, rows)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
