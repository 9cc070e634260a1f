"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}x{i}" for i in range(9000))
TEXTS = [None, "", " \n\t ", "one", "the cat sat on the mat today", LONG, LONG, "A B\x0bc\x1cd e f g", "中文 " * 40, "x" * 70_000, "same line of words here\n" * 30]


def documents(spark):
    rows = [(i if i != 3 else None, t, "en", "s", len(t) if t is not None else None, 1, "q", [1]) for i, t in enumerate(TEXTS)]
    rows.append(rows[4])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, s string, hits array<int>").withColumn("_row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("n_words", F.lit(0))


def empty(df):
    return df.where(F.lit(False))


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
