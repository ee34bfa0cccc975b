"""Small inputs with all that an operator must stand."""

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Columns that operators use as names of their own.
EXTRA = ["score", "shard", "ids", "position", "fp", "component_id", "size", "start", "taken", "digest", "told", "phase", "hash", "drops", "__id", "__hash", "__drops", "__doc", "__key", "__position", "__total", "__dropped", "__drop_id", "__drop_hash"]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), *[StructField(c, DoubleType()) for c in EXTRA]])

PROSE = "The night was long and the road was empty, so they walked on until the first houses came in sight."
LONG = " ".join(f"word{i % 97} item{i % 53}" for i in range(15_000))
ROWS = [
    (1, PROSE), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, PROSE), (6, PROSE), (7, PROSE + " Then they slept."), (8, "!!! ??? 123"),
    (9, "x" * 3000), (10, "Straße İstanbul ΣΑΣ é́ <|endoftext|> don't"), (None, "a row without a name"), (11, "one\ntwo lines of text here\none"), (12, "two lines of text here\nthree"), (-5, "Two Lines Of Text Here  \n"),
]


def documents(spark, rows=None):
    full = [(i, t, ["en", "fr", None][n % 3], ["a", None, "b"][n % 3], len(t or ""), *[0.5] * len(EXTRA)) for n, (i, t) in enumerate(ROWS if rows is None else rows)]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def stored(df, path, **tables):
    """A folder of tables with documents in it, as the queries read them."""
    df.write.parquet(f"{path}/documents.parquet")
    for name, t in tables.items():
        t.write.parquet(f"{path}/{name}.parquet")
    return str(path)
