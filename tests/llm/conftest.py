import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # columns whose names the operators use themselves
        T.StructField("fp", T.StringType()),
        T.StructField("digest", T.IntegerType()),
        T.StructField("ids", T.StringType()),
        T.StructField("salt", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("n_tokens", T.StringType()),
        T.StructField("cell", T.StringType()),
        T.StructField("_cell", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)

LONG = "lorem ipsum dolor " * 30_000
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two"),
    (4, "one two"),
    (5, "one  two "),
    (6, "onetwo"),
    (None, "no id"),
    (None, "one two"),
    (7, LONG),
    (8, "<|endoftext|> and ▁ marks, é ü 中文 🙂 \x00 end"),
    (9, "token = abcdefgh12345678"),
    (-5, "négative  id"),
]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 9) for i, t in rows], DOC)


@pytest.fixture(scope="session")
def awkward(spark):
    return documents(spark, AWKWARD)


@pytest.fixture(scope="session")
def no_documents(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def sample(spark):
    """All documents of the smallest tables, read on the driver for brute force."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]
