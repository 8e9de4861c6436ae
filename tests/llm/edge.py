"""Small tables with nulls, blanks, long texts, repeats and clashing columns."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
ITEMS = T.StructType(
    [T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]
)

ENGLISH = (
    "the river runs past the old mill and the town keeps its market there on most days of the "
    "week while children walk along the bank with their dogs and talk about the weather"
)
GERMAN = (
    "der alte Müller geht jeden Morgen mit seinem Hund an den Fluss und kauft auf dem Markt das "
    "Brot für die ganze Familie weil es dort am besten schmeckt und nicht teuer ist"
)
LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(20_000))


def docs(spark, rows=None):
    if rows is None:
        rows = [
            (1, ENGLISH, "en", "a"),
            (2, GERMAN, "de", "a"),
            (3, ENGLISH, "en", "b"),
            (3, ENGLISH, "en", "b"),
            (4, None, "en", None),
            (5, "", None, "b"),
            (6, " \n\t ", "de", "b"),
            (7, LONG, None, "c"),
            (None, ENGLISH + " again", "en", "c"),
            (8, "12 34 !!", "en", "c"),
            (9, "Ünïcode\u0000 \U0001f600 naïve", "fr", "c"),
            (10, GERMAN.replace("Hund", "Kind"), "de", "a"),
        ]
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


def clash(frame, *names):
    """frame with extra columns that carry the names of results."""
    for name in names:
        frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


def key(row):
    """Sort key of a row whose fields may be null."""
    return tuple((v is not None, v) for v in row)
