"""Small tables with everything that may go wrong in them."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Über " * 30_000 + "x" * 20_000

ROWS = [
    (1, "The same words in the same order here.", "en", "s", 1), (2, "The same  words in\tthe same order here.", "en", "s", 1), (2, "The same  words in\tthe same order here.", "en", "s", 1),
    (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \n ", None, "s", 3), (6, LONG, "de", "s", len(LONG)), (None, "No id at all, but text.", "en", None, 1),
    (7, "😀 ﬁ <|endoftext|> 日本 \x00 é", "fr", "s", 9), (8, "one", "en", "s", 3), (9, "12 34 !!", "en", "s", 3),
]


def docs(spark, rows=ROWS, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that the operators use for their own columns
        from pyspark.sql import functions as F

        names = "row block blocks name left score predicted kept keep_id length start ids sequence_id offset component size unit bands media inline digest section language cosine accepted host own main".split()
        df = df.withColumns({n: F.lit("clash") for n in names})
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
