"""Small tables with every awkward case; brute-force forms live in the tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, row string, spans string"


def docs(spark, rows):
    """(doc_id, text) rows with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", "src0", None if t is None else len(t), 1, 0.5, "r", "s") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()),
                  key=lambda r: tuple((x is not None, x) for x in r))
