"""Small tables with the cases that every operator must bear."""

LONG = "the quick brown fox jumps over the lazy dog and runs away again " * 400

#: (doc_id, text, lang, source, n_chars, and two columns whose names clash with those that operators make)
DOCUMENTS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "b", 10, 1, "x"),
    (2, "alpha  beta\tgamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 10, 1, "x"),
    (3, None, None, None, None, None, None),
    (4, "", "en", "a", 0, 1, "x"),
    (5, " \n\t ", "en", "c", 4, 1, "x"),
    (6, "Alpha Beta", "en", "b", 10, 1, "x"),
    (7, LONG, "en", "b", len(LONG), 1, "x"),
    (7, LONG, "en", "b", len(LONG), 1, "x"),
    (8, LONG + "tail", "en", None, len(LONG), 1, "x"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "b", 10, 1, "x"),
    (None, None, "en", "b", 10, 1, "x"),
    (9, "naïve café — ünïcode ✓ 漢字   words here", "fr", "é", 10, 1, "x"),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, print string"


def table(spark, tmp_path, name, rows, schema):
    """rows as a table read from files, as queries read theirs."""
    path = str(tmp_path / f"{name}.parquet")
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def documents(spark, tmp_path, rows=None):
    return table(spark, tmp_path, "documents", DOCUMENTS if rows is None else rows, DOC_SCHEMA)


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=key)
