def documents(spark, rows):
    """(doc_id, text) rows as a documents table, with columns of clashing names."""
    rows = [(i, t, None if i is None else "en", "src0", None if t is None else len(t), 1, "x") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, node string")
