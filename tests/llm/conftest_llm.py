"""Helpers of the tests here."""

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=False):
    """Documents from (doc_id, text, lang, source); extra adds columns whose names operators use inside."""
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SHAPE)
    if extra:
        for name in ("fp", "size", "kept", "label", "bucket", "sequence_id", "score", "_id", "taken"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
