import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark):
    """Writes rows (doc_id, text[, lang, source]) as a documents table with a clashing extra column; gives its folder."""
    import tempfile

    def make(rows):
        folder = tempfile.mkdtemp()
        full = [(i, t, *(rest + ["en", "a"][len(rest):]), len(t or "")) for i, t, *rest in rows]
        spark.createDataFrame(full, SCHEMA).selectExpr("*", "'x' AS id", "1 AS size", "'y' AS digest").repartition(3).write.parquet(f"{folder}/documents.parquet")
        return folder

    return make


ODD_TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a"), (5, "a"), (None, "lost id"), (7, "Ünï çødé 🙂 <|endoftext|>  end"), (8, "x" * 50_000), (9, "word " * 9_000), (None, None)]


def thue_morse(order: int) -> tuple[str, str]:
    """A word of 2^order letters and its complement: alike under every polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(order):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
