import pytest

#: Texts that every operator must bear.
ODD = ["", " ", "\n\t ", "a", "Hello World", "hello  world\n\nhello world again and again", "ünïcödé ßtraße École 日本語 텍스트 🙂🙂 а́б", "<|endoftext|> x <|endoftext|><|endoftext|>", "x" * 5000, "word " * 3000, "▁a▁▁b ▁", "a\x00b\r\n", "1234 5678 +-*/", "ı İ Ǆ ﬁ", "the quick brown fox jumps over the lazy dog " * 40]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, repeated rows, and columns whose names clash with those that operators use."""
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}") for i, t in enumerate(ODD)] + [(100, None, "en", None), (None, "no id here at all", None, None), (4, ODD[4], "de", "s0"), (101, "hello world", "en", "s1")]
    clash = [(*r, 7, "k", True, 1.5, 2) for r in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, rank int, key string, kept boolean, score double, n_tokens int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")
