"""Documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import pytest

LONG = " ".join(f"word{i * 7919 % 1009}" for i in range(40_000))
TEXTS = [None, "", " ", "\n\n", "one", "Hello, wörld! 你好 🙂", "a b c d e f g h\na b c d e f g h\nsomething else entirely here today", LONG, LONG + " end", "\x00odd\x01 bytes\t\r\n", "<|endoftext|> and ▁ marks  twice ", "x" * 30_000]


@pytest.fixture(scope="session")
def odd_documents(spark):
    rows = [(i, t, "en", "s", len(t or ""), i % 3, "z") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, 0, "z"), (None, None, None, None, None, 0, "z"), rows[5], rows[5], (6, "another text of the same id", "en", "s", 27, 1, "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, h string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
