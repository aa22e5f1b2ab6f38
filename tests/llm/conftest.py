from __future__ import annotations

import pytest

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "one", "en"),
    (6, "  \t\n \v\f\r ", "de"),
    (7, "Écrire à jean.dupont+x@mail.example.com ou +1 (171) 555-2028, carte 4539 1488 0343 6467 ip 10.0.0.255.1.2.3.4", "fr"),
    (8, "word " * 3000, "en"),
    (9, "A\nB\nA\nA\n\nB # * $ % & | < >", "en"),
    (10, "é́ ½ ² 中文 \U0001f600 <|endoftext|> it's we'LL x" + "y" * 300, "fr"),
    (10, "a second row with the same id", "en"),
    (None, "a row without an id", "en"),
    (11, "Released under the MIT License.\nand more text here", "en"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(i, t, lang, f"s{n}", len(t or ""), n, "x", 0.5) for n, (i, t, lang) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, spans string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
