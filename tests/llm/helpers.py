"""Small tables with everything that can go wrong in them."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, prefix string, n long, fp string, _row double"


def documents(spark, rows):
    """A table like documents with extra columns whose names operators use inside. Rows: (doc_id, text[, lang[, source]])."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, *[None] * (4 - len(row)))
        full.append((doc_id, text, lang, source, None if text is None else len(text), "p", 7, "f", 1.5))
    return spark.createDataFrame(full, DOCUMENTS).repartition(3)


def words(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


AWKWARD = ["", None, " ", "\n\n", "a", "a b", "A  b\tc\x0b\x0c\rd", "x\x00y", "é ́ ﬁ \U0001f600", "nbsp here", "\x1cfs", "don't DON'T", "word " * 3000]
