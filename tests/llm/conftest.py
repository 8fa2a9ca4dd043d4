from __future__ import annotations

import re

import pytest

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, source) rows, with extra columns whose names clash with results."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 7, "x", 1, 2.0) for r in rows]
        schema = "doc_id long, text string, lang string, source string, id long, digest string, n_words int, score double"
        return spark.createDataFrame(full, schema)

    return build


def byte_words(text: str | None) -> list[bytes]:
    return [w for w in SPACE.split((text or "").encode()) if w]


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
