import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark, tmp_path):
    """Writes rows as a documents table (and others by name) and returns its folder."""

    def write(rows, schema=SCHEMA, name="documents", files=3):
        folder = tmp_path / "sf"
        spark.createDataFrame(rows, schema).repartition(files).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write


def rows_of(texts):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


#: Nulls, empty and blank texts, one word, ties and repeats, marks, other scripts, a very long text.
AWKWARD = [
    None, "", " ", "\n\n", "word", "Word", "word", "a b c d", "The same five words here\nThe same five words here", "The same five words there",
    "All Rights Reserved. cc by cc by", "日本語 テキスト İıſK Σς", "x\x00y ﻿​ é", "<|endoftext|>", "lorem ipsum dolor sit amet " * 4000, "The same five words here\nand others too in this line", None, "",
]
