import pytest

#: Rows that every operator must get through: nulls, empty and very long texts, repeats, odd characters.
ODD = [
    (1, None, "en", "src0"),
    (2, "", "en", "src0"),
    (3, "   \n\t ", None, None),
    (4, "word " * 60_000, "en", "src1"),
    (5, "x" * 200_000, None, "src1"),
    (6, "Same text, twice.", "en", "src0"),
    (6, "Same text, twice.", "en", "src0"),
    (7, "Same text, twice.", "de", "other"),
    (None, "No id here.", "de", None),
    (8, "é😀 漢字 \x00 ▁ mixed\r\nlines 4111 1111 1111 1111", "fr", "src0"),
]
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """With extra columns whose names the operators might use themselves."""
    docs = spark.createDataFrame(ODD, COLUMNS)
    return docs.selectExpr(
        "*", "cast(char_length(text) as bigint) n_chars", *[f"'mine {c}' `{c}`" for c in CLASHING], "1 `a.b``c`", "array(1) ids", "0 held_out"
    )


#: Names that operators use for columns of their own.
CLASHING = """
    fp _text key copy score bucket node row doc n h to k parts part steps rate total shuffle_key tid keys lead component
    component_id _bucket _parts _steps _copies _key _size _added added text_key base hits kind start end context value seed term df
    guest label toxic long rank draw least fingerprint
""".split()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
