import pytest

from verdict.llm import common

CLASHING = ["id", "h", "key", "part", "row", "n", "v", "block", "component", "size", "bucket", "line", "s", "copies", "position"]


@pytest.fixture(scope="session", autouse=True)
def scratch(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
    yield
    common.clear_scratch(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest tonight"
    rows = [
        (1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose + " again", "en", "b"), (3, prose.upper(), "en", None),
        (4, None, "en", "a"), (5, "", None, "b"), (6, " \t\n", "en", None), (None, prose, "en", "a"), (None, None, None, None),
        (7, "x" * 150_000, "de", "c"), (8, "der die das und ist nicht ein eine " * 4_000, "de", "c"), (9, "12345 !!! 99", "fr", "b"),
        (10, "mail me.now@mail1.example.com or +1 (212) 555-7713 now, 10.0.0.1 4111 1111 1111 1111", "en", "b"),
        (11, "Some words here\nLicensed under the Apache License, Version 2.0.\n", "en", "a"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        df = df.selectExpr("*", f"cast(1 as int) as `{name}`")
    return df.repartition(3)
