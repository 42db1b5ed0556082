import pytest
from pyspark.sql import types as T

# Column names that operators use inside.
CLASHES = (
    "score kept row key words grams keys node hub bucket text_hash _text _words _id _y _kept_id "
    "component component_id host path rule verdict tokens anchor t c0 doc id w found".split()
)
PROSE = (
    "The old mill by the river was closed for years, and nobody in the town knew who had the key. "
    "When the rain came in the spring, water ran over the road and into the fields of the farm. "
    "A letter from the city said that the bridge would be built again, but it was not to be. "
).strip()


@pytest.fixture(scope="session")
def table(spark):
    """Documents with columns whose names clash with those used inside the operators."""

    def make(rows):
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
            + [T.StructField(c, T.StringType()) for c in ("lang", "source", *CLASHES)]
        )
        full = [(*r, *([None] * (4 - len(r)))) + ("x",) * len(CLASHES) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd(table):
    """Null and repeated ids, null, empty, blank, tied, repeated and very long texts."""
    long = " ".join(f"w{k % 977} {PROSE[k % 90 : k % 90 + 7]}" for k in range(12_000))
    rows = [
        (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, PROSE), (5, PROSE), (5, PROSE), (6, long),
        (7, "one"), (8, "ONE"), (9, "a b"), (None, PROSE), (None, None), (10, "日本語 é x \U0001f600"),
        (11, "#### $$$$ |||| <<>> %%%%"), (12, PROSE.upper()), (13, "\x00 \x1c  end"), (14, "1 2 3"),
    ]
    return table([(*r, "en", None) for r in rows]), rows


@pytest.fixture(scope="session")
def none(table):
    return table([])
