import pytest

#: A row of every awkward kind: nulls, empty and blank texts, repeats, and long ones.
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PLAIN = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen."
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, PLAIN),
    (4, PLAIN),
    (5, LONG),
    (6, "Été 中文 \U0001f600 <|endoftext|> \x00 \x1c end"),
    (None, "a text without an id"),
]


@pytest.fixture
def docs(spark):
    def make(rows, **extra):
        names = ", ".join(f"`{n}` string" for n in extra)
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        data = [(i, t, "en", "s", None if t is None else len(t), *extra.values()) for i, t in rows]
        return spark.createDataFrame(data, schema + (", " + names if names else ""))

    return make


@pytest.fixture
def awkward(docs):
    """The awkward rows, with columns named like those the operators make."""
    return docs(AWKWARD, score="mine", predicted="mine", kept="mine", spans="mine", ids="mine")
