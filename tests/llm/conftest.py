import pytest

LONG = " ".join(f"w{i * 7919 % 3001} {'the' if i % 3 else 'of'}" for i in range(40000))
BASE = "Anblewh sttible athawh thonre was is anly hend and oftionnten enti a wherer anhe ntedin thhe the heon to of nd he reou athinti atsh inwhtion thoninti of and erst thentien anonly"

# (doc_id, text): nulls, empties, ties, repeats, near copies, odd characters, a very long text
ROWS = [
    (1, BASE),
    (2, BASE),
    (3, None),
    (4, ""),
    (5, "  \t\n "),
    (6, "one"),
    (7, "ONE"),
    (8, "naïve café — Ω ∑ 漢字 😀 é İ\n\nIT'S we'll x y <|endoftext|> <|startoftext|>z"),
    (9, BASE.replace("reou", "roue") + "\nsecond line\nsecond line"),
    (10, "a" * 500),
    (11, LONG),
    (12, BASE + "\n" + LONG[:5000]),
    (13, "zero\x00byte " * 20),
    (14, BASE.upper()),
    (15, "\n".join(f"line {i} of some text that stands here" for i in range(40))),
    (16, "\n".join(f"line {i} of some text that stands here" for i in reversed(range(40)))),
]
REPEATS = [(1, BASE), (None, BASE), (None, None), (2, "another text for id two"), (None, BASE)]


@pytest.fixture(scope="session")
def docs(spark):
    """With further columns whose names operators use inside."""
    extra = "raw string, rid long, fp long, block long, kept string, score double"
    rows = [(d, t, "en", f"src{d % 3}", len(t or ""), "x", 1, 2, 3, "y", 0.5) for d, t in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def repeated(spark):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in ROWS + REPEATS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture
def texts():
    return {d: t or "" for d, t in ROWS}
