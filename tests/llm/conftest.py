"""Documents with every odd case, shared by the tests of this folder."""

import pytest

ODD = [
    (1, None), (2, ""), (3, "one two three"), (4, "one two three"), (5, "a\n\n  A longer line here \nb"), (6, "x\na LONGER line here\t\nB"), (None, "a longer line here\nno id"),
    (7, " ".join(f"w{i}" for i in range(60))), (8, "lead " + " ".join(f"w{i}" for i in range(5, 55)) + " tail"), (9, "rep " * 300), (10, "é 漢字 \U0001f600 ß " * 40), (11, "z" * 5000),
    (12, " ".join(f"v{i}" for i in range(4000))), (13, " ".join(f"v{i}" for i in range(4000)) + " more"), (13, "same id, another text of some length"), (14, "tie tie"), (14, "tie tie"), (None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long and repeated rows, and an extra column whose name clashes."""
    rows = [(d, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), i) for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
