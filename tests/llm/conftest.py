from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", ".", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> dict[int | None, str | None]:
    """By id: nulls, empty and short texts, other scripts, control strings, a long text, copies, near copies and repeats."""
    base, passage = prose(1, 120), prose(2, 70)
    near = base.split(" ")
    near[60] = "changed"
    given = {
        0: base,
        1: base,
        2: " ".join(near),
        3: prose(3, 40) + "\n" + passage + " " + prose(4, 30),
        4: prose(5, 55) + " " + passage,
        5: None,
        6: "",
        7: " \n\t ",
        8: "one",
        9: "One two",
        10: "日本語 のテキスト です。 ½ café é 𝔘 <|endoftext|> [INST] </s> \\0 \\",
        11: "x " * 3000,
        12: prose(6, 20_000),
        13: "a" * 40_000,
        14: "tab\tseparated  double   spaces \n trailing ",
        None: prose(7, 80),
    }
    given.update({100 + i: prose(100 + i, 20 + 7 * i) for i in range(25)})
    return given


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with the columns of documents and others whose names are ours."""
    rows = [(i, t, "en", "src0", len(t or ""), 1, "k", "s", "n", 2.0, [1]) for i, t in texts.items()]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, key int, node string, row string,"
        " part string, score double, hits array<int>"
    )
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
