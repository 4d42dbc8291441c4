import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Texts that exercise edge cases: none, empty, white space, copies, other scripts, special strings, very long ones."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(("the", "ing", "er", "tion", "ou", "é", "ß", "Ω")) for _ in range(rng.randint(1, 4)))
    prose = [" ".join(word() for _ in range(rng.randint(1, 400))) for _ in range(60)]
    odd = [
        None, "", " ", "  \n\t ", "a", "A", "<|endoftext|>", "x <|startoftext|> y<|endoftext|>", "<s> </s> <unk> <0x41>", "日本語 テスト 한국어", "ΑΣ ΣΑΣ Straße İstanbul", "😀😀👍🏽 ́e",
        "it's we'll I'D", "12 345 6789", "a\x1cb\x85c　d e", "▁▁ a▁b", "\n\nx\n\n\ny  z ", "é é", "!!!???...----", "a" * 5000, "ab" * 3000, ("word " * 40_000).strip(), " ".join(map(str, range(30_000))),
    ]
    return prose + [prose[0], prose[0].upper(), prose[1] + " end"] + odd + ["same text"] * 40


@pytest.fixture(scope="session")
def docs(spark, texts):
    """One row a text, with further columns whose names clash with those of results."""
    rows = [(i, t, i % 3, f"kept{i}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept int, keep_id string, n_tokens double").repartition(5).cache()


@pytest.fixture(scope="session")
def repeated(spark):
    """Rows that repeat, and null ids."""
    rows = [(1, "some text"), (1, "some text"), (1, "SOME TEXT"), (None, "some text"), (None, None), (2, None), (2, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
