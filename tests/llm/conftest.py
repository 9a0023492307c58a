import random

import pytest

WORDS = ["the", "a", "of", "stone", "river", "Über", "ñandú", "green", "walks", "slowly", "over", "under", "seven", "lamps", "été", "Kraft", "night", "and", "morning", "x1", "don't", "end."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, node double, text2 string, score string"


def prose(r: random.Random, n: int) -> str:
    return "".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.5) + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n)).strip()


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, periodic and long texts, nulls, empty texts, repeated rows, null ids."""
    r = random.Random(5)
    texts: list[str | None] = [prose(r, r.randrange(5, 200)) for _ in range(30)]
    passage = prose(r, 90)
    texts += [prose(r, 30) + "\n" + passage + " " + prose(r, r.randrange(0, 40)) for _ in range(12)]
    texts += [texts[3]] * 5 + [passage] * 2
    base = prose(r, 300).split(" ")
    for i in range(10):
        own = list(base)
        for _ in range(i % 4):
            own[r.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts += ["ha " * 400, "ha " * 150, "a" * 700, "ab" * 300, prose(r, 9000), None, "", "   \n", "one two", "ONE two", "é" * 150, "日本語テキスト " * 40, "x" * 5000]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), len(t) if t else None, f"k{i}", 0.5, "t", "s") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, rows[0], rows[0], (None, passage, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (7, "another text with the id of a row that is there", "en", "s1", 3, "k", 1.0, "t", "s")]


@pytest.fixture(scope="session")
def rows_of_corpus():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows_of_corpus):
    return spark.createDataFrame(rows_of_corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return lambda name: str(public_tokenizers.path(name))
