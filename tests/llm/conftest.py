"""Documents with the cases that break operators: nulls, blanks, repeats, ties, long texts, clashing column names."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, rep string, spans string, u int, component string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) + str(rng.randint(0, 60)) for _ in range(n))


def texts(seed=7):
    rng = random.Random(seed)
    passage, base = prose(rng, 70), prose(rng, 120)
    out = [None, "", "   ", "\n\t \n", "one", "two words", "!!! ???", prose(rng, 34), prose(rng, 35)]
    out += [prose(rng, rng.randint(40, 200)) for _ in range(30)]
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 30) for _ in range(6)]
    for k in range(8):  # near copies with a few changed words
        words = base.split()
        for _ in range(k // 2):
            words[rng.randrange(len(words))] = f"changed{rng.randint(0, 999)}"
        out.append(" ".join(words))
    copy = prose(rng, 80)
    out += [copy, copy, copy.upper(), copy + " ", copy.replace(" ", "\n")]
    out += ["la " * 300, "la la " * 40 + prose(rng, 50)]  # windows that overlap themselves
    out += ["é ü ñ 日本語 テキスト " * 12, "á ​ \x00 \x85 　 x" * 9, "▁▁ x ▁y", "<s> </s> <0x41> <|endoftext|>"]
    out.append(prose(rng, 30_000))
    return out


@pytest.fixture(scope="session")
def rows():
    found = [(i, t, "en", f"host{i % 3}" if i % 7 else None, len(t or ""), "x", "y", "z", i, None) for i, t in enumerate(texts())]
    return found + [found[-2], (None, "a text without an id " * 12, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
