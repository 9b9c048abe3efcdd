import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _k1 long, lines string, n_words string, `digit` int"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and long texts, repeated rows and ids, copies and near copies, shared passages."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgáßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["2024", "a@b.org", "###", "É"]
    passage = prose(rng, 60, words)
    out = []
    for i in range(60):
        text = "\n".join(prose(rng, rng.randint(1, 60), words) for _ in range(rng.randint(1, 5)))
        if i % 4 == 0:
            text += "\nShared by many pages of 20%02d in this set\n" % i
        if i % 7 == 0:
            text += "\n" + passage
        out.append((i, text, ["en", "de", None][i % 3], f"s{i % 3}" if i % 5 else None, len(text)))
    base = out[5][1].split(" ")
    for k in range(6):
        near = list(base)
        near[(k * 7) % len(near)] = f"edit{k}"
        out.append((100 + k, " ".join(near) + " " + prose(rng, 80, words[:20]), "en", "s0", None))
    near = prose(rng, 150, words).split(" ")
    for k in range(8):
        copy = list(near)
        copy[10 + 11 * k] = f"changed{k}"
        out.append((200 + k, " ".join(copy), "de", "s1", 5))
    out += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, " \n\t\n ", "en", "s0", 5), (303, "one two", "de", "s2", 7), (304, "one two", "de", "s2", 7), (305, prose(rng, 30_000, words), "en", "s0", 9)]
    out += [(None, out[3][1], "en", "s1", 3), (None, None, None, None, None), (1, out[1][1], "en", "s0", 4), (1, out[1][1], "en", "s0", 4), (2, "other text of an id that is there twice", None, "s1", 1)]
    out += [(310, "x" * 199, "en", "s0", 199), (311, "ab" * 400, "en", "s0", 800), (312, "ab" * 150 + "!" + "ab" * 150, "en", "s0", 601)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", "clash", 7) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
