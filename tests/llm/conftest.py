import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hits long, spans string, d long, t string, fp string, word string, score double, toxic int, label long"


def _texts():
    rng = random.Random(3)
    en = "the of and stone water garden light people winter morning reading window market letter yellow simple travel".split()
    fr = "le la les été maison jardin lumière après fenêtre marché lettre jaune simple voyage où très déjà".split()
    out = []
    for k in range(60):
        words = fr if k % 3 == 0 else en
        n = rng.choice([1, 2, 5, 60, 120, 300])
        out.append((" ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(n)), "fr" if k % 3 == 0 else "en"))
    return out


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang): ordinary texts, copies, shared passages, nulls, empty and very long texts, repeated rows."""
    made = [(k, t, lang) for k, (t, lang) in enumerate(_texts())]
    passage = " ".join(f"shared{k}" for k in range(40))
    made += [
        (100, None, "en"),
        (101, "", None),
        (102, " \n\t ", "en"),
        (103, "a", "en"),
        (104, "12 34 ### %%", "en"),
        (105, made[3][1], "fr"),
        (105, made[3][1], "fr"),
        (106, "start here now " + passage + " and the end of it", "en"),
        (107, "Other words first. " + passage, "en"),
        (108, "one two " * 4000, "en"),
        (109, " ".join(f"w{k % 977}" for k in range(20000)), "en"),
        (110, "naïve café — déjà <|endoftext|> vu  twice x\x0b\n\n", "fr"),
        (None, passage, "en"),
        (None, None, None),
        (111, "Ünïcode ẞ İ 漢字 🙂 é", "de"),
        (112, made[4][1] + " extra", "en"),
    ]
    return made


def frame(spark, rows):
    """A documents table with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 1, "x", 2, "y", "z", "w", 0.5, 1, 3) for i, t, lang in rows], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def benchmark_table(spark, rows):
    passage = " ".join(f"Shared{k}!" for k in range(5, 20))
    return spark.createDataFrame([(1, passage), (2, "water garden"), (3, None), (4, ""), (5, passage), (None, "light people")], "item_id long, text string")
