import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, term string, start long, w string"


def _nasty() -> list[tuple]:
    rnd = random.Random(7)
    vocab = ["the", "of", "Ünïcode", "x", "and", "é", "word,", "A-b", "zz9", "日本", "end."] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, other = say(70), say(90)
    texts = [
        None, "", " ", "\n\n", "one", "one two three", say(4), say(5), say(19), say(20), say(300), passage, passage, passage.upper(),
        say(30) + " " + passage + " " + say(30), say(3) + "\n" + passage + "\n" + say(11), passage + " " + passage, other + " " + passage,
        other, "x " * 400, "ab" * 600, "the the the the the the the the the the the the", "#$% " * 40, "A!! B!! " * 30,
        "\n".join(say(8) for _ in range(12)), "a\x00b c\x1cd e\x85f g\xa0h " + say(30), "\r\n".join(say(6) for _ in range(5)), say(3000),
        "é" * 250 + say(40), "é" * 250, "don't we'll  I'm 12345 \t tab " + say(12),
    ]
    lines = [say(6) for _ in range(30)]
    texts += ["\n".join(lines), "\n".join(lines[:12] + ["new line here"] + lines[12:]), "\n".join(lines[5:25]), "\n".join(lines)]
    base = say(400).split()
    for k in range(12):  # near copies
        copy = list(base)
        for _ in range(k * 3):
            copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(999)}"
        texts.append(" ".join(copy))
    texts += [say(n) for n in range(6, 40)] + [say(60)] * 5
    rows = [(i, t, "en", "s", len(t or ""), "c", 1, "t", 2, "w") for i, t in enumerate(texts)]
    rows.append((None, passage, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None))
    rows.append((12, passage, "en", "s", 1, "c", 1, "t", 2, "w"))  # a repeated row: id and text
    rows.append((10**15, say(25), "en", "s", 1, "c", 1, "t", 2, "w"))
    return rows


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and long texts, ties, repeated rows and column names that an operator might use itself."""
    return spark.createDataFrame(_nasty(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(nasty):
    return [(r.doc_id, r.text) for r in nasty.collect()]


@pytest.fixture(scope="session")
def table(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test tables here")
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


def same(df, want: dict, cols: list[str], key: str = "doc_id") -> None:
    """Every row of ``df`` equals want[(id, text)] or want[id]."""
    got = df.collect()
    assert len(got) == sum(len(v) if isinstance(v, list) else 1 for v in want.values())
    for r in got:
        w = want[r[key]]
        mine = tuple(r[c] for c in cols)
        assert mine in w if isinstance(w, list) else mine == w, (r[key], mine, w)


@pytest.fixture(scope="session")
def check():
    return same
