from __future__ import annotations

import random

import pytest

from textloom.functions.lattice import Lattice
from textloom.functions.tokenize import dictionary_folder, tokenize
from textloom.models import LINDERA_MODELS_BY_LANGUAGE


def write(folder, words, matrix, unknown=()):
    folder.mkdir()
    (folder / "words.csv").write_text("".join(f"{s},{l},{r},{c},NOUN\n" for s, l, r, c in words), encoding="utf-8")
    size = len(matrix)
    (folder / "matrix.def").write_text(f"{size} {size}\n" + "".join(f"{i} {j} {matrix[i][j]}\n" for i in range(size) for j in range(size)))
    (folder / "char.def").write_text("DEFAULT 0 1 0\nHAN 0 0 1  # one by one\nLATIN 1 1 0\n0x4E00..0x9FFF HAN\n0x0041..0x007A LATIN\n", encoding="utf-8")
    (folder / "unk.def").write_text("".join(f"{s},{l},{r},{c},UNK\n" for s, l, r, c in unknown), encoding="utf-8")
    return folder


def cheapest(words, matrix, text):
    """The least cost of any way to write ``text`` as words."""
    best = None

    def walk(at, right, cost):
        nonlocal best
        if at == len(text):
            cost += matrix[right][0]
            best = cost if best is None else min(best, cost)
            return
        for s, l, r, c in words:
            if text.startswith(s, at):
                walk(at + len(s), r, cost + matrix[right][l] + c)

    walk(0, 0, 0)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_paths_are_cheapest(tmp_path, seed):
    rng = random.Random(seed)
    matrix = [[rng.randrange(20) for _ in range(3)] for _ in range(3)]
    words = [(c, rng.randrange(3), rng.randrange(3), rng.randrange(50)) for c in "天気良"] + [("".join(rng.choice("天気良") for _ in range(rng.randint(2, 4))), rng.randrange(3), rng.randrange(3), rng.randrange(50)) for _ in range(8)]
    text = "".join(rng.choice("天気良") for _ in range(9))
    spans = Lattice(write(tmp_path / "d", words, matrix))(text)
    assert "".join(s for s, _, _ in spans) == text and all(text[a:b] == s for s, a, b in spans)
    costs = {0: 0}
    for s, _, _ in spans:
        step: dict = {}
        for w, l, r, c in words:
            if w == s:
                for right, cost in costs.items():
                    step[r] = min(step.get(r, 1 << 30), cost + matrix[right][l] + c)
        costs = step
    assert min(c + matrix[r][0] for r, c in costs.items()) == cheapest(words, matrix, text)


def test_unknown_words_and_spaces(spark, tmp_path):
    folder = write(tmp_path / "d", [("今天", 0, 0, 10), ("天气", 0, 0, 10), ("好", 0, 0, 10)], [[0]], [("HAN", 0, 0, 100), ("LATIN", 0, 0, 50), ("DEFAULT", 0, 0, 200)])
    model = LINDERA_MODELS_BY_LANGUAGE["zh"] if isinstance(LINDERA_MODELS_BY_LANGUAGE["zh"], str) else LINDERA_MODELS_BY_LANGUAGE["zh"][0]
    dictionary_folder(model, str(folder))
    df = spark.createDataFrame([("今天天气很好 nice。",), (None,), ("",)], "t string")
    got = [[(x["token"], x["start"], x["end"]) for x in r["x"]] for r in df.select(tokenize("t", model=model).alias("x")).collect()]
    assert got == [[("今天", 0, 2), ("天气", 2, 4), ("很", 4, 5), ("好", 5, 6), ("nice", 7, 11)], [], []]
    assert Lattice(folder)("") == [] and Lattice(folder)("  ") == []
    with pytest.raises(FileNotFoundError, match="nothing is downloaded"):
        Lattice(tmp_path)
