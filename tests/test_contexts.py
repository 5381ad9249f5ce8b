from __future__ import annotations

import pytest
import regex

from textloom.functions import concordance as c
from textloom.functions.dialect import translated


def test_only_the_pieces_of_contexts_are_looked_for(monkeypatch):
    """A hit in a long text asks for its neighbours, not for all pieces of the text."""
    asked = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def finditer(self, *place):
            for m in self.pattern.finditer(*place):
                asked.append(m)
                yield m

    for name in ("_py_piece", "_py_piece_back"):
        monkeypatch.setattr(c, name, Counted(getattr(c, name)))
    text = "a b. " * 10_000 + "one [CLS] two, needle! three mask four" + " c d." * 10_000
    found = c.hits(text, c.compile_search("eedl", False, False), 3, 4)
    assert [x[:3] + x[5:] for x in found] == [("two , n", "eedl", "e ! three four", "n", "e")]
    assert len(asked) < 20


@pytest.mark.parametrize("source", [r"[\p{L}--[t]]", r"[\pL&&[^t]]", r"[\p{Lu}--[k]]", r"[\P{L}--[1]]", "[\\p{Greek}--[ι]]"])
@pytest.mark.parametrize("fold", [False, True])
def test_properties_less_a_few_characters(source, fold):
    """One class, with the members of the expression by look-ahead."""
    made = translated(source, fold)
    prop, few = regex.fullmatch(r"\[(\\[pP](?:\w|\{\w+\}))(?:--\[|&&\[\^)(.)\]\]", source).groups()
    every = "".join(chr(k) for k in range(0x20000) if not 0xD800 <= k < 0xE000)
    flags = regex.IGNORECASE if fold else 0
    assert regex.findall(made, every, flags) == regex.findall(f"(?![{few}])[{prop}]", every, flags)
    assert source.find("Lu") > 0 or "(?!" not in made
