"""Morphemes by the cheapest path through a lattice of dictionary words, for dictionaries in MeCab's source format.

A folder has ``*.csv`` (surface, left id, right id, cost, ...), ``matrix.def`` (costs of a right id
followed by a left id), ``char.def`` (categories of characters) and ``unk.def`` (words of a
category that no entry covers). Text files are UTF-8; they may lie on any local path.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from pathlib import Path

import numpy as np

Span = tuple[str, int, int]
_FAR = 1 << 40
#: Characters of an unknown word at most.
_LONGEST = 24


class Lattice:
    """A dictionary, and ``__call__`` from a text to its (surface, start, end); white space is in no morpheme."""

    def __init__(self, folder: str | Path):
        root = Path(folder)
        lexica = sorted(root.glob("*.csv"))
        if not lexica:
            raise FileNotFoundError(f"no dictionary (*.csv) in {str(root)!r}; nothing is downloaded")
        #: entries by surface, and the lengths of surfaces by their first character
        self.words: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        lengths: dict[str, set[int]] = defaultdict(set)
        for path in lexica:
            for surface, entry in self._entries(path):
                self.words[surface].append(entry)
                lengths[surface[0]].add(len(surface))
        self.lengths = {c: sorted(x) for c, x in lengths.items()}
        self.cost = self._matrix(root / "matrix.def")
        self.category, self.ranges = self._characters(root / "char.def")
        self.unknown: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        if (root / "unk.def").is_file():
            for name, entry in self._entries(root / "unk.def"):
                self.unknown[name].append(entry)

    @staticmethod
    def _entries(path: Path) -> list[tuple[str, tuple[int, int, int]]]:
        with path.open(encoding="utf-8", newline="") as f:
            return [(row[0], (int(row[1]), int(row[2]), int(row[3]))) for row in csv.reader(f) if len(row) >= 4 and row[0]]

    @staticmethod
    def _matrix(path: Path) -> np.ndarray:
        if not path.is_file():
            return np.zeros((1, 1), np.int64)
        with path.open(encoding="utf-8") as f:
            out = np.zeros(tuple(map(int, f.readline().split()[:2])), np.int64)
            for line in f:
                if line.strip():
                    right, left, cost = map(int, line.split()[:3])
                    out[right, left] = cost
        return out

    @staticmethod
    def _characters(path: Path) -> tuple[dict[str, tuple[bool, bool, int]], list[tuple[int, int, str]]]:
        """Of each category whether unknown words are made beside known ones, by runs, and up to which length; and ranges of code points."""
        category, ranges = {"DEFAULT": (False, True, 0)}, []
        for line in path.read_text(encoding="utf-8").splitlines() if path.is_file() else ():
            parts = line.split("#")[0].split()
            if len(parts) >= 2 and parts[0].lower().startswith("0x"):
                low, _, high = parts[0].partition("..")
                ranges.append((int(low, 16), int(high or low, 16), parts[1]))
            elif len(parts) >= 4:
                category[parts[0]] = (parts[1] == "1", parts[2] == "1", int(parts[3]))
        return category, ranges

    def kind(self, c: str) -> str:
        point = ord(c)
        return next((name for low, high, name in reversed(self.ranges) if low <= point <= high and name in self.category), "DEFAULT")

    def _at(self, text: str, kinds: list[str], i: int) -> list[tuple[int, tuple[int, int, int]]]:
        """End and entry of each word that may begin at i."""
        out = [(i + n, e) for n in self.lengths.get(text[i], ()) for e in self.words.get(text[i : i + n], ()) if i + n <= len(text)]
        beside, runs, longest = self.category[kinds[i]]
        if not out or beside:
            end = i + 1
            while end < len(text) and end - i < _LONGEST and kinds[end] == kinds[i] and not text[end].isspace():
                end += 1
            ends = {*range(i + 1, min(end, i + longest) + 1), *([end] if runs else []), *([] if longest or runs else [i + 1])}
            entries = self.unknown.get(kinds[i]) or self.unknown.get("DEFAULT") or [(0, 0, 10_000)]
            out += [(end, e) for end in sorted(ends) for e in entries]
        return out

    def __call__(self, text: str) -> list[Span]:
        kinds = [self.kind(c) for c in text]
        #: at each place the ways that end there: right id to (cost, start, right id before)
        ways: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(len(text) + 1)]
        ways[0][0] = (0, -1, 0)
        for i, c in enumerate(text):
            if not ways[i]:
                continue
            if c.isspace():
                for right, (cost, _, _) in ways[i].items():
                    if cost < ways[i + 1].get(right, (_FAR, 0, 0))[0]:
                        ways[i + 1][right] = (cost, i, right)
                continue
            for end, (left, right, word) in self._at(text, kinds, i):
                cost, before = min((cost + int(self.cost[r, left]), r) for r, (cost, _, _) in ways[i].items())
                if cost + word < ways[end].get(right, (_FAR, 0, 0))[0]:
                    ways[end][right] = (cost + word, i, before)
        out: list[Span] = []
        at, right = len(text), min(ways[-1], key=lambda r: (ways[-1][r][0] + int(self.cost[r, 0]), r))
        while at > 0:
            _, start, before = ways[at][right]
            if not text[start].isspace():
                out.append((text[start:at], start, at))
            at, right = start, before
        return out[::-1]
