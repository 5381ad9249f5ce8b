from __future__ import annotations

import pytest

from textloom.functions.concordance import _matches, compile_search


def found(pattern, text, case_sensitive=True):
    return [text[a:b] for a, b in _matches(compile_search(pattern, True, case_sensitive), text)]


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        # anchors by mode
        ("end$", "end\nend", ["end"]),
        ("(?m)end$", "end\nend", ["end", "end"]),
        ("(?m)^a", "a\na\r\na\ra", ["a", "a", "a"]),
        ("(?mR)a$", "a\r\na\ra\na", ["a", "a", "a", "a"]),
        ("(?mR)^$", "\r\n", ["", ""]),
        ("end$", "end\n", []),
        (r"\Aa|a\z", "aba\na", ["a", "a"]),
        ("a.b", "a\nb a\rb", ["a\rb"]),
        ("(?s)a.b", "a\nb", ["a\nb"]),
        ("(?R)a.b", "a\rb a-b", ["a-b"]),
        # classes and their operations
        ("[a-z&&[^b]]+", "abcab", ["a", "ca"]),
        ("[a-z--[aeiou]]+", "banana", ["b", "n", "n"]),
        ("[a-d~~c-f]+", "abcdef", ["ab", "ef"]),
        ("[[a-c][x-z]]+", "abcdxyz", ["abc", "xyz"]),
        ("[^[a-c]x]+", "abdxe", ["d", "e"]),
        (r"[\d--5]+", "4567", ["4", "67"]),
        ("[[:alpha:]_]+", "ab_1é", ["ab_"]),
        ("[[:^digit:]]+", "a1é", ["a", "é"]),
        ("[]a]+", "a]b", ["a]"]),
        ("[^]a]+", "a]b", ["b"]),
        ("[a-]+", "a-b", ["a-"]),
        ("[-a]+", "a-b", ["a-"]),
        (r"[\]\[\\^-]+", r"]\[^-x", [r"]\[^-"]),
        ("[a&&&&b]", "ab", []),
        (r"[\w&&\p{Greek}]+", "aβγ1", ["βγ"]),
        ("[&]+", "a&&b", ["&&"]),
        (r"\p{Lu}\P{Lu}+", "Aβc D", ["Aβc "]),
        (r"\pL+", "ab1", ["ab"]),
        (r"\p{^L}+", "ab1!", ["1!"]),
        (r"\p{Script=Han}+", "ab你好", ["你好"]),
        # escapes
        (r"\x{41}\x42\u0043\u{44}\U00000045", "ABCDE", ["ABCDE"]),
        (r"\t\n\-\#\%", "\t\n-#%", ["\t\n-#%"]),
        (r"\bthe\b", "the other the", ["the", "the"]),
        (r"\b{start}\w|\<x", "ab cd", ["a", "c"]),
        (r"\w\>", "ab cd", ["b", "d"]),
        # flags and groups
        ("a(?i)b|c", "aB C c", ["aB", "C", "c"]),
        ("(?i:a)b", "Ab AB", ["Ab"]),
        ("(?i)a(?-i)b", "Ab AB", ["Ab"]),
        ("(?U)a+", "aa", ["a", "a"]),
        ("(?U)a+?", "aa", ["aa"]),
        ("(?x) a b # comment\n c [ d e ]", "abcd abce", ["abcd", "abce"]),
        (r"(?x)a\ b", "a b", ["a b"]),
        ("(?P<n>a)(?<m>b)(?:c)", "abc", ["abc"]),
        ("(?-u:\\w)+", "aé", ["a"]),
        # repetitions
        ("a++", "aaab", ["aaa"]),
        ("(?:a+)+b", "aab", ["aab"]),
        ("a{2}", "aaaa", ["aa", "aa"]),
        ("a{1,2}?", "aa", ["a", "a"]),
        ("a{ 2 , }", "aaa", ["aaa"]),
        ("a**", "aa", ["aa"]),
        ("x|", "ax", ["", "x"]),
        ("()", "a", ["", ""]),
        ("}]", "}]", ["}]"]),
    ],
)
def test_matches(pattern, text, want):
    assert found(pattern, text) == want


def test_possessive_marks_are_repetitions():
    assert found("a++a", "aaa") == ["aaa"] and found("(?:a|ab)?+b", "ab") == ["ab"]


def test_ignored_case():
    assert found("straße|[à-ö]", "STRASSE É", False) == ["É"]
    assert found("[a-z&&[^B]]+", "abcB", False) == ["a", "c"]
    assert found("(?-i)a", "aA", False) == ["a"]


@pytest.mark.parametrize(
    "pattern",
    ["(", ")", "a)", "(?=x)", "(?!x)", "(?<=x)", "(?<!x)", r"(a)\1", "(?P=a)", "(?R)(", "(?>a)", "(?1)", "(?&n)", "(?(1)a|b)", r"\g<1>", r"\K", r"\G", r"\Z", r"\h", r"\R", r"\X", r"\0", r"\12", r"\e", "*a", "a|*", "(*)", "{2}", "a{", "a{,3}", "a{3,2}", "a{x}", "a{e<=1}", "[", "[a", "[]", "[b-a]", r"[\d-z]", r"[a-\d]", r"\x{110000}", r"\x{D800}", r"\xZZ", r"\p{Nope}", r"\p", "(?i", "(?q)", "(?ii)", "(?)", "(?-)", "(?P<1>a)", "(?P<n>a)(?P<n>b)", "(?|a|b)", "(?#c)", r"(?-u)\W", "(?-u)[^a]", r"(?-u)\pL", "\\"],
)
def test_refused(pattern):
    with pytest.raises(ValueError, match="Concordance failed"):
        compile_search(pattern, True, True)


def test_recursion_is_a_mode():
    """(?R) is the mode of line ends here, and no recursion."""
    assert found("(?R)a", "a") == ["a"]


def test_literals_are_literal():
    for text in (r"a.b", "[x]", r"\d", "(?i)", "$5 (x)", "a b", "é{2}"):
        assert [m for m in _matches(compile_search(text, False, True), f"- {text} -")] == [(2, 2 + len(text))]
