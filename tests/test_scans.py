"""The term scanner and the markup scan, against plain patterns, and in the time that they take."""

import random
import re
import time

import pytest

from cairn.functions import html
from cairn.operators import postings


def plain(terms, text):
    out = []
    for i, (term, case) in enumerate(terms):
        out += [(i, m.start(), m.end()) for m in re.finditer(rf"\b{re.escape(term)}\b", text, 0 if case else re.I) if term]
    return sorted(out)


WORDS = ["owl", "OWL", "Owl", "knowledge graph", "graph", "C++", "c#", "a a", "aa", "ſet", "set", "İi", "i", "ı", "straße", "STRASSE", "ﬁ", "µ", "μ", "K", "k", "σς", "Σ", ".net", "x.y", "日本", "e-mail", ""]


@pytest.mark.parametrize("seed", range(30))
def test_matches_equal_those_of_a_pattern_a_term(seed):
    chance = random.Random(seed)
    terms = [(w, chance.random() < 0.4) for w in chance.sample(WORDS, 14)]
    text = "".join(chance.choice([" ", "", "-", ". ", " "]) + chance.choice([str.upper, str.lower, str.title, str])(chance.choice(WORDS)) for _ in range(200))
    assert postings.TermScanner(terms).find(text) == plain(terms, text)


def test_terms_that_overlap_themselves():
    terms = [("a a", True), ("aa", False), ("a", False)]
    for text in ("a a a a", "aaaa aa", "a a a", "", "A a"):
        assert postings.TermScanner(terms).find(text) == plain(terms, text)
    assert postings.TermScanner([]).find("text") == [] and postings.TermScanner([("", True)]).find("text") == []


def test_many_terms_cost_little_more_than_few():
    chance = random.Random(1)
    word = lambda: "".join(chance.choice("abcdefghij") for _ in range(6))
    text = " ".join(word() for _ in range(60_000))
    took = {}
    for n in (10, 10_000):
        scanner = postings.TermScanner([(word(), False) for _ in range(n)])
        scanner.find(text[:1000])
        took[n] = min(_time(scanner.find, text) for _ in range(3))
    assert took[10_000] < 2.5 * took[10] + 0.05


def _time(function, *arguments):
    began = time.perf_counter()
    function(*arguments)
    return time.perf_counter() - began


@pytest.mark.parametrize("unit", ["<a ", "<a href='", '<a b="', "<!--", "<script>", "<style ", "</", "&", "&#", "<a <b ", "<p x='>' "])
def test_markup_takes_linear_time(unit):
    short, long = unit * 10_000, unit * 40_000
    html.fragment_text(short[:100])
    few, many = (min(_time(html.fragment_text, t) for _ in range(2)) for t in (short, long))
    assert many < 12 * few + 0.2


def test_markup_that_is_not_closed():
    assert html.fragment_text("a <b>c</b> <p class=\"x>y\">d<br>e <i f") == "a c d e"
    assert html.fragment_text("a <!-- b") == "a" and html.fragment_text("a < b &lt; c") == "a < b < c" and html.fragment_text("a <p title='b > c") == "a"
    assert html.fragment_text(None) is None and html.fragment_text("") == ""
