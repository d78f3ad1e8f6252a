"""The automaton against one regular expression for each pattern."""

import random
import re

import pytest

from strandline.functions import matching as M
from strandline.functions import vocabulary as V
from strandline.operators import retrieval


def by_regex(text, pattern):
    """None without a match, else whether one of them is not negated."""
    found = [not M.negated(M.TOKEN.findall(text[: m.start()])) for m in re.finditer(pattern, text)]
    return any(found) if found else None


def test_matcher_against_regular_expressions():
    patterns = [p for *_, p in retrieval.PATTERNS]
    matcher = M.matcher(tuple(patterns), tuple(V.CALM))
    literals = [w for p in patterns for side in (M.expand(p)[0], M.expand(p)[2]) for w in side]
    fill = ["no", "not", "only", "without", "does not", "nor", "x", "near", ".", ",", "-", "_", "2", "é", "don't", "\n", "  ", "absence of", "resistance", "support", "around"]
    rng = random.Random(1)
    for _ in range(2500):
        text = "".join(rng.choice(literals if rng.random() < 0.4 else fill) + rng.choice([" ", " ", "  ", "", "\n", ", ", "_"]) for _ in range(rng.randint(0, 14))).lower()
        got, phrases = matcher.find(text)
        expected = {k: by_regex(text, p) for k, p in enumerate(patterns)}
        assert got == {k: v for k, v in expected.items() if v is not None}, text
        assert phrases == {c for c in V.CALM if c in text}


@pytest.mark.parametrize(("pattern", "expected"), [(r"\bhovers?\b", (["hovers", "hover"], None, [])), (r"\ba[bc]d(?:e|f)?\b", (["abde", "abdf", "abd", "acde", "acdf", "acd"], None, [])), (r"\bup\b.{0,9}\b(?:to|by)\b", (["up"], 9, ["to", "by"])), (r"\bmoves\s+to\b", (["moves to"], None, []))])
def test_expand(pattern, expected):
    assert M.expand(pattern) == expected


@pytest.mark.parametrize("pattern", [r"a.*b", r"\ba.{0,4}b.{0,4}c\b", r"(a|b)"])
def test_expand_refuses_other_patterns(pattern):
    with pytest.raises(ValueError):
        M.expand(pattern)


def test_retrieval_of_empty_and_null_captions(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "A peak.\nAnd not only noise.")], "id long, caption string")
    got = {r["id"]: r for r in retrieval.rank(retrieval.retrieve(rows)).collect()}
    assert got[1]["tags"] in (None, []) and got[2]["tags"] == [] and got[2]["ranked"][0] == "add_flat"
    assert got[3]["tags"] == ["noise", "peak"] and {"add_peak", "add_noise"} <= set(got[3]["candidates"])
    assert retrieval.retrieve(rows.limit(0)).count() == 0
