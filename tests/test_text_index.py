"""The trigram index: the rows of a full scan from fewer files."""

from __future__ import annotations

import random
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderscope.plans import explore
from orderscope.sources.text_index import FOLD_FROM, FOLD_TO, TextIndex, files_of, required_trigrams

RUN = uuid.uuid4().hex  # indexes of an earlier test run lie in the same shared folder
CASES = {
    "abc": [{"abc"}], "ABCd": [{"abc", "bcd"}], "ab": None, "": None, "abc|xy": None, "abc|xyz": [{"abc"}, {"xyz"}],
    "abcd?": [{"abc"}], "abc?": None, "abcx*def": [{"abc", "def"}], "abc+def": [{"abc", "def"}], "abc{0,2}defg": [{"def", "efg"}],
    "a.cdef": [{"cde", "def"}], "^abc$": [{"abc"}], r"ab\.cd": [{"ab.", "b.c", ".cd"}], r"abc\d+def": [{"abc", "def"}], r"\Qabc\E": None,
    "(abc|de)fgh": [{"fgh"}], "[a-z]xyz": [{"xyz"}], "(?i)abc": None, "(?:abc)def": [{"def"}], "a[)]bcd(x[|]y)efg": [{"bcd", "efg"}],
    "ação": None, "caça rara": [{"a r", " ra", "rar", "ara"}], "Kelvin": [{"kel", "elv", "lvi", "vin"}], "[]abc]def": None, "abc(def": None,
}


@pytest.mark.parametrize("pattern", CASES)
def test_required_sequences(pattern):
    assert required_trigrams(pattern) == CASES[pattern]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB.|*+?()[]^\\d1", max_size=12), st.lists(st.text(alphabet="abAB.|1d", max_size=8), max_size=12))
def test_a_match_has_the_sequences_of_a_branch(pattern, texts):
    try:
        compiled = re.compile(pattern, re.IGNORECASE)
    except (re.error, OverflowError):
        return
    branches = required_trigrams(pattern)
    if branches is None or "++" in pattern or "?+" in pattern or "*+" in pattern:
        return
    for text in texts:
        if compiled.search(text):
            folded = text.translate(str.maketrans(FOLD_FROM, FOLD_TO))
            assert any(all(g in folded for g in b) for b in branches)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("text") / "t")
    rng = random.Random(6)
    for part in range(8):
        word = lambda: "".join(rng.choice("aeiou") + rng.choice("bcdfg") for _ in range(4)) + f"p{part}q"  # noqa: B023, E731
        rows = [(i, rng.choice([word(), word().upper(), None]), "CAFÉ Kelvin ſtraße" if part == 3 else f"Street {i % 9}") for i in range(200)]
        spark.createDataFrame(rows, "id int, name string, place string").coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


PATTERNS = ["p3q", "P5Q$", "p1q|p6q", "kelvin", "STRASSE|stra", "caf.", "nan", "zzz", "street [0-3]", "p[27]q", "x", "^$", "p2q.*zzz"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_rows_from_fewer_files(table, pattern):
    index = TextIndex(table, f"{RUN}words")
    some, every = explore.indexed_search(index, pattern), explore.search(table, pattern)
    assert sorted(map(str, some.collect())) == sorted(map(str, every.collect()))
    if pattern in ("p3q", "P5Q$", "kelvin", "zzz"):
        assert len(files_of(index.candidates(pattern))) == (0 if pattern == "zzz" else 1) < len(files_of(table))
    if pattern in ("x", "^$", "p[27]q"):
        assert index.files(pattern) is None  # nothing to look up: all files


def test_bad_patterns_and_tables_without_text(spark, table, tmp_path):
    with pytest.raises(ValueError):
        explore.indexed_search(TextIndex(table, f"{RUN}words"), "(")
    spark.range(5).write.parquet(str(tmp_path / "n"))
    numbers = spark.read.parquet(str(tmp_path / "n"))
    assert explore.indexed_search(TextIndex(numbers, f"{RUN}numbers"), "abc").count() == 0
