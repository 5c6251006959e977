from __future__ import annotations

import random

import pytest

from docflow.llm import truncation as X

BODY = "Korpralen gick till Kvarnby. Han kom åter på söndagen."


@pytest.mark.parametrize(
    ("tail", "state"),
    [
        ("", "whole"), (" Slut (sic).", "whole"), ("\nMatts Silverberg", "whole"), ("\nMatts Silverberg, tullnären", "whole"), ("\nKorså den 20 Julii 1745", "whole"),
        ("\nSom intygas\nOlof Larsson", "whole"), ("\r\nAmen", "whole"), ("\n(L. S.)", "whole"), ("\nSumma 318 mark", "unit"), ("\nArbetat efter", "formula"),
        (" Men när borgaren", "open"), (" Men när borg", "open"), (" Men när…", "broken"), (" Men när...", "broken"), (" fr�", "broken"), (r" f\u00e", "broken"),
        (" Men n&au", "broken"), (" Men <br", "broken"), (" Men [UN", "broken"), (" Men kvarn-", "broken"), ("\nMen när borgaren gick till kvarnen", "open"), (" Se (nedan.", "broken"),
        ("\n12 gamla båtar, 3 riksdaler", "unit"), (" Han gav 5 öre", "open"), (" Se [not 3. Han kom", "open"), (" Han <b>gick", "open"), (" Han „gick", "open"), (' Han <b class="gick', "broken"), ("\n12 båtar <s>, 3 mark", "unit"), (" Han „gick.", "whole"), (" sm%C3%", "broken"), (" smÃ", "broken"),
    ],
)
def test_endings(tail: str, state: str) -> None:
    assert X.ending(BODY + tail)[0] == state


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ("„Kom hit.", ['"']), ("”Kom hit.", ['"']), ('"Kom hit nu och vänta.', ["'"]), ("Se (nedan. Han gick bort.", ["("]), ("Se [not 3. Han kom.", ["["]), ("<p>Han gick. Och kom.", ["<p"]), ("Han gick <b>bort.", ["<b"]),
        ("„Kom hit“, sade han. ”Nej”, sade hon. “Jo.”", []), ("»Kom», sade han. «Nej», «jo».", []), ("(a [b) c", []), ("a) b) c", []), ("<p>En<br>rad <lb/> till</p>", []), ("<p>En <i>rad</p>", []), ("3 < 5 och 7 > 5", []),
        ("<p class='x", ["<"]), ("Han sade: „kom (nu", ['"', "("]), ("(" * 50_000 + ")" * 49_999, ["("]), ("", []), ('<a href="(">länk</a>', []),
    ],
)
def test_automaton(text: str, left: list[str]) -> None:
    assert [s for s, _ in X.open_signs(text)] == left


def test_automaton_against_rewriting() -> None:
    """Brackets alone: what is left after innermost pairs are removed again and again, where nothing crosses."""
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices("()a", k=rng.randint(0, 30)))
        plain, before = text.replace("a", ""), None
        while plain != before:
            before, plain = plain, plain.replace("()", "")
        assert len(X.open_signs(text)) == plain.count("(")


def test_signs_left_open_count_by_the_habit_of_the_source(spark) -> None:
    """Ten texts close their quotes and one doesn't; another source never closes them."""
    closed, opened = f"{BODY} Han sade: „Kom hit nu.“", f"{BODY} Han sade: „Kom hit nu."
    texts = [(closed, "a")] * 30 + [(opened, "a")] + [(opened, "b")] * 12 + [(closed, "b")] * 3
    assert [r[0] for r in X.truncated(rows(spark, texts)).collect()] == [30]
    assert {r["source"]: r["n_unclosed"] for r in X.rates(rows(spark, texts)).collect()} == {"a": 1, "b": 12}


def test_signs_that_nobody_closes_are_no_cut(spark) -> None:
    """A start sign that the corpus never closes, beside brackets that it does."""
    texts = [(f"{BODY} Slut (sic).", "a")] * 200 + [(f"{BODY} Slut <s>. Han kom.", "a")] * 5 + [(f"{BODY} Se (nedan. Han kom.", "a"), (f"{BODY} Slut <s>. Han kom.", "b"), (f"{BODY} Se (nedan. Han kom.", "b")]
    assert sorted(r[0] for r in X.truncated(rows(spark, texts)).collect()) == [205, 207]


def test_blank() -> None:
    assert [X.ending(t)[0] for t in (None, "", " \r\n\t")] == ["blank"] * 3


def rows(spark, texts: list, source="a"):
    return spark.createDataFrame([(k, t, s, t) for k, (t, s) in enumerate((t if isinstance(t, tuple) else (t, source)) for t in texts)], "doc_id long, text string, source string, state string")


def test_documents(spark) -> None:
    texts = [BODY] * 6 + [BODY + " Men n", None, "", " ", "﻿\n", BODY + "\nSumma 3 mark", BODY + "\nSumma 4 mark", BODY + "\nSumma 5 mark", BODY + "\nSumma 5 ma", (BODY + " Och", None), (BODY, None), "x " * 200_000 + "slut.", "x " * 200_000]
    found = sorted(r[0] for r in X.truncated(rows(spark, texts)).collect())
    assert found == [6, 14, 15, 18]
    assert X.truncated(rows(spark, texts).where("false")).count() == 0
    rates = {r["source"]: (r["n_documents"], r["n_truncated"]) for r in X.rates(rows(spark, texts)).collect()}
    assert rates == {"a": (13, 3), None: (2, 1)}


def test_a_source_without_terminators(spark) -> None:
    texts = ["utan punkt alls"] * 5 + ["utan punkt al�"]
    assert [r[0] for r in X.truncated(rows(spark, texts)).collect()] == [5]


def test_sources_of_mostly_cut_texts_and_small_ones(spark) -> None:
    texts = [(BODY, "a")] * 20 + [(BODY, "cut")] * 2 + [(BODY + " Men när borgaren", "cut")] * 10 + [("Korpralen gick till", "one"), (BODY + " Och", "two"), ("utan punkt", "two")]
    assert sorted(r[0] for r in X.truncated(rows(spark, texts)).collect()) == list(range(22, 35))
