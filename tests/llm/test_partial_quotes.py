"""Quotes of parts of a message."""

from __future__ import annotations

from tests.llm.test_quotes import answer, rows
from tripstrata.llm.quote_links import link


def test_partial_quotes_are_linked(spark):
    messages = [
        (1, 0, "user", "First line\nsecond line\n\nA paragraph. It has two sentences.\n\nThird part"),
        (1, 1, "bot", "> second line\none line of a paragraph"),
        (1, 2, "user", "> one line of a paragraph\n\n> First line\n> second line\n>\n> Third part\ntwo of three paragraphs"),
        (1, 3, "bot", "> A paragraph.\nless its last sentence"),
        (1, 4, "user", "> It has two sentences. A paragraph.\nthe wrong order"),
        (1, 5, "bot", "> First line\n> [...]\n> third   PART\nwith an omission"),
        (1, 6, "user", "> the wrong order\n> second line\nof two messages"),
        (1, 7, "bot", "second line\nThird part"),
        (1, 8, "user", "> second line\n> Third part\nthe earliest that has both"),
        (1, 9, "user", "> said later\nno link"),
        (1, 10, "user", "x\nsaid later"),
        (2, 0, "user", "> Third part\nother conversation"),
    ]
    got = answer(link(rows(spark, messages)))
    assert [got[1, t]["parent_turn"] for t in range(11)] == [None, 0, 1, 0, None, 0, None, None, 7, None, None]
    assert (got[1, 2]["n_quotes"], got[1, 2]["n_linked"], got[1, 2]["depth"]) == (2, 2, 2)
    assert got[2, 0]["parent_turn"] is None
