"""Quote levels, links and reply order."""

from __future__ import annotations

from tripstrata.llm.quote_links import as_mail, key_of, link, passages

SCHEMA = "conv_id long, turn long, role string, text string, depth long, body string, key string"


def rows(spark, messages):
    return spark.createDataFrame([(*m, 9, "x", "y") for m in messages], SCHEMA)


def answer(df):
    return {(r["conv_id"], r["turn"]): r for r in df.collect()}


def test_passages():
    assert passages("> a\n>> b\n> > c\n>c\n own\n\n> d") == [
        (1, "a"),
        (2, "b\nc"),
        (1, "c"),
        (0, " own\n"),
        (1, "d"),
    ]
    assert passages(None) == passages("") == [(0, "")]
    assert key_of(" A\n b ") == key_of("a b") and key_of(" \n") is None


def test_links(spark):
    messages = [
        (1, 0, "user", "Hello there\n\nsecond   paragraph"),
        (1, 1, "bot", "> second paragraph\nreply one"),
        (1, 2, "user", ">> SECOND paragraph\n> reply one\n\nreply two"),
        (1, 3, "bot", "> never said\n> by anyone\nlost"),
        (1, 4, "bot", "> reply two\n> \nfour\n> Hello there\n>\n> second paragraph"),
        (1, 5, "bot", "> five\nfive"),
        (2, 0, "user", "> second paragraph\nother conversation"),
        (None, 0, "user", "> Hello there\nx"),
        (3, None, "user", "y"),
        (4, 0, None, None),
        (4, 1, None, ""),
        (4, 2, None, "> \n>> "),
        (5, 0, "user", "w " * 50_000),
        (5, 1, "bot", "> " + "w " * 50_000 + "\nok"),
    ]
    got = answer(link(rows(spark, messages)))
    assert len(got) == len(messages)
    assert [got[1, t]["parent_turn"] for t in range(6)] == [None, 0, 1, None, 2, None]
    assert [got[1, t]["depth"] for t in range(6)] == [0, 1, 2, 0, 3, 0]
    assert [got[1, t]["root_turn"] for t in range(6)] == [0, 0, 0, 3, 0, 5]
    assert [got[1, t]["body"] for t in (0, 2, 4)] == ["Hello there\n\nsecond   paragraph", "reply two", "four"]
    assert (got[1, 2]["n_quotes"], got[1, 2]["n_linked"]) == (2, 2)
    assert got[2, 0]["parent_turn"] is None and got[None, 0]["parent_turn"] is None
    assert got[3, None]["body"] == "y" and got[4, 0]["body"] == "" and got[4, 2]["n_quotes"] == 0
    assert got[5, 1]["parent_turn"] == 0


def test_repeated_and_empty(spark):
    twice = [(1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 1, "bot", "> a b\nc"), (1, 1, "bot", "> a b\nc")]
    got = sorted((r["turn"], r["parent_turn"], r["depth"]) for r in link(rows(spark, twice)).collect() if r["turn"])
    assert got == [(1, 0, 1), (1, 0, 1)]
    assert link(rows(spark, [])).collect() == []


def test_long_chain_through_mail(spark):
    messages = [(7, t, "user", f"message number {t}") for t in range(150)]
    got = answer(link(as_mail(rows(spark, messages))))
    assert all(got[7, t]["depth"] == t and got[7, t]["root_turn"] == 0 for t in range(150))
    assert all(got[7, t]["body"] == f"message number {t}" for t in range(150))
