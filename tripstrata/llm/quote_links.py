"""Chat formatting by quotation linking.

A message's lines are read with their quote level (leading ``>`` marks). A run of lines of one level is
a passage; passages are normalised and hashed, and joined to the first message of the conversation that
says them unquoted. A passage that nobody says as a whole is joined by its lines and sentences to the
first message that has all of them in order. The replies so found put the messages in order, and the quotes are left out.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.llm.tables import Batches, Scratch, in_arrow

_MARKS = re.compile(r"((?:[ \t]?>)+)[ \t]?")
_BLANK_LINES = re.compile(r"\n[ \t]*\n")
_PIECE_ENDS = re.compile(r"\n|(?<=[.!?])\s+|(?<=[。！？])")

PARSED = (
    "conv_id long, turn long, role string, body string, keys array<string>, "
    "pieces array<string>, quotes array<struct<level:int,key:string,pieces:array<string>>>"
)


def passages(text: str | None) -> list[tuple[int, str]]:
    """Runs of lines of one quote level, 0 for the message's own words."""
    lines = []
    for line in (text or "").split("\n"):
        marks = _MARKS.match(line)
        lines.append((marks[1].count(">"), line[marks.end() :]) if marks else (0, line))
    return [(level, "\n".join(line for _, line in run)) for level, run in groupby(lines, key=lambda pair: pair[0])]


def key_of(passage: str) -> str | None:
    """The hash of a passage without regard to case and white space; None if nothing is left."""
    normal = " ".join(passage.lower().split())
    return hashlib.md5(normal.encode()).hexdigest() if normal else None


def pieces_of(passage: str) -> list[str]:
    """The hashes of a passage's lines, cut at ends of sentences; such without letters or digits, as marks
    of omission are, do not count."""
    return [key_of(piece) for piece in _PIECE_ENDS.split(passage) if any(map(str.isalnum, piece))]


def parsed(messages: DataFrame) -> DataFrame:
    """Each message's own words, the keys by which others may quote it (the whole and its paragraphs), its
    pieces, and the keys and pieces of what it quotes."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            bodies, keys, pieces, quotes = [], [], [], []
            for text in batch.column("text").to_pylist():
                parts = passages(text)
                body = "\n".join(part for level, part in parts if level == 0).strip("\n")
                own = {key_of(part) for part in [body, *_BLANK_LINES.split(body)]}
                bodies.append(body)
                keys.append(sorted(own - {None}))
                pieces.append(pieces_of(body))
                quoted = [(level, part) for level, part in parts if level]
                quotes.append(
                    [{"level": n, "key": key, "pieces": pieces_of(part)} for n, part in quoted if (key := key_of(part))]
                )
            fields = [("level", pa.int32()), ("key", pa.string()), ("pieces", pa.list_(pa.string()))]
            quote = pa.list_(pa.struct(fields))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("conv_id", "turn", "role")),
                    pa.array(bodies, pa.string()),
                    pa.array(keys, pa.list_(pa.string())),
                    pa.array(pieces, pa.list_(pa.string())),
                    pa.array(quotes, quote),
                ],
                ["conv_id", "turn", "role", "body", "keys", "pieces", "quotes"],
            )

    chosen = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "text")
    return in_arrow(chosen, run, PARSED)


def ancestors(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, turn, root_turn, depth)`` from ``(conv_id, turn, parent_turn)``.

    Every message points at its parent, and in each round at what its target points at, so steps double.
    A message that has reached its root leaves the rounds; only long chains stay for the later ones.
    """
    is_root = F.col("parent_turn").isNull()
    pointers = parents.select(
        "conv_id",
        "turn",
        F.coalesce("parent_turn", "turn").alias("up"),
        F.when(is_root, 0).otherwise(1).cast("long").alias("depth"),
        is_root.alias("final"),
    )
    settled, moving = scratch.store(pointers.filter("final")), scratch.store(pointers.filter("NOT final"))
    while not moving.isEmpty():
        targets = settled.union(moving).select(
            F.col("conv_id").alias("conv"), F.col("turn").alias("at"), F.col("up").alias("upper"), "depth", "final"
        )
        targets = targets.withColumnsRenamed({"depth": "more", "final": "arrived"})
        stepped = moving.join(targets, (F.col("conv_id") == F.col("conv")) & (F.col("up") == F.col("at")))
        moved = scratch.store(
            stepped.select(
                "conv_id",
                "turn",
                F.col("upper").alias("up"),
                (F.col("depth") + F.col("more")).alias("depth"),
                F.col("arrived").alias("final"),
            )
        )
        still = scratch.store(moved.filter("NOT final"))
        reached = scratch.store(settled.union(moved.filter("final")))
        scratch.drop(settled, moving, moved)
        settled, moving = reached, still
    return settled.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")


def partial_origins(known: DataFrame, unmet: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, key, origin)``: for quotes ``unmet (conv_id, key, pieces)`` the earliest message that has
    all their pieces in order, if any does.

    Equal quotes and equal messages of a conversation are looked at once, and a quote meets the messages
    that share its rarest piece only.
    """
    wanted = scratch.store(unmet.filter(F.size("pieces") > 0).groupBy("conv_id", "key").agg(F.min("pieces").alias("pieces")))
    said = known.filter(F.size("pieces") > 0).select("conv_id", "turn", F.col("pieces").alias("has"))
    said = said.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi")
    said = scratch.store(said.groupBy("conv_id", "has").agg(F.min("turn").alias("origin")))
    places = scratch.store(said.select("conv_id", "origin", "has", F.explode(F.array_distinct("has")).alias("piece")).drop("has"))
    counted = places.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("origin").alias("earliest"))
    asked = wanted.select("conv_id", "key", "pieces", F.explode(F.array_distinct("pieces")).alias("piece"))
    rarest = asked.join(counted, ["conv_id", "piece"]).groupBy("conv_id", "key", "pieces")
    rarest = scratch.store(rarest.agg(F.min(F.struct("n", "piece", "earliest")).alias("least")))
    single = rarest.filter(F.size("pieces") == 1).select("conv_id", "key", F.col("least.earliest").alias("origin"))
    several = rarest.filter(F.size("pieces") > 1).select("conv_id", "key", "pieces", F.col("least.piece").alias("piece"))
    met = several.join(places, ["conv_id", "piece"]).join(said, ["conv_id", "origin"])
    # The place behind the last piece found; 0 once a piece is missing.
    found = "array_position(slice(has, int(at), greatest(size(has) - int(at) + 1, 0)), piece)"
    covered = F.expr(
        f"aggregate(pieces, 1L, (at, piece) -> CASE WHEN at = 0 THEN 0L WHEN {found} = 0 THEN 0L ELSE at + {found} END) > 0"
    )
    return single.union(met.filter(covered).groupBy("conv_id", "key").agg(F.min("origin").alias("origin")))


def link(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, parent_turn, root_turn, depth, n_quotes, n_linked, body)``, one row for
    each row of ``messages (conv_id, turn, role, text, ...)``.

    A quote is linked to the earliest message of its conversation whose own words, whole or a paragraph,
    equal the quoted passage, if that message is earlier than the reply; failing that, to the earliest that
    has all lines and sentences of the passage in order. ``parent_turn`` is the latest
    message linked by an outermost quote, or null; ``root_turn`` and ``depth`` follow parents up. Ordered
    by conversation, root and turn, every reply stands behind what it replies to. A null or empty text is
    an empty body; rows without a conversation or a turn are never linked, but stay. Rows that share
    conversation and turn are one message for linking; its parent is the earliest that any of them has.
    An empty table gives no rows.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = scratch.store(parsed(messages).withColumn("row", F.monotonically_increasing_id()))
    known = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    # A passage that many messages share is one row after this.
    originals = known.select("conv_id", "turn", F.explode("keys").alias("key")).groupBy("conv_id", "key")
    originals = originals.agg(F.min("turn").alias("origin"))
    quotes = known.select("row", "conv_id", "turn", F.explode("quotes").alias("quote"))
    quotes = quotes.select("row", "conv_id", "turn", "quote.level", "quote.key", "quote.pieces")
    tried = scratch.store(quotes.join(originals, ["conv_id", "key"], "left"))
    whole = tried.filter("origin < turn").drop("pieces")
    unmet = tried.filter("origin IS NULL OR origin >= turn").drop("origin")
    partial = unmet.drop("pieces").join(partial_origins(known, unmet, scratch), ["conv_id", "key"]).filter("origin < turn")
    linked = whole.unionByName(partial)
    by_row = linked.groupBy("row").agg(
        F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("own_parent"), F.count(F.lit(1)).alias("n_linked")
    )
    joined = scratch.store(rows.join(by_row, "row", "left").drop("row", "keys", "pieces"))
    keyed = joined.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    parents = keyed.groupBy("conv_id", "turn").agg(F.min("own_parent").alias("parent_turn"))
    parents = scratch.store(parents)
    above = ancestors(parents, scratch)
    placed = parents.join(above, ["conv_id", "turn"])
    return joined.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "body",
    )


def as_mail(messages: DataFrame) -> DataFrame:
    """Conversations as mail programs show them: each turn quotes the turn before it, and under that,
    one level deeper, the turn before that."""
    texts = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def earlier(back: int) -> DataFrame:
        return texts.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("said").alias(f"said{back}"))

    def quoted(name: str, marks: str) -> Column:
        return F.concat(F.lit(marks), F.replace(F.col(name), F.lit("\n"), F.lit(f"\n{marks}")), F.lit("\n"))

    joined = messages.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left")
    full = F.concat_ws("", quoted("said2", "> > "), quoted("said1", "> "), F.lit("\n"), "text")
    return joined.select("conv_id", "turn", "role", full.alias("text"))
