"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizations of a text cut the same bytes. The byte offsets where both have a cut are found by
intersecting two hash sets of cumulative ends; the sorted common ends slice both id lists into groups,
and inside each group the overlapping tokens are linked. How often an id pair is linked in the corpus is
summed over the distinct pairs of segments of texts, not over single links, and joined back to the
segments, whose rows remember which pairs each document holds.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripstrata.llm import spans
from tripstrata.llm.tables import Batches, Scratch, in_arrow

#: Bytes of text whose distinct pairs are counted together.
SEGMENT_BYTES = 8 << 20
#: Longer texts are cut between two words before they go to the first tokenizer, to bound its memory.
PIECE_BYTES = 256 << 10
#: Pairs in one row of a segment.
PAIRS_PER_ROW = 8192
_SHIFT = 32
#: Anything but Latin letters up to U+024F and common punctuation.
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def _byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 bytes stand
    for themselves, the others for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(256 + i): byte for i, byte in enumerate(others)}


@dataclass
class Tokenizer:
    """Ids of texts, and the bytes and decimal form of each id."""

    encode: Callable[[str], list[int]]
    token_bytes: list[bytes]

    def __post_init__(self):
        self.sizes = np.array([len(raw) for raw in self.token_bytes], dtype=np.int64)

    def names(self, inner: str, last: str) -> list[str]:
        """Ids in decimal with what follows them inside a group and at its end, one list after the other."""
        return [f"{i}{after}" for after in (inner, last) for i in range(len(self.token_bytes))]


def _plain_ranks(path: str, raw: list[bytes]) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if the file's merges are in the order of their ids and nothing but the
    byte-level pre-tokenizer comes before them: merging by lowest id is then merging by the file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
    added = {token["id"] for token in spec.get("added_tokens", [])}
    plain = (
        model.get("type", "BPE") == "BPE"
        and not spec.get("normalizer")
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not any(model.get(key) for key in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and merged == sorted(set(merged))
        and merged[:1] != [-1]
    )
    return {token: i for i, token in enumerate(raw) if i not in added} if plain else None


@functools.cache
def byte_level(path: str, fast: bool = True) -> Tokenizer:
    """A byte-level BPE file of the tokenizers library, over space + text, without special tokens.

    Texts of Latin letters go through tiktoken with the file's own vocabulary, when that is the same
    encoding (``_plain_ranks``); it takes a quarter of the time. All others go through the library, whose
    Unicode classes may be of another version.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer as Library

    library = Library.from_file(path)
    library.encode_special_tokens = True
    alphabet = _byte_alphabet()
    size = library.get_vocab_size(with_added_tokens=True)
    # An added token is not written in the byte alphabet; it is never produced here.
    entries = [library.id_to_token(i) or "" for i in range(size)]
    raw = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
    ranks = _plain_ranks(path, raw) if fast else None
    quick = None
    if ranks is not None:
        quick = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if quick is not None and not _OTHER.search(text):
            return quick.encode_ordinary(" " + text)
        ids: list[int] = []
        for piece in _pieces(" " + text):
            ids += library.encode(piece, add_special_tokens=False).ids
        return ids

    return Tokenizer(encode, raw)


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE_BYTES`` characters, cut before a blank between two letters,
    where a token of the pre-tokenizer starts in any case."""
    at = 0
    while len(text) - at > PIECE_BYTES and (cut := _CUT.search(text, at + PIECE_BYTES)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@functools.cache
def pieces(path: str) -> Tokenizer:
    """A sentencepiece model, over the text; it adds the space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(model.get_piece_size()):
        entry = model.id_to_piece(i)
        raw.append(bytes([int(entry[3:5], 16)]) if model.is_byte(i) else entry.replace("▁", " ").encode())
    return Tokenizer(lambda text: model.encode(text, num_threads=1), raw)


_NONE = np.zeros(0, np.int64)


@dataclass
class Aligned:
    a: np.ndarray
    b: np.ndarray
    #: Where the groups end in both id lists, first id behind them.
    stops_a: np.ndarray
    stops_b: np.ndarray
    #: ``a << 32 | b`` of each link.
    links: np.ndarray

    def groups(self, names: list[str], first_b: int) -> str:
        """The groups as text. ``names`` holds the ids of A as ``Tokenizer.names(",", "|")`` and, from
        ``first_b`` on, those of B as ``Tokenizer.names(",", ";")``."""
        in_a, in_b = np.diff(self.stops_a, prepend=0), np.diff(self.stops_b, prepend=0)
        written = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        # A group's A tokens stand behind the earlier groups' B tokens, its B tokens behind its own A tokens.
        place_a = np.arange(len(self.a)) + np.repeat(self.stops_b - in_b, in_a)
        place_b = np.arange(len(self.b)) + np.repeat(self.stops_a, in_b)
        written[place_a], written[place_b] = self.a, self.b + first_b
        written[place_a[self.stops_a - 1]] += first_b // 2
        written[place_b[self.stops_b - 1]] += (len(names) - first_b) // 2
        return "".join([names[i] for i in written.tolist()])[:-1]


NOTHING = Aligned(_NONE, _NONE, _NONE, _NONE, _NONE)


def _links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> np.ndarray:
    """Links of all groups, slice by slice. With one token on a side, it meets all of the other side's;
    otherwise tokens are linked where they overlap."""
    in_a, in_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
    group_b = np.repeat(np.arange(len(stops_b)), in_b)
    single = in_a[group_b] == 1
    found = [a[stops_a[group_b[single]] - 1] << _SHIFT | b[single]]
    group_a = np.repeat(np.arange(len(stops_a)), in_a)
    single = (in_b[group_a] == 1) & (in_a[group_a] > 1)
    found.append(a[single] << _SHIFT | b[stops_b[group_a[single]] - 1])
    # Elsewhere each stretch between two neighbouring ends of either side lies in one token of both.
    many = (in_a > 1) & (in_b > 1)
    own_a, own_b = np.flatnonzero(many[group_a]), np.flatnonzero(many[group_b])
    stretches = np.union1d(ends_a[own_a], ends_b[own_b])
    at_a, at_b = np.searchsorted(ends_a[own_a], stretches), np.searchsorted(ends_b[own_b], stretches)
    found.append(a[own_a[at_a]] << _SHIFT | b[own_b[at_b]])
    return np.concatenate(found)


def align(text: str | None, left: Tokenizer, right: Tokenizer) -> Aligned:
    """Groups and links of one text; nothing, if it is null or empty or either tokenizer changes its bytes."""
    if not text:
        return NOTHING
    ids_a, ids_b = left.encode(text), right.encode(text)
    whole = b" " + text.encode()
    if b"".join([left.token_bytes[i] for i in ids_a]) != whole or b"".join([right.token_bytes[i] for i in ids_b]) != whole:
        return NOTHING
    a, b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
    ends_a, ends_b = np.cumsum(left.sizes[a]), np.cumsum(right.sizes[b])
    index_a = dict(zip(ends_a.tolist(), range(1, len(a) + 1)))
    index_b = dict(zip(ends_b.tolist(), range(1, len(b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    stops_a = np.array([index_a[end] for end in common], dtype=np.int64)
    stops_b = np.array([index_b[end] for end in common], dtype=np.int64)
    return Aligned(a, b, stops_a, stops_b, _links(a, b, ends_a, ends_b, stops_a, stops_b))


def segments(docs: DataFrame, key: str, text: str, left_path: str, right_path: str, limit: int | None = None) -> DataFrame:
    """Two kinds of rows. One for each document: its id, sizes, and its distinct pairs as places in the
    sorted pairs of its segment with their numbers. And, for each segment, rows of its distinct pairs
    with their counts. A segment's name is new each time, so the result has to be stored before use."""
    limit = limit or SEGMENT_BYTES

    def run(batches: Batches) -> Batches:
        left, right = byte_level(left_path), pieces(right_path)
        names_a = left.names(",", "|")
        written, first_b = names_a + right.names(",", ";"), len(names_a)
        for batch in batches:
            for block in spans.blocks(batch.column("text"), limit):
                rows = batch.slice(block.lo, block.rows)
                name = uuid.uuid4().hex
                sizes, digests, found = [], [], []
                for content in rows.column("text").to_pylist():
                    one = align(content, left, right)
                    sizes.append((len(one.a), len(one.b), len(one.stops_a), len(one.links)))
                    digests.append(hashlib.sha256(one.groups(written, first_b).encode()).hexdigest() if len(one.a) else "")
                    found.append(np.unique(one.links, return_counts=True))
                distinct, place = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
                times = np.concatenate([c for _, c in found])
                totals = np.bincount(place, times, minlength=len(distinct)).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(p) for p, _ in found])])
                none = [None] * len(found)
                columns = [
                    rows.column("id"),
                    pa.array([name] * len(found)),
                    *(pa.array(list(c), pa.int64()) for c in zip(*sizes)),
                    pa.array(digests),
                    pa.array([place[x:y].astype("<i4").tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary()),
                    pa.array([times[x:y].astype("<i4").tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary()),
                    pa.array(none, pa.list_(pa.int64())),
                    pa.array(none, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                parts = range(0, len(distinct), PAIRS_PER_ROW)
                if not parts:
                    continue
                empty = [None] * len(parts)
                columns = [
                    pa.array(empty, rows.schema.field("id").type),
                    pa.array([name] * len(parts)),
                    *(pa.array(empty, pa.int64()) for _ in range(4)),
                    pa.array(empty, pa.string()),
                    pa.array(empty, pa.binary()),
                    pa.array(empty, pa.binary()),
                    pa.array([distinct[x : x + PAIRS_PER_ROW] for x in parts], pa.list_(pa.int64())),
                    pa.array([totals[x : x + PAIRS_PER_ROW] for x in parts], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    names = ["id", "segment", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "times", "pairs", "counts"]
    schema = (
        f"id {kind}, segment string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "held binary, times binary, pairs array<bigint>, counts array<bigint>"
    )
    return in_arrow(chosen, run, schema)


def pair_counts(stored: DataFrame) -> DataFrame:
    """``(pair, n, best)``: links of each id pair in the corpus, and whether no pair of its B id has more."""
    each = stored.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    totals = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    # A B id has at most as many pairs as the A vocabulary has ids.
    same_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << _SHIFT) - 1))
    return totals.withColumn("best", F.col("n") == F.max("n").over(same_b))


def align_documents(
    docs: DataFrame, left_path: str, right_path: str, key: str = "doc_id", text: str = "text", segment_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The documents' alignment and the corpus's pairs.

    The first table is ``(<key>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row
    for each row of ``docs``: tokens by the byte-level BPE at ``left_path`` over space + text (A) and by
    the sentencepiece model at ``right_path`` over the text (B), groups between common ends, links
    between overlapping tokens, links whose pair has its B id's highest count, and the sum of the pairs'
    counts over the links. The second is ``(a_id, b_id, n, best)``.

    A null or empty text has no tokens, nor has one whose bytes either tokenizer changes: zeros and an
    empty digest. Repeated rows are answered, and counted, one by one; an empty table gives no rows. Other
    columns of ``docs`` are not read. The tokenizers' files must be at the same paths on every machine.
    """
    scratch = Scratch(docs.sparkSession, "token-alignment")
    stored = scratch.store(segments(docs, key, text, left_path, right_path, segment_bytes))
    ranked = scratch.store(pair_counts(stored))
    own = stored.filter("pairs IS NOT NULL").select(F.col("segment").alias("of_segment"), F.explode("pairs").alias("pair"))
    weights = own.join(ranked, "pair").select("of_segment", "pair", "n", "best")
    rows = stored.filter("pairs IS NULL").drop("pairs", "counts")
    kind = rows.schema["id"].dataType.simpleString()

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        n = right.column("n").to_numpy()
        best = right.column("best").to_numpy(zero_copy_only=False) if right.num_rows else np.zeros(0, bool)
        n_best, total = [], []
        for held, times in zip(left.column("held"), left.column("times")):
            at = np.frombuffer(held.as_buffer(), "<i4")
            many = np.frombuffer(times.as_buffer(), "<i4").astype(np.int64)
            n_best.append(int(many[best[at]].sum()))
            total.append(int(many @ n[at]) if len(at) else 0)
        kept = left.select(["id", "n_a", "n_b", "n_groups", "n_links"])
        kept = kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))
        return kept.append_column("groups_sha256", left.column("groups_sha256"))

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    weighed = rows.groupBy("segment").cogroup(weights.groupBy("of_segment")).applyInArrow(weigh, schema)
    mask = F.lit((1 << _SHIFT) - 1)
    pairs = ranked.select(
        F.shiftright("pair", _SHIFT).cast("int").alias("a_id"), F.col("pair").bitwiseAND(mask).cast("int").alias("b_id"), "n", "best"
    )
    return weighed.withColumnRenamed("id", key), pairs
