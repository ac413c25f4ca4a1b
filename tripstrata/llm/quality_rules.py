"""Quality rules: counted base rules, then a calibrated logistic regression on hashed n-grams.

The regression is trained on labelled quality rows. Its bound is ``SAMPLE_PER_LABEL`` documents for
each label; a fifth of them, chosen by hash, is held out to calibrate the probability (Platt scaling
with the labels' true shares). All documents are then scored in Arrow batches against a fixed
threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.llm import hashed_text, spans
from tripstrata.llm.hashed_text import Sample, minimise, sigmoid
from tripstrata.llm.tables import Batches, in_arrow

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: Rows of each label that the model may be fitted on.
SAMPLE_PER_LABEL = 1_500
#: Documents with at least this calibrated probability of good quality are kept.
THRESHOLD = 0.5
PENALTY = 1e-4

SYMBOLS = spans.byte_class(b"#*$%&|<>")
_NEWLINE = 0x0A
_U = np.uint64

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{name} long" for name in STATS) + ", base_failed boolean, score double"


def _later_equal(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True where an earlier entry of the same row has the same key. Entries stand in row order."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    same = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        a, b = order[:-1], order[1:]
        same[b] = (keys[a] == keys[b]) & (rows[a] == rows[b])
    return same


def base_counts(block: spans.Block) -> tuple[dict[str, np.ndarray], spans.Words]:
    """The counted properties of each text, over whole texts and their words as written."""
    data = block.data
    found = spans.words(block, data, spans.NOT_BLANK)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = lead[found.starts + found.lengths] - lead[found.starts]
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])

    # Lines with a word, by the hash of the whole line.
    cuts = np.flatnonzero(data == _NEWLINE)
    begin = np.unique(np.concatenate([block.offsets[:-1], cuts + 1]))
    begin = begin[begin < len(data)]
    stop = np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin
    ends_line = (stop > begin) & (data[np.maximum(stop - 1, 0)] == _NEWLINE) if len(begin) else np.zeros(0, bool)
    length = stop - begin - ends_line
    first_word = np.searchsorted(found.starts, begin)
    has_word = (first_word < len(found.starts)) & (np.append(found.starts, -1)[np.minimum(first_word, len(found.starts))] < stop)
    begin, length = begin[has_word], length[has_word]
    line_row = np.searchsorted(block.offsets, begin, side="right") - 1
    repeated = _later_equal(spans.xxh64(data, begin, length), line_row)
    dup_lines = np.bincount(line_row[repeated], minlength=block.rows)

    # Words inside a three-word window that occurs more than once.
    hashes = spans.xxh64(data, found.starts, found.lengths)
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) >= WINDOW:
        a, b, c = hashes[:-2], hashes[1:-1], hashes[2:]
        mixed = (a * _U(0x9E3779B97F4A7C15)) ^ (b * _U(0xC2B2AE3D27D4EB4F) + (b >> _U(31))) ^ (c * _U(0x165667B19E3779F9) + (c >> _U(17)))
        row = found.row[:-2]
        at = np.flatnonzero(row == found.row[2:])
        order = at[np.lexsort((mixed[at], row[at]))]
        same = (mixed[order[1:]] == mixed[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        starts = order[twice[: len(order)]]
        for step in range(WINDOW):
            covered[starts + step] = True
    return {
        "n_words": found.counts,
        "word_chars": spans.per_row(chars, found.first),
        "n_symbols": np.diff(symbols[block.offsets]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": spans.per_row(covered, found.first),
    }, found


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    too_short = counts["n_words"] < MIN_WORDS
    return too_short | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


@dataclass
class Model:
    weights: np.ndarray
    #: Slope and intercept that turn the raw score into the log odds of good quality.
    slope: float
    intercept: float


def fit(sample: Sample, penalty: float = PENALTY) -> Model:
    """A logistic regression with an L2 penalty, calibrated on the held-out fifth.

    Without rows of both labels there is nothing to separate, and every document gets the only
    label's verdict (good, if there are no labels at all).
    """
    size = 2 * hashed_text.BUCKETS
    present = set(sample.labels.tolist())
    if len(present) < 2:
        return Model(np.zeros(size), 1.0, -10.0 if present == {0} else 10.0)
    labels = sample.labels
    held = np.arange(len(sample)) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    # Both labels count alike while the weights are learned; calibration restores their shares.
    sizes = np.bincount(labels[~held], minlength=2)
    even = np.where(held, 0.0, 0.5 / sizes[labels])
    margin = np.where(labels == 1, 1.0, -1.0)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = margin * (sample.times(x[:-1]) + x[-1])
        by_row = -even * margin * sigmoid(-z)
        value = float(even @ np.logaddexp(0.0, -z) + 0.5 * penalty * (x[:-1] @ x[:-1]))
        return value, np.append(sample.transposed(by_row) + penalty * x[:-1], by_row.sum())

    x = minimise(np.zeros(size + 1), loss)
    other = held if held.any() else ~held
    slope, intercept = calibrate((sample.times(x[:-1]) + x[-1])[other], labels[other], sample.weights[other])
    return Model(x[:-1], slope, intercept + slope * x[-1])


def calibrate(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Platt scaling: targets are drawn in from 0 and 1, so separable scores stay finite."""
    counts = np.bincount(labels, minlength=2)
    target = np.where(labels == 1, (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2))
    share = weights / weights.sum()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = x[0] * raw + x[1]
        value = float(share @ (np.logaddexp(0.0, z) - target * z))
        by_row = share * (sigmoid(z) - target)
        return value, np.array([by_row @ raw, by_row.sum()])

    slope, intercept = minimise(np.array([1.0, 0.0]), loss, rounds=200)
    return float(slope), float(intercept)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    return fit(hashed_text.labelled_sample(docs, labels, "quality", (0, 1), per_label))


def score_batch(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    """Counts, base verdict and calibrated probability of each row of a batch (``text``)."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in (*STATS, "base_failed", "score")}
    for block in spans.blocks(batch.column("text")):
        counts, _ = base_counts(block)
        raw = hashed_text.scores_of(hashed_text.grams_of(block), model.weights)
        for name in STATS:
            parts[name].append(counts[name].astype(np.int64))
        parts["base_failed"].append(base_failed(counts))
        parts["score"].append(sigmoid(model.slope * raw + model.intercept))
    columns = {name: np.concatenate(values) if values else np.zeros(0) for name, values in parts.items()}
    kinds = {"base_failed": pa.bool_(), "score": pa.float64()}
    return pa.RecordBatch.from_arrays(
        [pa.array(column).cast(kinds.get(name, pa.int64())) for name, column in columns.items()], list(columns)
    )


def assess(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)``,
    one row for each row of ``docs (doc_id, text, ...)``.

    A null text is an empty one: it has no words and fails the base rules. Rows are judged one by
    one, so repeated rows get equal answers; a null id stays null. An empty table gives no rows.
    Without usable labels only the base rules decide.
    """
    model = train(docs, labels, per_label)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            scored = score_batch(batch, model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *scored.columns], ["doc_id", *scored.schema.names]
            )

    scored = in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged, in one pass over them."""
    model = train(docs, labels, per_label)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            scored = score_batch(batch, model)
            failed = scored.column("base_failed").to_numpy(zero_copy_only=False)
            good = scored.column("score").to_numpy() >= threshold
            yield batch.filter(pa.array(~failed & good))

    return docs.mapInArrow(run, docs.schema)
