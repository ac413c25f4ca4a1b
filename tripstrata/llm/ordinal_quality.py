"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight vector is shared by all grades: ``P(grade > k) = sigmoid(score - threshold[k])`` with
thresholds in ascending order. The model is fitted on graded documents, at most ``SAMPLE_PER_GRADE``
of each grade; every document then gets its tail probabilities, its expected grade, and a verdict
by the probability of reaching ``MIN_GRADE``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.llm import hashed_text, spans
from tripstrata.llm.hashed_text import Sample, minimise, sigmoid
from tripstrata.llm.tables import Batches, in_arrow

#: Both flaws (poor quality, toxic), one of them, none.
GRADES = (0, 1, 2)
MIN_GRADE = 2
MIN_TAIL = 0.5
#: Documents of each grade that the model may be fitted on.
SAMPLE_PER_GRADE = 1_000
PENALTY = 1e-4


def grade() -> Column:
    """The graded rating of a label row, the number of things right with it; null when a flag is."""
    known = F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)
    return F.when(known, F.col("quality") + 1 - F.col("toxic"))


@dataclass
class Model:
    weights: np.ndarray
    #: ``thresholds[k]`` divides grades up to ``GRADES[k]`` from those above.
    thresholds: np.ndarray

    def tails(self, raw: np.ndarray) -> np.ndarray:
        """``P(grade >= GRADES[k + 1])`` for each row and k; falling in k."""
        return sigmoid(raw[:, None] - self.thresholds[None, :])


def thresholds_of(x: np.ndarray) -> np.ndarray:
    """The first threshold, and the logarithms of the gaps to the next ones."""
    return np.cumsum(np.concatenate([x[:1], np.exp(x[1:])]))


def fit(sample: Sample, grades: tuple[int, ...] = GRADES, penalty: float = PENALTY) -> Model:
    """Maximum likelihood with an L2 penalty on the weights.

    All grades count alike while the weights are learned; the thresholds are then refitted with the
    grades' true shares. A grade without rows leaves its threshold where the penalty on extreme
    thresholds puts it. Without any rows every document gets even odds at each threshold's start.
    """
    size, cuts = 2 * hashed_text.BUCKETS, len(grades) - 1
    level = np.searchsorted(grades, sample.labels)
    start = np.concatenate([np.zeros(size), [-1.0], np.zeros(cuts - 1)])
    if not len(sample):
        return Model(np.zeros(size), thresholds_of(start[size:]))
    sizes = np.bincount(level, minlength=len(grades))
    even = 1.0 / sizes[level] / np.count_nonzero(sizes)

    def likelihood(raw: np.ndarray, x: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, its slope by row, and its slope by threshold parameter."""
        at = thresholds_of(x)
        bounds = np.concatenate([[-np.inf], at, [np.inf]])
        low, high = raw - bounds[level], raw - bounds[level + 1]
        # P(level) = sigmoid(low) - sigmoid(high), which is kept above rounding.
        p_low, p_high = sigmoid(low), sigmoid(high)
        p = np.maximum(p_low - p_high, 1e-12)
        d_low, d_high = p_low * (1 - p_low), p_high * (1 - p_high)
        by_row = -share * (d_low - d_high) / p
        by_cut = np.zeros(cuts)
        inside = level > 0
        np.add.at(by_cut, level[inside] - 1, (share * d_low / p)[inside])
        inside = level < cuts
        np.add.at(by_cut, level[inside], -(share * d_high / p)[inside])
        gaps = np.exp(x[1:])
        after = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([after[:1], gaps * after[1:]])
        prior = 1e-3 * x
        return float(-share @ np.log(p) + 0.5e-3 * (x @ x)), by_row, slope + prior

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, by_row, by_cut = likelihood(sample.times(x[:size]), x[size:], even)
        value += 0.5 * penalty * float(x[:size] @ x[:size])
        return value, np.concatenate([sample.transposed(by_row) + penalty * x[:size], by_cut])

    x = minimise(start, loss)
    raw = sample.times(x[:size])

    def only_cuts(cut: np.ndarray) -> tuple[float, np.ndarray]:
        value, _, slope = likelihood(raw, cut, sample.weights)
        return value, slope

    return Model(x[:size], thresholds_of(minimise(x[size:], only_cuts)))


def train(docs: DataFrame, labels: DataFrame, per_grade: int = SAMPLE_PER_GRADE) -> Model:
    graded = labels.select("doc_id", grade().alias("rating"))
    return fit(hashed_text.labelled_sample(docs, graded, "rating", GRADES, per_grade))


def grade_documents(
    docs: DataFrame,
    labels: DataFrame,
    per_grade: int = SAMPLE_PER_GRADE,
    min_grade: int = MIN_GRADE,
    min_tail: float = MIN_TAIL,
) -> DataFrame:
    """``(doc_id, expected_grade, p_at_least_1, p_at_least_2, selected)``, one row for each row of
    ``docs (doc_id, text, ...)``.

    A null text is an empty one: without n-grams its score is 0 and only the thresholds speak. A text
    without words is never selected. Rows are judged one by one, so repeated rows get equal answers.
    An empty table gives no rows.
    """
    model = train(docs, labels, per_grade)
    cut = GRADES.index(min_grade) - 1

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for block in spans.blocks(batch.column("text")):
                hashed = hashed_text.word_hashes(block)
                raw = hashed_text.scores_of(hashed_text.grams_of(block, hashed), model.weights)
                tails = model.tails(raw)
                steps = np.diff(GRADES)
                selected = (tails[:, cut] >= min_tail) & (hashed[1].counts > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.lo, block.rows),
                        pa.array(GRADES[0] + tails @ steps),
                        *(pa.array(np.ascontiguousarray(tails[:, k])) for k in range(len(GRADES) - 1)),
                        pa.array(selected),
                    ],
                    names,
                )

    tail_names = [f"p_at_least_{g}" for g in GRADES[1:]]
    names = ["doc_id", "expected_grade", *tail_names, "selected"]
    schema = "doc_id long, expected_grade double, " + ", ".join(f"{n} double" for n in tail_names) + ", selected boolean"
    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
