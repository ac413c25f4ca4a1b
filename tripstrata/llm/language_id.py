"""Language identification by averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its words' character n-grams, each looked up by hash; a
linear softmax over the average gives the probabilities of the languages. Embeddings and softmax are
trained by stochastic gradient descent in NumPy on a bounded sample of labelled documents. A held-out
part of the sample sets the temperature of the probabilities and the score under which an answer is
rejected as unreliable.

Since the softmax is linear, a text's scores are also the average of one row of ``embeddings @ softmax``
for each n-gram, which is how whole texts are scored, in blocks, without building averages of vectors.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripstrata.llm import spans
from tripstrata.llm.tables import Batches, Scratch, in_arrow

BUCKETS = 1 << 16
DIMENSIONS = 16
#: Lengths of the n-grams of a word between boundary marks; shorter words are one n-gram as a whole.
GRAMS = (2, 3, 4)
#: Documents of each language that the model may be fitted on, and n-grams that one contributes: all
#: of them, or so many taken at even distances over the whole text.
SAMPLE_PER_LANGUAGE = 800
GRAMS_PER_DOCUMENT = 512
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.5, 20_240_501
#: One in so many sample documents is kept for calibration.
CALIBRATION = 5
#: Accepted answers of the calibration part may be wrong this often.
MAX_ERROR = 0.01
UNDETERMINED = "und"

_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
#: Texts are joined by this before code points are classed; it is no letter.
_GAP = "\n"
_POINTS = 0x110000
#: Places of the joined texts that are hashed together.
STRETCH = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter (general category L), by code point."""
    return np.fromiter((chr(i).isalpha() for i in range(_POINTS)), dtype=bool, count=_POINTS)


def windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of the texts' words, and the text of each, a stretch of ``STRETCH`` places
    at a time, so memory follows the stretch however long the texts.

    Words are maximal runs of letters in lower case, with a mark at both ends; what is no letter only
    divides words.
    """
    lowered = [text.lower() for text in texts]
    joined = _GAP + _GAP.join(lowered) + _GAP
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    # The mark before a text's first word stands in front of the text and is counted as its own.
    bounds = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    for lo in range(0, len(points), STRETCH):
        piece = points[lo : lo + STRETCH + max(GRAMS) - 1]
        letter = _letters()[piece]
        marked = np.where(letter, piece, 0).astype(np.uint64)
        row = np.searchsorted(bounds, np.arange(lo, min(lo + STRETCH, len(points))), side="right").astype(np.int32) - 1
        breaks = np.concatenate([[0], np.cumsum(~letter)]).astype(np.int32)
        for size in GRAMS:
            span = min(len(piece) - size + 1, STRETCH)
            if span <= 0:
                continue
            # Only the first and last place may be marks, and not both of two.
            if size == 2:
                inside = letter[:span] | letter[1 : span + 1]
            else:
                inside = breaks[size - 1 : size - 1 + span] == breaks[1 : span + 1]
            picked = np.flatnonzero(inside)
            mixed = np.full(len(picked), _U(size))
            for place in range(size):
                mixed = (mixed ^ marked[picked + place]) * _MIX[0]
                mixed ^= mixed >> _U(29)
            yield ((mixed * _MIX[1]) >> _U(48)).astype(np.uint16), row[picked]


def subwords(texts: list[str]) -> list[np.ndarray]:
    """The buckets of each text's n-grams, in no order that matters."""
    found = list(windows(texts))
    buckets, row = np.concatenate([b for b, _ in found]), np.concatenate([r for _, r in found])
    order = np.argsort(row, kind="stable")
    return np.split(buckets[order], np.searchsorted(row[order], np.arange(1, len(texts))))


def _spread(n: int, limit: int) -> np.ndarray:
    """At most ``limit`` places of ``n`` at even distances."""
    return np.arange(n) if n <= limit else np.arange(limit) * n // limit


def texts_of(block: spans.Block) -> list[str]:
    raw = block.data.tobytes()
    bounds = block.offsets.tolist()
    return [raw[lo:hi].decode() for lo, hi in zip(bounds, bounds[1:])]


@dataclass
class Model:
    languages: list[str]
    #: For each language the scores of all buckets: embeddings times softmax weights. Then the biases.
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Answers below this score are unreliable.
    accept: float

    def logits(self, parts: Iterator[tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of ``rows`` texts from buckets and their texts, and the number of each text's n-grams."""
        sums, number = np.zeros((rows, len(self.languages))), np.zeros(rows, dtype=np.int64)
        for buckets, row in parts:
            number += np.bincount(row, minlength=rows)
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(row, self.scores[k][buckets], minlength=rows)
        return (sums / np.maximum(number, 1)[:, None] + self.bias) / self.temperature, number


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(documents: list[tuple[str, np.ndarray]]) -> Model:
    """Model of ``(language, buckets)`` in a fixed order. Without documents it knows no language."""
    languages = sorted({language for language, _ in documents})
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0), 1.0, 1.0)
    number = {language: k for k, language in enumerate(languages)}
    target = np.array([number[language] for language, _ in documents])
    held = np.arange(len(documents)) % CALIBRATION == CALIBRATION - 1
    learned = np.flatnonzero(~held)
    # Every language weighs alike, whatever its share of the sample.
    weight = 1.0 / np.maximum(np.bincount(target[learned], minlength=len(languages)), 1)
    weight *= len(learned) / max(np.count_nonzero(np.bincount(target[learned], minlength=len(languages))), 1)
    rng = np.random.default_rng(SEED)
    embeddings = rng.uniform(-1.0 / DIMENSIONS, 1.0 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps = EPOCHS * max(1, -(-len(learned) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(learned)
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            lengths = np.array([len(documents[r][1]) for r in rows])
            buckets = np.concatenate([documents[r][1] for r in rows])
            first = np.concatenate([[0], np.cumsum(lengths)])
            vectors = embeddings[buckets]
            mean = np.add.reduceat(vectors, first[:-1], axis=0) / lengths[:, None].astype(np.float32)
            error = softmax(mean @ weights + bias)
            error[np.arange(len(rows)), target[rows]] -= 1
            error *= weight[target[rows]][:, None]
            by_mean = (error @ weights.T).astype(np.float32)
            # Adding up by sorted bucket is faster than scattering one occurrence at a time.
            owner = np.repeat(np.arange(len(rows)), lengths)
            place = np.argsort(buckets, kind="stable")
            ordered = buckets[place]
            cut = np.flatnonzero(np.diff(ordered, prepend=-1))
            slopes = (by_mean / lengths[:, None].astype(np.float32))[owner[place]]
            # Embedding rows are met rarely and by small parts, so their steps are larger.
            embeddings[ordered[cut]] -= rate * 50 * np.add.reduceat(slopes, cut, axis=0)
            weights -= (rate * (mean.T @ error) / len(rows) * 4).astype(np.float32)
            bias -= (rate * error.mean(axis=0) * 0.1).astype(np.float32)
    model = Model(languages, np.ascontiguousarray((embeddings @ weights).T, np.float32), bias.astype(float), 1.0, 0.0)
    return calibrated(model, [documents[r] for r in np.flatnonzero(held)], target[held])


def calibrated(model: Model, documents: list[tuple[str, np.ndarray]], target: np.ndarray) -> Model:
    """Temperature by likelihood and the acceptance score by error rate on documents not learned from."""
    if not documents:
        return model
    row = np.repeat(np.arange(len(documents)), [len(b) for _, b in documents])
    logits, _ = model.logits(iter([(np.concatenate([b for _, b in documents]), row)]), len(documents))

    def loss(temperature: float) -> float:
        p = softmax(logits / temperature)[np.arange(len(target)), target]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    model.temperature = float(min(np.geomspace(0.05, 20.0, 121), key=loss))
    p = softmax(logits / model.temperature)
    best = p.max(axis=1)
    right = p.argmax(axis=1) == target
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(~right[order])
    good = np.flatnonzero(wrong <= MAX_ERROR * (np.arange(len(order)) + 1))
    # The lowest score down to which the accepted answers keep the error rate; above all, if none does.
    model.accept = float(best[order[good[-1]]]) if len(good) else sys.float_info.max
    return model


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3


def sample(docs: DataFrame, scratch: Scratch, key: str, text: str, language: str, limit: int) -> list[tuple[str, np.ndarray]]:
    """``(language, buckets)`` of at most ``limit`` different texts of each language, those with the
    smallest hashes, in the order of the hashes.

    A text that stands under several languages teaches none. Each language's candidates are cut down by
    a share of the hash range before they are ranked, so no task sees more than a few times ``limit`` of
    them. Two numbers for each document are shuffled; texts only of those chosen, once each.
    """
    labelled = docs.select(
        F.col(text).cast("string").alias("text"), F.col(language).cast("string").alias("language"), F.col(key).alias("key")
    ).filter(F.col("text").isNotNull() & F.col("language").isNotNull() & (remainder(F.col("key")) != 1) & F.col("text").rlike(r"\p{L}"))
    hashed = labelled.withColumn("hash", F.xxhash64("text", F.lit("language")))
    distinct = scratch.store(
        hashed.groupBy("hash")
        .agg(F.min("language").alias("language"), F.max("language").alias("highest"))
        .filter("language = highest")
        .select("hash", "language")
    )
    # Stored, so that its true size is known when the join is planned: a row for each language.
    sizes = scratch.store(distinct.groupBy("language").agg(F.count("*").alias("size")))
    share = F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) / float(1 << 30)
    near = distinct.join(sizes, "language").filter(share * F.col("size") <= 2 * limit + 100)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(F.xxhash64("hash"), "hash")))
    chosen = scratch.store(ranked.filter(F.col("rank") <= limit).select("hash", "language"))
    drawn = hashed.select("hash", "text").join(chosen, "hash").groupBy("hash").agg(F.first("language").alias("language"), F.first("text").alias("text"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for block in spans.blocks(batch.column("text")):
                own = subwords(texts_of(block))
                packed = [b[_spread(len(b), GRAMS_PER_DOCUMENT)].astype("<u2").tobytes() for b in own]
                rows = batch.slice(block.lo, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("hash"), rows.column("language"), pa.array(packed, pa.binary())], ["hash", "language", "buckets"]
                )

    rows = in_arrow(drawn, run, "hash long, language string, buckets binary").collect()
    rows.sort(key=lambda row: row["hash"])
    return [(r["language"], np.frombuffer(r["buckets"], "<u2").astype(np.int64)) for r in rows if len(r["buckets"])]


def identify(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """``(<key>, held_out, lang_pred, score, reliable)``, one row for each row of ``docs``.

    Learned from texts with a language whose id has a CRC-32 remainder by 3 other than 1; those with 1
    are ``held_out``. A prediction reads the text alone. ``score`` is the calibrated probability of the
    answer; ``reliable`` is false where it is below the score at which accepted answers of the
    calibration part stay within ``MAX_ERROR``. A text that is null or has no letter is ``und`` with
    score 0, as is every text where no document can be learned from. A null id is neither held out nor
    learned from. Equal texts get equal answers, repeated rows are answered one by one, and an empty
    table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "language-id")
    model = fit(sample(docs, scratch, key, text, language, per_language))

    def run(batches: Batches) -> Batches:
        known = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for block in spans.blocks(batch.column("text")):
                answers = np.full(block.rows, len(model.languages))
                scores = np.zeros(block.rows)
                if model.languages:
                    logits, number = model.logits(windows(texts_of(block)), block.rows)
                    p, some = softmax(logits), number > 0
                    answers[some] = p.argmax(axis=1)[some]
                    scores[some] = p.max(axis=1)[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(name).slice(block.lo, block.rows) for name in ("key", "held_out")),
                        pa.array(known[answers].tolist(), pa.string()),
                        pa.array(scores),
                        pa.array((scores >= model.accept) & (answers < len(model.languages))),
                    ],
                    ["key", "held_out", "lang_pred", "score", "reliable"],
                )

    chosen = docs.select(
        F.col(key).alias("key"), F.coalesce(remainder(F.col(key)) == 1, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text")
    )
    kind = chosen.schema["key"].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, lang_pred string, score double, reliable boolean"
    return in_arrow(chosen, run, schema).withColumnRenamed("key", key)
