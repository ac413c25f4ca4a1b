"""Secret scanning with a random forest that sorts out false positives.

Long words of a narrow alphabet are candidates. Each is described by its length, its character classes
and how often they change, how much of it dictionary words cover, the path it lies under, and the words
around it. A forest trained on labelled findings, at most ``SAMPLE_PER_LABEL`` of each label, scores
all candidates. The dictionary is counted over the whole corpus.

DataFrame expressions and Spark ML only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.llm.tables import Scratch

MIN_LENGTH = 16
#: Words seen this often are in the dictionary.
MIN_WORD_COUNT = 20
SAMPLE_PER_LABEL = 2_000
TREES, DEPTH, SEED = 20, 6, 42
THRESHOLD = 0.5
PATH_BUCKETS = 16
ALPHABET = "[A-Za-z0-9_+/=.-]"
_RUN = f"{ALPHABET}{{{MIN_LENGTH},}}"
#: A name before a value that is long enough itself.
_NAMED = rf"^([A-Za-z_][A-Za-z0-9_./-]{{0,39}}=)([^=]{{{MIN_LENGTH},}}={{0,2}})$"
#: Formats that say what they are.
KNOWN = "^(" + "|".join(
    (
        "(AKIA|ASIA)[0-9A-Z]{16}",
        "gh[pousr]_[A-Za-z0-9]{36,}",
        "github_pat_[A-Za-z0-9_]{22,}",
        "glpat-[A-Za-z0-9_-]{20,}",
        "xox[abprs]-[A-Za-z0-9-]{10,}",
        "[sr]k_(live|test)_[A-Za-z0-9]{16,}",
        "AIza[A-Za-z0-9_-]{35}",
        r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    )
) + ")$"
KEYWORDS = ("token", "secret", "password", "passwd", "apikey", "api_key", "access_key", "key", "auth", "credential")

FEATURES = [
    "f_length",
    "f_digits",
    "f_upper",
    "f_symbols",
    "f_distinct",
    "f_class_changes",
    "f_vowel_changes",
    "f_dictionary",
    "f_path",
    "f_keyword",
    "f_assigned",
    "f_quoted",
    "f_next",
]

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VOWELS = "aeiou"


def findings(docs: DataFrame) -> DataFrame:
    """``(doc_id, path, word_no, candidate, word, before, before2, after)``: one row a candidate, the
    first run of at least ``MIN_LENGTH`` characters of the alphabet in a word."""
    words = docs.select("doc_id", F.col("source").alias("path"), F.split("text", r"[\x20\x09-\x0D]+").alias("words"))
    places = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.length(F.get("words", i)) >= MIN_LENGTH
    )
    rows = words.select("doc_id", "path", "words", F.explode(places).alias("word_no"))

    def at(offset: int) -> Column:
        place = F.col("word_no") + offset
        return F.coalesce(F.when(place >= 0, F.get("words", F.greatest(place, F.lit(0)))), F.lit(""))

    rows = rows.select(
        "doc_id", "path", "word_no", at(0).alias("word"), at(-1).alias("before"), at(-2).alias("before2"), at(1).alias("after")
    )
    found = F.regexp_extract("word", f"{ALPHABET}{{{MIN_LENGTH},}}", 0)
    return rows.withColumn("candidate", found).filter("candidate <> ''")


def all_findings(docs: DataFrame) -> DataFrame:
    """As ``findings``, with every run of a word as a row of its own, numbered by ``run_no`` from 0.

    ``word`` is the run with what stands between it and the run before it. A name that is assigned inside
    the word, ``name=`` in front of the value included, stands for the words before; the candidate is the
    value alone.
    """
    words = docs.select("doc_id", F.col("source").alias("path"), F.split("text", r"[\x20\x09-\x0D]+").alias("words"))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.length(F.get("words", i)) >= MIN_LENGTH)
    rows = words.select("doc_id", "path", "words", F.explode(places).alias("word_no"))

    def at(offset: int) -> Column:
        place = F.col("word_no") + offset
        return F.coalesce(F.when(place >= 0, F.get("words", F.greatest(place, F.lit(0)))), F.lit(""))

    rows = rows.select(
        "doc_id", "path", "word_no", at(0).alias("word"), at(-1).alias("before"), at(-2).alias("before2"), at(1).alias("after")
    )
    runs = F.regexp_extract_all("word", F.lit(_RUN), F.lit(0))
    rows = rows.withColumn("gaps", F.split("word", _RUN)).withColumn("runs", runs)
    rows = rows.select("*", F.posexplode("runs").alias("run_no", "run")).withColumn("gap", F.get("gaps", F.col("run_no")))
    name = F.regexp_extract("run", _NAMED, 1)
    rows = rows.withColumn("lead", F.concat("gap", name)).withColumn(
        "candidate", F.when(name != "", F.regexp_extract("run", _NAMED, 2)).otherwise(F.col("run"))
    )
    own = F.col("lead").rlike(r"[A-Za-z_][\"'`]?[=:]+[\"'`]?$")
    # Within JSON, "name":"value" with a long name has the name as the run before.
    earlier = F.when(F.col("run_no") > 0, F.get("runs", F.greatest(F.col("run_no") - 1, F.lit(0))))
    assigned = earlier.isNotNull() & F.col("lead").rlike(r"^[\"'`]?[=:]+[\"'`]?$")
    return rows.select(
        "doc_id",
        "path",
        "word_no",
        "run_no",
        "candidate",
        F.concat(F.when(assigned, earlier).otherwise(F.lit("")), "lead", "candidate").alias("word"),
        F.when(own | assigned, F.lit("")).otherwise(F.col("before")).alias("before"),
        F.when(own | assigned, F.lit("")).otherwise(F.col("before2")).alias("before2"),
        "after",
        F.when(assigned, F.concat(earlier, "lead")).otherwise(F.col("lead")).alias("lead"),
    )


def dictionary(docs: DataFrame, least: int = MIN_WORD_COUNT) -> DataFrame:
    """``(run)``: lower-case words of three letters and more that the corpus holds at least ``least`` times."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("run")).filter(F.length("run") >= 3)
    return words.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("run")


def _share(counted: Column) -> Column:
    return counted / F.length("candidate")


def _kept(characters: str) -> Column:
    return F.length(F.regexp_replace("candidate", f"[^{characters}]", "")).cast("double")


def _changes(classes: Column) -> Column:
    """How often neighbouring characters are of different classes."""
    return (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1).cast("double")


def described(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (with a unique ``finding``) and their features."""
    lower = F.lower(F.col("candidate"))
    runs = rows.select("finding", F.explode(F.regexp_extract_all(lower, F.lit("[a-z]{3,}"), F.lit(0))).alias("run"))
    covered = runs.join(known, "run").groupBy("finding").agg(F.sum(F.length("run")).alias("covered"))
    classes = F.translate(
        F.translate(F.translate("candidate", "0123456789", "0" * 10), _LETTERS, "a" * 26), _LETTERS.upper(), "A" * 26
    )
    consonants = "".join(c for c in _LETTERS if c not in _VOWELS)
    sounds = F.translate(F.translate(lower, _VOWELS, "a" * 5), consonants, "b" * len(consonants))
    context = F.lower(F.concat_ws(" ", "before2", "before", "word"))
    keyword = context.rlike("(^|[^a-z])(" + "|".join(KEYWORDS) + ")([^a-z]|$)")
    assigned = F.col("before").rlike("[=:]$") | F.col("word").rlike(r"^[^=:]+[=:]+[\"']?.")
    values = {
        "f_length": F.length("candidate"),
        "f_digits": _share(_kept("0-9")),
        "f_upper": _share(_kept("A-Z")),
        "f_symbols": _share(_kept("_+/=.-")),
        "f_distinct": _share(F.size(F.array_distinct(F.split("candidate", "")))),
        "f_class_changes": _share(_changes(classes)),
        "f_vowel_changes": _share(_changes(sounds)),
        "f_dictionary": _share(F.coalesce("covered", F.lit(0))),
        "f_path": F.pmod(F.crc32(F.coalesce("path", F.lit("")).cast("binary")), F.lit(PATH_BUCKETS)),
        "f_keyword": keyword,
        "f_assigned": assigned,
        "f_quoted": F.col("word").rlike("[\"'`]"),
        "f_next": F.length("after"),
    }
    joined = rows.join(covered, "finding", "left")
    return joined.select(*rows.columns, *(values[name].cast("double").alias(name) for name in FEATURES))


def rule_labels(rows: DataFrame) -> DataFrame:
    """Labelled findings where no reviewed ones exist: a long random-looking value that is assigned to
    a name on the key list is a true finding, everything else is not."""
    names = F.lower(F.concat_ws(" ", "before2", "before"))
    random_like = F.col("candidate").rlike("^[0-9A-Fa-f]{32,}$")
    return rows.withColumn("label", (random_like & names.rlike(r"(token|secret|key|password)\W*[=:]$")).cast("double"))


def form_labels(rows: DataFrame) -> DataFrame:
    """Labels for ``all_findings`` where no reviewed ones exist. True are known formats, and long hexadecimal
    or mixed-class values assigned to a name on the key list. Other values under such a name, and
    mixed-class ones under none, are uncertain and stay without a label; the rest is false."""
    names = F.lower(F.concat_ws(" ", "before2", "before", "lead"))
    # Names like "access_key" or "x-auth-token" end in a word of the list.
    keyed = names.rlike("(" + "|".join(KEYWORDS) + r")[\"'`]?\s*[=:]+\s*[\"'`(]*\s*$")
    candidate = F.col("candidate")
    mixed = candidate.rlike("[a-z]") & candidate.rlike("[A-Z]") & candidate.rlike("[0-9]") & (F.length("candidate") >= 20)
    mixed = mixed & candidate.rlike("^[A-Za-z0-9_+/-]+={0,2}$")
    true = candidate.rlike(KNOWN) | (keyed & (mixed | candidate.rlike("^[0-9A-Fa-f]{32,}$")))
    label = F.when(true, 1.0).when(keyed | mixed, F.lit(None).cast("double")).otherwise(0.0)
    return rows.withColumn("label", label)


def train(labelled: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> RandomForestClassificationModel | float:
    """A forest fitted on at most ``per_label`` findings of each label, those with the smallest hashes.
    With one label only, that label is every finding's score; with none, 1: nothing is known to be false."""
    order = F.xxhash64("candidate", "before", "before2", "finding")
    parts = [labelled.filter(F.col("label") == v).orderBy(order, "finding").limit(per_label) for v in (0.0, 1.0)]
    sample = parts[0].union(parts[1]).select("label", *FEATURES).coalesce(1)
    present = [row["label"] for row in sample.select("label").distinct().collect()]
    if len(present) < 2:
        return present[0] if present else 1.0
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return forest.fit(assembled)


def scan(
    docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, whole: bool = False
) -> DataFrame:
    """``(doc_id, word_no, candidate, score, is_secret)``, one row for each candidate of ``docs (doc_id,
    text, source, ...)``; ``word_no`` counts words from 0.

    ``labels (candidate, label)`` are reviewed findings; without them ``rule_labels`` judges. A null
    text has no candidates, a null source is an empty path. Repeated rows are scanned one by one.
    With labels of one kind only every candidate gets that label's score, with none the score 1. An
    empty table gives no rows. With ``whole`` every run of a word is a candidate, with ``run_no`` behind
    ``word_no``; without labels ``form_labels`` judges, and what it knows to be true has the score 1.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.store((all_findings if whole else findings)(docs).withColumn("finding", F.monotonically_increasing_id()))
    known = scratch.store(dictionary(docs))
    full = scratch.store(described(rows, known))
    if labels is None:
        labelled = (form_labels if whole else rule_labels)(full)
    else:
        agreed = labels.groupBy("candidate").agg(F.min("label").alias("label"), F.max("label").alias("most"))
        labelled = full.join(agreed.filter("label = most").drop("most"), "candidate")
    model = train(labelled)
    if isinstance(model, float):
        scored = full.withColumn("score", F.lit(model))
    else:
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full)
        scored = model.transform(assembled).withColumn("score", vector_to_array("probability")[1])
    if whole and labels is None:
        scored = form_labels(scored).withColumn("score", F.when(F.col("label") == 1, 1.0).otherwise(F.col("score")))
    places = ["word_no", "run_no"] if whole else ["word_no"]
    return scored.select("doc_id", *places, "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
