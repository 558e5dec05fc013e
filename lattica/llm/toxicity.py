"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a seed lexicon and of a lexicon learned from the labelled rows, how
often such words stand near a second-person word, capitals, punctuation, symbols and obfuscated spellings.
Labels are learned from a sample of the labelled rows that are not held out: at most ``sample`` rows, those
with the smallest hashes of their ids.  Trees are fitted on most of them and the calibration on the others.

Defined results: a null text counts as empty; an empty text has the score of its (zero) features; a null id is
never held out; repeated rows each get a row; a document with several labels is toxic if one says so; null
labels are ignored.  Without labelled rows of both kinds the score is the share of toxic rows (0 without any).
Other columns are passed on or ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common

#: Labelled rows that a model is fitted on at most, and entries of the learned lexicon.
SAMPLE, LEXICON = 40_000, 512
#: A token of the learned lexicon occurs in so many toxic rows at least, with this likelihood-ratio statistic.
LEAST_ROWS, LEAST_G = 5, 28.0
PREFIXES = (3, 4, 5, 6, 7)
NEAR = 5
THRESHOLD = 0.3

SEED = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns fool "
    "foolish imbecile cretin jerk bastard bitch shit fuck fucking asshole dumbass hate ugly filthy vermin pig swine coward "
    "dumm dummkopf trottel arschloch scheisse abschaum connard salaud merde abruti idiote tonto estupido mierda basura".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre ti usted ustedes tus su".split())
LEET = str.maketrans("01345789@$!+|", "oieastbgasiti")
CAPITALS = bytes(range(65, 91))
MARKS = b"!?.,;:'\"()-"
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
EDGES = "!?.,;:'\"()-#$%&*+/<=>@[\\]^_`{|}~"
NAMES = ("seed", "learned", "weight", "strongest", "spelled", "near", "second", "shouted", "obfuscated", "capitals", "marks", "cries", "symbols", "repeats", "words", "any")


def tokens(word: str) -> list[str]:
    """What the learned lexicon may hold of a plain word: itself, and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


class Kinds:
    """What single words say, remembered by word."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((0, 6))
        self.seen: dict[bytes, int] = {}

    def look(self, raw: bytes) -> tuple:
        word = raw.decode()
        plain = word.lower().strip(EDGES)
        weight = max((self.lexicon.get(t, 0.0) for t in tokens(plain)), default=0.0) if plain else 0.0
        bare = "".join(c for c in plain.translate(LEET) if c.isalpha())
        spelled = bare != plain and (bare in SEED or f"={bare}" in self.lexicon)
        odd = any(not c.isalpha() for c in plain) and any(c.isalpha() for c in plain)
        letters = [c for c in word if c.isalpha()]
        return (float(plain in SEED), weight, float(spelled), float(plain in SECOND), float(len(letters) > 1 and all(c.isupper() for c in letters)), float(odd))

    def learn(self, words: set[bytes]) -> None:
        if len(self.seen) + len(words) > 1 << 20:
            self.seen.clear()
        for raw in words:
            if raw not in self.seen:
                got = self.look(raw)
                self.seen[raw] = self.rows.setdefault(got, len(self.rows))
        if len(self.rows) > len(self.table):
            self.table = np.array(list(self.rows))

    def features(self, texts: list[bytes]) -> np.ndarray:
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        out = np.zeros((len(texts), len(NAMES)))
        for k, (text, words) in enumerate(zip(texts, split, strict=True)):
            n, size = len(words), len(text)
            if not n:
                continue
            ids = np.fromiter(map(self.seen.__getitem__, words), np.int64, n)
            said = self.table[ids]
            sums = said.sum(axis=0) / n
            hit = (said[:, 0] > 0) | (said[:, 1] > 0) | (said[:, 2] > 0)
            near = 0
            if hit.any() and said[:, 3].any():
                you, at = np.flatnonzero(said[:, 3]), np.flatnonzero(hit)
                after = np.searchsorted(you, at)
                left = at - you[np.maximum(after - 1, 0)]
                right = you[np.minimum(after, len(you) - 1)] - at
                near = int(((np.abs(left) <= NEAR) | (np.abs(right) <= NEAR)).sum())
            rate = lambda letters: (size - len(text.translate(None, letters))) / size
            out[k] = (
                sums[0], float((said[:, 1] > 0).mean()), sums[1], said[:, 1].max(), sums[2], near / n, sums[3], sums[4], sums[5],
                rate(CAPITALS), rate(MARKS), rate(b"!"), rate(SYMBOLS), float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, np.log1p(n), np.log1p(int(hit.sum())),
            )
        return out


def held_out(key: str = "doc_id"):
    """Rows that no label is learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def with_features(docs: DataFrame, text: str, lexicon: dict[str, float], to: str) -> DataFrame:
    """``docs`` with an array of features in column ``to``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # LEXICON entries at most
    mark = uuid.uuid4().hex
    fields = [*docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{to}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = common.held(mark, lambda: Kinds(shared.value))
        for batch in common.text_slices(batches, text, 2 << 20):
            got = kinds.features(common.text_bytes(batch, text))
            column = pa.FixedSizeListArray.from_arrays(pa.array(got.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """The sample of labelled rows, written: id, text, label, and part (0 to 2) by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("id")).agg(F.max(F.when(F.col(label) > 0, 1.0).otherwise(0.0)).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    both = rows.join(F.broadcast(chosen), "id")  # `sample` rows of two numbers
    return common.materialize(both.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3))), "labelled")


def learn_lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Tokens that tell toxic rows apart, with their log odds."""

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]
        for batch in common.text_slices(batches, "text", 2 << 20):
            for label, data in zip(batch.column("label").to_pylist(), common.text_bytes(batch, "text"), strict=True):
                plain = {w.lower().strip(EDGES) for w in data.decode().split()}
                counts[label > 0].update({t for w in plain for t in tokens(w)})
        names = [t for t in counts[1]]
        yield pa.RecordBatch.from_pydict({"token": pa.array(names, pa.string()), "bad": pa.array([counts[1][t] for t in names], pa.int64()), "good": pa.array([counts[0][t] for t in names], pa.int64())})
        # Even a count of one: other tasks may have the token in toxic rows.
        rest = [t for t in counts[0] if t not in counts[1]]
        yield pa.RecordBatch.from_pydict({"token": pa.array(rest, pa.string()), "bad": pa.array([0] * len(rest), pa.int64()), "good": pa.array([counts[0][t] for t in rest], pa.int64())})

    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad_rows, good_rows = total.get(1.0, 0), total.get(0.0, 0)
    if not bad_rows or not good_rows:
        return {}
    sums = rows.select("text", "label").mapInArrow(offer, "token string, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = bad_rows / (bad_rows + good_rows)
    n = F.col("bad") + F.col("good")
    term = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / (bad_rows + 1)) - F.log((F.col("good") + 0.5) / (good_rows + 1))
    scored = sums.where(F.col("bad") >= LEAST_ROWS).select("token", odds.alias("odds"), (2 * (term(F.col("bad"), share) + term(F.col("good"), 1 - share))).alias("g"))
    top = scored.where((F.col("g") >= LEAST_G) & (F.col("odds") >= 2.5)).orderBy(F.desc("g"), "token").limit(most)
    return {r["token"]: float(r["odds"]) for r in top.collect()}


class Model:
    """A fitted scorer of texts."""

    def __init__(self, lexicon: dict[str, float], trees, levels, share: float):
        self.lexicon, self.trees, self.levels, self.share = lexicon, trees, levels, share

    def score(self, docs: DataFrame, text: str = "text", to: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1 in column ``to``."""
        if self.trees is None:
            return docs.withColumn(to, F.lit(self.share))
        names = {n: f"_{n}_{uuid.uuid4().hex}" for n in ("array", "features", "raw", "probability", "prediction", "chance", "level")}
        rows = with_features(docs, text, self.lexicon, names["array"]).withColumn(names["features"], array_to_vector(names["array"])).drop(names["array"])
        trees = self.trees.copy().setFeaturesCol(names["features"]).setRawPredictionCol(names["raw"]).setProbabilityCol(names["probability"]).setPredictionCol(names["prediction"])
        rows = trees.transform(rows).withColumn(names["chance"], vector_to_array(names["probability"])[1])
        levels = self.levels.copy().setFeaturesCol(names["chance"]).setPredictionCol(names["level"])
        rows = levels.transform(rows)
        return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(names["level"]))).alias(to))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows of ``docs``."""
    rows = labelled(docs, labels, key, text, label, sample)
    counts = {(r["label"], r["fit"]): r["n"] for r in rows.groupBy("label", (F.col("part") > 0).alias("fit")).agg(F.count("*").alias("n")).collect()}
    bad = sum(n for (y, _), n in counts.items() if y)
    share = bad / max(1, sum(counts.values()))
    if not counts.get((1.0, True)) or not counts.get((0.0, True)):
        return Model({}, None, None, share)
    lexicon = learn_lexicon(rows)
    data = with_features(rows, "text", lexicon, "array").select("part", "label", array_to_vector("array").alias("features"))
    data = common.materialize(data.withColumn("features", vector_to_array("features")), "features").withColumn("features", array_to_vector("features")).coalesce(4)
    trees = GBTClassifier(labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=5, maxBins=64, cacheNodeIds=False, seed=7).fit(data.where("part > 0"))
    calibration = data.where("part = 0") if counts.get((1.0, False)) and counts.get((0.0, False)) else data
    chance = trees.transform(calibration).select("label", vector_to_array("probability")[1].alias("chance"))
    levels = IsotonicRegression(labelCol="label", featuresCol="chance").fit(chance)
    return Model(lexicon, trees, levels, share)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
