"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are relative frequencies of byte trigrams of the lower-cased text, hashed into DIM places, so a linear model is a mean of
weights over a text's trigrams: whole texts are scored in one pass of bounded memory. Families are told apart by one-versus-rest
machines, languages of a family by a machine for each pair of them, which vote.

The machines are fitted on the driver to a sample of at most SAMPLE texts, dealt evenly to the LANGS most frequent languages and
chosen by a hash of doc_id from rows with a language whose crc32(doc_id as text) mod 4 isn't 2. Only their feature vectors, of
fixed length, get there. Both bounds hold for learning alone: every text is predicted.

Defined results: `und` with score 0 for a null text, a text without a letter, or when there is nothing to learn from; a lang that
FAMILIES doesn't name is a family of its own. score is the share of certainty in family and votes, 0 to 1. On ties the first
language in alphabetical order wins; repeated rows get the same result each. Columns named lang_pred or score are replaced, others
are kept whatever their names. `keep_known` rejects a text that is `und` or scores below LEAST, which is what chance gives between
two families of two languages; without anything to learn from it rejects texts without a letter only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import documents, raw, runs, small, table

DIM = 1 << 12
#: Texts that the machines are fitted to, of all languages together.
SAMPLE = 1200
#: Languages that are learned at most.
LANGS = 200
#: Score below which `keep_known` takes a language for not told.
LEAST = 0.25
HELD_OUT = 2
PIECE = 1 << 21
#: Languages of a family, by their ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af yi lb",
    "romance": "fr es it pt ro ca gl oc la co",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn mr ne gu pa ur si",
    "austronesian": "id ms tl jv mg",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def places(data: np.ndarray) -> np.ndarray:
    """The place of the trigram that starts at each byte but the last two."""
    b = data.astype(np.uint32)
    return (((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - DIM.bit_length() + 1)


def histogram(data: np.ndarray) -> np.ndarray:
    out = np.zeros(DIM)
    for at in range(0, max(len(data) - 2, 0), PIECE):
        out += np.bincount(places(data[at : at + PIECE + 2]), minlength=DIM)
    return out / max(out.sum(), 1)


def means(data: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text in data (two bytes at least) and each row of weights, the mean weight of its trigrams."""
    n = np.maximum(np.diff(ends) - 2, 1)
    if len(n) == 1 and len(data) > PIECE:
        sums = sum(weights[:, places(data[at : at + PIECE + 2])].sum(axis=1) for at in range(0, len(data) - 2, PIECE))
        return (sums / n)[:, None]
    where = np.append(places(data), np.zeros(3, np.uint32))
    bounds = np.stack([ends[:-1], ends[1:] - 2], axis=1).ravel()
    return np.stack([np.add.reduceat(w[where], bounds)[::2] for w in weights]) / n


class Machine:
    """A linear support vector machine, fitted by dual coordinate descent."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 60):
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        norm, alpha, w = np.einsum("ij,ij->i", x, x), np.zeros(len(x)), np.zeros(x.shape[1])
        bound = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y < 0).sum(), 1)))
        rng = np.random.default_rng(7)
        for _ in range(rounds):
            moved = 0.0
            for i in rng.permutation(len(x)):
                new = min(max(alpha[i] + (1 - y[i] * (w @ x[i])) / norm[i], 0.0), bound[i])
                if new != alpha[i]:
                    w += (new - alpha[i]) * y[i] * x[i]
                    moved = max(moved, abs(new - alpha[i]))
                    alpha[i] = new
            if moved < 1e-3:
                break
        self.w, self.b = w[:-1], w[-1]


class Model:
    """Machines of families and of pairs of languages; predict() is given weights' means."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        lang = np.array(langs, dtype=object)
        family = np.array([FAMILY_OF.get(v, v) for v in langs], dtype=object)
        self.families = sorted(set(family))
        self.members = [[i for i, v in enumerate(self.langs) if FAMILY_OF.get(v, v) == f] for f in self.families]
        scale = 8 / np.sqrt(x.mean(axis=0) + 1 / DIM) if len(x) else np.ones(DIM)
        x = (x * scale).astype(np.float32)
        made = []
        self.rest, self.pairs = [], {}
        for f in self.families if len(self.families) > 1 else []:
            self.rest.append(len(made))
            made.append(Machine(x, np.where(family == f, 1.0, -1.0)))
        for inside in self.members:
            for i, j in combinations(inside, 2):
                own = (lang == self.langs[i]) | (lang == self.langs[j])
                self.pairs[i, j] = len(made)
                made.append(Machine(x[own], np.where(lang[own] == self.langs[i], 1.0, -1.0)))
        self.weights = np.array([m.w * scale for m in made]).reshape(-1, DIM)
        self.bias = np.array([m.b for m in made])

    def predict(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and the score of each text."""
        n = mean.shape[1]
        margin = mean + self.bias[:, None]
        if len(self.families) > 1:
            e = np.exp(2 * np.clip(margin[self.rest], -20, 20))
            certain = e / e.sum(axis=0)
            family, score = certain.argmax(axis=0), certain.max(axis=0)
        else:
            family, score = np.zeros(n, int), np.ones(n)
        out = np.zeros(n, int)
        for f, inside in enumerate(self.members):
            at = np.flatnonzero(family == f)
            votes, sure = np.zeros((len(inside), len(at))), np.zeros((len(inside), len(at)))
            for (a, i), (b, j) in combinations(enumerate(inside), 2):
                p = 1 / (1 + np.exp(-2 * np.clip(margin[self.pairs[i, j], at], -20, 20)))
                votes[a] += p > 0.5
                votes[b] += p <= 0.5
                sure[a] += p
                sure[b] += 1 - p
            best = (votes + sure / (len(inside) + 1)).argmax(axis=0)
            out[at] = np.array(inside)[best]
            if len(inside) > 1:
                score[at] *= sure[best, np.arange(len(at))] / (len(inside) - 1)
        return out, np.clip(score, 0, 1)


def _body(df: DataFrame) -> DataFrame:
    return df.withColumn("_body", F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" ")).cast("binary"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 4 == HELD_OUT


def fit(df: DataFrame, sample: int = SAMPLE, langs: int = LANGS) -> Model:
    """The machines for df(doc_id, text, lang)."""
    learn = df.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(langs).collect()
    if not counts:
        return Model(np.zeros((0, DIM), np.float32), [])
    each = sample / len(counts)
    shares = df.sparkSession.createDataFrame([(r.lang, int(min(1.0, each / r.n) * (1 << 30))) for r in counts], "lang string, share long")  # langs rows at most
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30))
    chosen = learn.join(F.broadcast(shares), "lang").where(drawn < F.col("share")).select("lang", "text").limit(2 * sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [histogram(np.frombuffer(v.as_py(), np.uint8)).astype(np.float32).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["lang", "x"])

    rows = _body(chosen).select("lang", "_body").mapInArrow(vectors, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    return Model(np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float32).reshape(-1, DIM), [r.lang for r in rows])


def predict(df: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns to carry (all of df's but text by default) with lang_pred and score; no row moves to another task."""
    columns = [c for c in (df.columns if carry is None else carry) if c not in ("text", "lang_pred", "score")]
    rows = _body(df).withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(*columns, "_body", "_letter")
    schema = T.StructType([*df.select(columns).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            for part in runs(batch, "_body"):
                data, ends = raw(part.column(len(columns)))
                letter = np.asarray(part.column(len(columns) + 1).to_pylist(), bool)
                if model.langs:
                    best, score = model.predict(means(data, ends, model.weights) if len(model.weights) else np.zeros((0, len(letter))))
                else:
                    best, score = np.zeros(len(letter), int), np.zeros(len(letter))
                best, score = np.where(letter, best, len(names) - 1), np.where(letter, score, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(names[best], pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    return rows.mapInArrow(told, schema)


def keep_known(df: DataFrame, least: float = LEAST) -> DataFrame:
    """df without rows whose language can't be told; all columns kept. Texts stay in the JVM, only rejected keys are joined."""
    model = fit(df)
    if not model.langs:
        return df.where(F.col("text").rlike(r"\p{L}"))
    told = predict(df.select("doc_id", "text", F.xxhash64("text").alias("_h")), model)
    gone = table(told.where((F.col("lang_pred") == "und") | (F.col("score") < least)).select(F.col("doc_id").alias("i"), F.col("_h").alias("h")).distinct())
    mark = small(gone, gone.count()).alias("g")
    return df.alias("d").join(mark, F.col("d.doc_id").eqNullSafe(F.col("g.i")) & (F.xxhash64("d.text") == F.col("g.h")), "left_anti")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op8_language_id": op8_language_id}
