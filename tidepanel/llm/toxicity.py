"""Toxicity by weak supervision.

Lexicon voters (words) and pattern voters (word beginnings, and each of them at
least 2, 3 or 5 times in a text), for toxic and for clean, are proposed from a
bounded sample of labelled rows whose ids are not held out.  A generative label
model, a mixture of two classes with a rate of firing for each voter and class,
starts from the voters' majority and estimates their accuracies by expectation
maximisation; the annotation of a row is one more voter, whose accuracy is
estimated like the others'.  Correlations between voters given the class,
estimated from the model's residuals, share out the weight of voters that say
the same.  Its posterior labels train a linear classifier over hashed words and
beginnings, which scores every document in one map pass.  labels, lang, source
and doc_id are never inputs of a score.

Texts are lower-cased; words are runs of ASCII letters, digits and non-ASCII
characters.  Null and empty texts have the score of a text without features.
Without labelled rows of both kinds every score is the share of toxic rows, or
0.  Rows that repeat are scored each, rows without an id too; an empty table
gives no rows; other columns are not read.  A score of exactly 0.5 predicts 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from . import textops as X

U64 = np.uint64
#: labelled rows that are learned from, the first by a hash of their ids
SAMPLE = 12_000
VOTERS = 400
FEATURES = 3000
#: least labelled documents of a feature
SUPPORT = 4
BEGINNINGS = (3, 4, 5, 6, 7, 8)  # in bytes
TIMES = (1, 2, 3, 5)


def held_out(doc_id: str = "doc_id", modulus: int = 5):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == 0


def features(buf: np.ndarray, offs: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct features of each row; ``only``: sorted stems that count."""
    w = X.Words(buf, offs, X.ALNUM)
    if not len(w.hash):
        return np.empty(0, np.int64), np.empty(0, U64)
    unique, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    start, end = w.start[first], w.end[first]
    low = X.lower(buf)
    stems, owner = [unique], [np.arange(len(unique))]
    for k in BEGINNINGS:
        long = np.flatnonzero(end - start > k)
        stems.append(X.span_hash(low, start[long], start[long] + k) ^ U64(0x5555555555555555))
        owner.append(long)
    stem, own = np.concatenate(stems), np.concatenate(owner)
    if only is not None:
        ok = X.lookup(only, stem) >= 0
        stem, own = stem[ok], own[ok]
    order = np.argsort(own, kind="stable")
    stem, own = stem[order], own[order]
    count = np.bincount(own, minlength=len(unique))
    base = np.cumsum(count) - count
    n = count[back]
    row = np.repeat(w.row, n)
    key = stem[X.ranges(base[back], n)]
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, U64)
    order = X.by_row(row, key, w.rows)
    row, key = row[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(key)))
    rows, keys = [], []
    for t in TIMES:
        often = at[times >= t]
        rows.append(row[often])
        keys.append(key[often] + U64(t - 1))
    return np.concatenate(rows), np.concatenate(keys)


def _lowered(col):
    return pc.utf8_lower(pc.fill_null(col, ""))


def _slices(batch, index):
    text = pa.RecordBatch.from_arrays([_lowered(batch.column(index))], names=["t"])
    buf, offs = X.column(text, 0)
    for i, j in X.slices(offs):
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def support(sample: DataFrame) -> DataFrame:
    """(key, toxic, clean): in how many labelled texts of each kind each feature is."""

    def run(batches):
        for b in batches:
            toxic = b.column(1).to_numpy().astype(np.int64)
            for i, j, buf, offs in _slices(b, 0):
                row, key = features(buf, offs)
                u, back = np.unique(key, return_inverse=True)
                bad = np.bincount(back, weights=toxic[i:j][row].astype(float), minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(bad), pa.array(np.bincount(back, minlength=len(u)) - bad)], names=["key", "toxic", "clean"])

    rows = sample.select("text", "toxic").mapInArrow(X.tidy(run), "key bigint, toxic bigint, clean bigint")
    return rows.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def matrix(sample: DataFrame, keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per sampled document the numbers of its chosen features; and the labels."""
    shared = sample.sparkSession.sparkContext.broadcast((keys, stems_of(keys)))

    def run(batches):
        keys, only = shared.value
        for b in batches:
            for i, j, buf, offs in _slices(b, 0):
                row, key = features(buf, offs, only)
                at = X.lookup(keys, key)
                row, at = row[at >= 0], at[at >= 0]
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at[order])), b.column(1).slice(i, j - i)], names=["at", "toxic"])

    t = sample.select("text", "toxic").repartition(1 + runtime.shuffle_partitions(sample.sparkSession) // 4).mapInArrow(X.tidy(run), "at array<bigint>, toxic int").toArrow()
    return [np.asarray(x.values.to_numpy()) for x in t.column("at")] if t.num_rows else [], t.column("toxic").to_numpy()


def stems_of(keys: np.ndarray) -> np.ndarray:
    """Every stem that a feature key may stand for."""
    return np.unique(np.concatenate([keys - U64(t - 1) for t in TIMES])) if len(keys) else keys


class LabelModel:
    """Two-class mixture over one-sided voters: accuracies by EM, correlated voters share their weight.

    A voter that does not fire abstains; that none fires is an event of its own.
    """

    def fit(self, fires: np.ndarray, sign: np.ndarray, prior: float, annotation: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
        """Posterior of class 1 of each row.

        fires: 0/1, a column a voter; sign: 1 or -1, the class that a voter speaks
        for, which only the start uses; annotation: 0/1, one more voter.
        """
        v = fires.astype(np.float64)
        said = v @ sign
        start = said / (1 + v.sum(axis=1))
        post = 1 / (1 + np.exp(-(4 * start + np.log(prior / (1 - prior)))))
        events = np.column_stack([v, v.sum(axis=1) == 0])
        for _ in range(rounds):
            weight = np.stack([1 - post, post])
            mass = weight.sum(axis=1)
            self.rate = ((weight @ events + 0.05) / (mass[:, None] + 0.1)).clip(1e-5, 1 - 1e-5)
            # residual correlations of voters within the classes
            r = v - np.outer(1 - post, self.rate[0, :-1]) - np.outer(post, self.rate[1, :-1])
            sd = np.sqrt((r * r).mean(axis=0)) + 1e-9
            self.correlation = (r.T @ r) / len(v) / np.outer(sd, sd)
            self.weight = np.append(1 / np.clip(self.correlation, 0, 1).sum(axis=1), 1.0)
            z = np.log(prior / (1 - prior)) + events @ (np.log(self.rate[1] / self.rate[0]) * self.weight)
            if annotation is not None:
                self.annotator = ((weight @ annotation + 0.5) / (mass + 1)).clip(0.02, 0.98)  # P(marked) by class
                z += np.where(annotation == 1, np.log(self.annotator[1] / self.annotator[0]), np.log((1 - self.annotator[1]) / (1 - self.annotator[0])))
            post = 1 / (1 + np.exp(-z.clip(-30, 30)))
        #: how often a voter that fires speaks for the right class
        spoken = np.where(sign > 0, self.rate[1, :-1] * mass[1], self.rate[0, :-1] * mass[0])
        self.accuracy = spoken / np.maximum(self.rate[0, :-1] * mass[0] + self.rate[1, :-1] * mass[1], 1e-9)
        return post


def logistic(rows: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 600, penalty: float = 5e-5, step: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept of a regularised logistic regression on soft labels (Adam, whole batch)."""
    n = len(rows)
    length = np.array([len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if length.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(n), length)
    w, b = np.zeros(size), float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    m, s, mb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col], minlength=n) + b
        g = (1 / (1 + np.exp(-z.clip(-30, 30))) - target) / n
        gw, gb = np.bincount(col, weights=g[row], minlength=size) + penalty * w, g.sum()
        m, s = 0.9 * m + 0.1 * gw, 0.999 * s + 0.001 * gw * gw
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.999**t
        w -= step * (m / c) / (np.sqrt(s / d) + 1e-8)
        b -= step * (mb / c) / (np.sqrt(sb / d) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature keys, weights, intercept)."""
    before = runtime.mark()
    rows = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked, _ = runtime.written(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    texts, _ = runtime.written(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic").repartition(runtime.shuffle_partitions(docs.sparkSession)), "labelled_texts")
    counts = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    if not (bad and good):
        return np.empty(0, U64), np.empty(0), -30.0 if not bad else 30.0
    # evidence of a feature: its log odds at the lower end of a 95 % interval
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = support(texts).filter(F.col("toxic") + F.col("clean") >= SUPPORT).withColumn("evidence", F.abs(odds) - 2.0 * spread).withColumn("odds", odds)
    best = found.filter("evidence > 0").orderBy(F.desc("evidence"), "key").limit(FEATURES).toArrow()
    keys, evidence, odds_ = best.column("key").to_numpy().view(U64), best.column("evidence").to_numpy(), best.column("odds").to_numpy()
    order = np.argsort(keys)
    keys, evidence, odds_ = keys[order], evidence[order], odds_[order]
    features_, label = matrix(texts, keys)
    runtime.drop_since(docs.sparkSession, before)
    voters = np.concatenate([own[np.argsort(-evidence[own], kind="stable")][:VOTERS // 2] for own in (np.flatnonzero(odds_ > 0), np.flatnonzero(odds_ < 0))])
    number = np.full(len(keys), -1)
    number[voters] = np.arange(len(voters))
    fires = np.zeros((len(label), max(1, len(voters))), np.int8)
    for i, f in enumerate(features_):
        v = number[f]
        fires[i, v[v >= 0]] = 1
    sign = np.sign(odds_[voters]) if len(voters) else np.ones(1)
    posterior = LabelModel().fit(fires, sign, bad / (bad + good), label)
    w, b = logistic(features_, posterior, len(keys))
    return keys, w, b


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    keys, w, b = model
    shared = docs.sparkSession.sparkContext.broadcast((keys, w, b, stems_of(keys)))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        keys, w, bias, only = shared.value
        for b in batches:
            for i, j, buf, offs in _slices(b, 1):
                z = np.full(j - i, bias)
                if len(keys):
                    row, key = features(buf, offs, only)
                    at = X.lookup(keys, key)
                    ok = at >= 0
                    z += np.bincount(row[ok], weights=w[at[ok]], minlength=j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-z.clip(-30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(X.tidy(run), f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, train(docs, labels, **options))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
