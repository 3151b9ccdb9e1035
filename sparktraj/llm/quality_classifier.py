"""Quality classifier by positive-unlabelled learning.

A linear model over shape features of the text is trained on trusted positives and unlabelled texts by minimising the
non-negative unbiased risk: pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]) with the logistic loss.  The class prior pi is estimated
from positives and unlabelled texts alone, by the best bin: of all thresholds on a score that tells the two apart, on rows that it wasn't
trained on, the least upper bound of the ratio of the share of unlabelled texts above it to that of positives.  Negative labels are not used.

The unlabelled texts are drawn from all training rows, whatever their label.  ``fit`` takes at most ``most_positive`` positives and
``most_unlabelled`` unlabelled texts, those of least id hash; all texts are scored.

Defined results: a null text is empty; ids, null or repeated, are carried through; a text with contradictory labels is no positive;
without positives every score is 0.5; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj.llm.common import arrow_map, crc_fold, docs_of, id_type, read, slices

#: Characters that are worked on at a time.
PIECE = 1_000_000
#: Kinds of characters: fixed sets, then letters by case, digits, white space and the rest.
KINDS = (" ", "\n", ".", ",;:", "!", "?", "|", "#", "*", "$", "%", "&<>", "-_", "()[]{}", "'\"")
N_KINDS = len(KINDS) + 5
N_PLAIN = 9


@functools.cache
def _kinds() -> np.ndarray:
    out = np.full(0x110000, len(KINDS) + 4, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = len(KINDS) + c.isupper()
        elif c.isdigit():
            out[cp] = len(KINDS) + 2
        elif c.isspace():
            out[cp] = len(KINDS) + 3
    for k, chars in enumerate(KINDS):
        for c in chars:
            out[ord(c)] = k
    out[0x3000:0xD800] = len(KINDS)
    return out


def _repeats(lists: pa.ListArray, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Per list: number of n-grams of its strings, and how many of them are distinct."""
    at = lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    code = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.uint64)
    gram = np.zeros(max(0, len(code) - n + 1), np.uint64)
    for k in range(n):
        gram = (gram ^ code[k : k + len(gram)]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    count = np.maximum(0, np.diff(at) - n + 1)
    first = np.repeat(at[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    doc, gram = np.repeat(np.arange(len(count)), count), gram[first]
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return count, np.bincount(doc[new], minlength=len(count))


def features(texts: pa.Array) -> np.ndarray:
    """Plain ratios, and the square roots of the shares of pairs of neighbouring kinds of characters."""
    words, lines = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts)), pc.split_pattern(texts, "\n")
    listed = texts.to_pylist()
    size = np.array([len(t) for t in listed])
    pairs, single = np.zeros((len(listed), N_KINDS**2), np.int64), np.zeros((len(listed), N_KINDS), np.int64)
    ends, whole = np.cumsum(size), "".join(listed)
    del listed
    for at in range(0, len(whole), PIECE):
        # One character more, so that no pair is lost between pieces.
        kind = _kinds()[np.frombuffer(whole[at : at + PIECE + 1].encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
        doc = np.searchsorted(ends, np.arange(at, at + len(kind)), "right")
        lo, hi = int(doc[0]), int(doc[-1]) + 1
        inside = doc[1:] == doc[:-1]
        pairs[lo:hi] += np.bincount(((doc[1:] - lo) * N_KINDS**2 + kind[:-1] * N_KINDS + kind[1:])[inside], minlength=(hi - lo) * N_KINDS**2).reshape(hi - lo, -1)
        single[lo:hi] += np.bincount(((doc - lo) * N_KINDS + kind)[:PIECE], minlength=(hi - lo) * N_KINDS).reshape(hi - lo, -1)
    n_words, distinct = _repeats(words)
    n_lines, distinct_lines = _repeats(lines)
    n_grams, distinct_grams = _repeats(words, 3)
    share = lambda a, b: a / np.maximum(b, 1)
    plain = [np.log1p(n_words), np.log1p(size), share(size, n_words) / 10, share(distinct, n_words), 1 - share(distinct_grams, n_grams), (n_grams - distinct_grams > 0.2 * n_grams), 1 - share(distinct_lines, n_lines), np.log1p(share(n_words, n_lines)), n_words < 50]
    shares = np.sqrt(np.concatenate([share(single, size[:, None]), share(pairs, size[:, None] - 1)], axis=1))
    return np.concatenate([np.stack(plain, axis=1).astype(np.float32), shares.astype(np.float32)], axis=1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, apart: bool = False) -> Model:
    """Full-batch Adam; ``apart``: unlabelled texts count as negatives.  Where the estimated risk on negatives is below 0, the step goes up that part alone, as the method has it."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale = np.where(scale > 1e-4, scale, 1.0)
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    w, m, v = (np.zeros(p.shape[1] + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        negative = 1.0 if apart else np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Slopes of the losses in z: l(z) has sigmoid(z) - 1, l(-z) has sigmoid(z).
        gp, gu = -prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)
        if apart:
            gp, gu = prior * (sigmoid(zp) - 1) / len(p), (1 - prior) * gu
        elif negative < 0:
            gp, gu = -gp, -gu
        else:
            gp = gp + prior * (sigmoid(zp) - 1) / len(p)
        g = np.append(gp @ p + gu @ u + decay * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / steps * 0.9) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(w[:-1].astype(np.float32), float(w[-1]), mean, scale)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among unlabelled texts, from scores of both (best bin estimation)."""
    at = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), at, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at, "left") / len(unlabelled)
    bound = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + bound) / p)
    return float(min(0.99, max(0.01, u[best] / p[best])))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The prior, from a classifier of one half of the rows against the other half, and the model with it."""
    p, u = (np.random.default_rng(3).permutation(len(x)) % 2 == 0 for x in (positive, unlabelled))
    scored: list[list[np.ndarray]] = [[], []]
    if min(p.sum(), (~p).sum(), u.sum(), (~u).sum()) > 0:
        for a, b in ((p, u), (~p, ~u)):
            # With no positives taken off the unlabelled risk, this tells the two samples apart.
            apart = fit_nnpu(positive[a], unlabelled[b], 0.5, apart=True)
            scored[0].append(apart.score(positive[~a]))
            scored[1].append(apart.score(unlabelled[~b]))
        prior = prior_of(*map(np.concatenate, scored))
    else:
        prior = 0.5
    return fit_nnpu(positive, unlabelled, prior)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_positive: int = 10_000, most_unlabelled: int = 20_000) -> Model:
    """``docs`` and ``labels`` are the training rows.  Ids are chosen first and broadcast (``most_positive + most_unlabelled`` at most); texts don't move."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("a"))
    d = docs_of(docs, id_col, text_col)
    first = lambda x, most: x.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    positive = first(marks.where("a = 1").select("doc_id"), most_positive).withColumn("p", F.lit(True))
    unlabelled = first(d.where("doc_id IS NOT NULL").select("doc_id").distinct(), most_unlabelled).withColumn("u", F.lit(True))
    ids = positive.join(unlabelled, "doc_id", "full").select("doc_id", F.coalesce("p", F.lit(False)).alias("p"), F.coalesce("u", F.lit(False)).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch([b.column("doc_id"), b.column("p"), b.column("u"), pa.array([x.tobytes() for x in features(b.column("text")).astype("<f4")], pa.binary())], names=["doc_id", "p", "u", "x"])

    # One row an id, of repeated ones that of the least features: what comes to the driver is bounded by the number of ids.
    table = arrow_map(d.join(F.broadcast(ids), "doc_id").select("doc_id", "p", "u", "text"), run, f"doc_id {id_type(docs, id_col)}, p boolean, u boolean, x binary")
    table = table.groupBy("doc_id").agg(F.first("p").alias("p"), F.first("u").alias("u"), F.min("x").alias("x")).select("p", "u", "x").toArrow()
    width = N_PLAIN + N_KINDS + N_KINDS**2
    x = np.frombuffer(b"".join(table["x"].to_pylist()), "<f4").reshape(-1, width)
    p, u = (table[k].to_numpy() for k in "pu")
    # A fixed order: sums in floating point then don't depend on how tasks ended.
    order = np.lexsort((*x[:, :4].T, u, p))
    x, p, u = x[order], p[order].astype(bool), u[order].astype(bool)
    if not p.any() or not u.any():
        return Model(np.zeros(width, np.float32), 0.0, np.zeros(width), np.ones(width))
    return fit_pu(x[p], x[u])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.score(features(b.column("text"))).astype(np.float64)
            yield pa.record_batch([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return arrow_map(docs_of(docs, id_col, text_col), run, f"doc_id {id_type(docs, id_col)}, score double, predicted int")


def op10_quality_classifier(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    learn = crc_fold(F.col("doc_id"), 3) != 1
    model = fit(docs.where(learn), labels.where(learn))
    return predict(docs, model).select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES = {}
