"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting: on at most MAX_ROWS labelled rows (those of least hash of doc_id; the
bound is a parameter), document frequencies of tokens by label give log-odds
with an informative Dirichlet prior; tokens whose log-odds lie Z_LEAST standard
deviations or more from zero keep them as score, all other tokens score -DRIFT.
A part of the rows is held back from the counts to calibrate.

Scoring: a linear scan finds all maximal-scoring segments of a text. By extreme
value theory the best segment of n neutral tokens scores above s with
probability 1 - exp(-K n exp(-lambda s)); lambda solves the moment equation
of the neutral token scores and K is fitted to the best segments of neutral
texts. Segments of small expectation are significant; their evidence is added
and a logistic curve, fitted on the rows held back, maps it to 0..1.

Defined results: null and empty texts have no tokens and get the score of no
evidence; repeated rows give repeated result rows; a null doc_id is never
learned from; without labelled rows of both labels every score is 0; conflicting
labels of one doc_id count as toxic; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learned from, at most, and tokens that are kept, at most.
MAX_ROWS, MAX_TOKENS = 20_000, 50_000
#: Rows of which one is held back for calibration.
HOLD = 4
PRIOR, Z_LEAST, DRIFT, SIGNIFICANT = 500.0, 2.5, 0.25, 0.01
#: Letters, digits and bytes over 0x7F; A-Z lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def log_odds(toxic: np.ndarray, neutral: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds by token and their z values, with a Dirichlet prior of 0.5 each and the rest in proportion to the joint counts."""
    both = toxic + neutral
    alpha = 0.5 + prior * both / both.sum()
    a, b = toxic + alpha, neutral + alpha
    delta = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    return delta, delta / np.sqrt(1 / a + 1 / b)


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence of scored places; any other place costs drift.

    The stack of Ruzzo and Tompa: each entry is a candidate with the total
    before and after it; a new one joins back to the last entry that starts
    lower, if it also ends higher than that one.
    """
    stack: list[list[float]] = []
    total, at = 0.0, 0
    for place, score in scores:
        total -= drift * (place - at)
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        entry = [place, place + 1, before, total]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= entry[2]:
                k -= 1
            if k < 0 or stack[k][3] >= entry[3]:
                break
            entry = [stack[k][0], entry[1], stack[k][2], entry[3]]
            del stack[k:]
        stack.append(entry)
    return [(int(a), int(b), right - left) for a, b, left, right in stack]


def decay(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(w exp(lambda v)) = 1, for scores of negative mean."""
    p = weights / weights.sum()
    if values.max() <= 0 or (p * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(high * values)).sum() < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return high


@dataclass
class Model:
    scores: dict[bytes, float]
    drift: float = DRIFT
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    bias: float = -30.0

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words, get = tokens(text), self.scores.get
        return len(words), maximal_segments([(i, s) for i, w in enumerate(words) if (s := get(w)) is not None], self.drift)

    def expectation(self, n: int, score: float) -> float:
        """Expected number of neutral segments of that score in n tokens, as a logarithm."""
        return self.log_k + math.log(max(n, 1)) - self.lam * score

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float]]]:
        """-log of the best segment's p value, plus what further significant segments add."""
        logs = sorted(self.expectation(n, s) for _, _, s in found)
        if not logs:
            return 0.0, []
        best = -math.log(max(-math.expm1(-math.exp(min(logs[0], 50.0))), 1e-300))
        more = sum(math.log(SIGNIFICANT) - x for x in logs[1:] if x < math.log(SIGNIFICANT))
        passages = [(a, b, s) for a, b, s in found if self.expectation(n, s) < math.log(SIGNIFICANT)]
        return best + more, passages

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(min(self.slope * evidence + self.bias, 700), -700)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias, by Newton's method with a small ridge."""
    scale = max(x.std(), 1e-9)
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learns from labels(doc_id, toxic) and docs(doc_id, text); both are already restricted to what may be learned."""
    spark = docs.sparkSession
    pick = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = pick.orderBy(F.xxhash64("id"), "id").limit(max_rows).collect()
    if len({r.toxic for r in rows}) < 2:
        return Model({})
    chosen = spark.createDataFrame([(r.id, r.toxic, k % HOLD == 0) for k, r in enumerate(rows)], "id long, toxic int, held boolean")
    # max_rows rows of three small columns: the broadcast is bounded by the parameter.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))

    def present(batches):
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in set(tokens(text)):
                    seen.setdefault(w, [0, 0])[label > 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], names=["token", "toxic", "neutral"])

    counts = texts.where("not held").select("text", "toxic").mapInArrow(present, "token binary, toxic long, neutral long")
    counts = counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("neutral").alias("neutral")).where("toxic + neutral > 1")
    table = counts.orderBy(F.desc(F.abs(F.log((F.col("toxic") + 0.5) / (F.col("neutral") + 0.5))) * F.sqrt(F.col("toxic") + F.col("neutral"))), "token").limit(MAX_TOKENS).toPandas()
    if not len(table):
        return Model({})
    delta, z = log_odds(table.toxic.to_numpy(float), table.neutral.to_numpy(float))
    keep = np.abs(z) >= Z_LEAST
    model = Model({bytes(t): float(d) for t, d, k in zip(table.token, np.clip(delta, -8, 8), keep, strict=True) if k})
    shared = spark.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, m = tokens(text), shared.value
                n, found = m.segments(text)
                known = [s for w in words if (s := m.scores.get(w)) is not None]
                out.append((label, n, [s for _, _, s in found], known))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())], strict=True)], names=["toxic", "n", "found", "known"]) if out else batch.slice(0, 0)

    held = texts.where("held").select("text", "toxic").mapInArrow(scored, "toxic int, n long, found array<double>, known array<double>").collect()
    neutral = [r for r in held if not r.toxic and r.n]
    if not neutral or len(neutral) == len(held):
        return model
    known = np.array([s for r in neutral for s in r.known])
    values, weights = np.unique(np.append(np.round(known, 3), -model.drift), return_counts=True)
    weights = weights.astype(float)
    weights[np.searchsorted(values, -model.drift)] += sum(r.n for r in neutral) - len(known)
    model.lam = decay(values, weights)
    tops = [model.lam * max(r.found) - math.log(r.n) for r in neutral if r.found]
    model.log_k = float(np.mean(tops) - 0.5772) if tops else 0.0
    x = np.array([model.evidence(r.n, [(0, 0, s) for s in r.found])[0] for r in held])
    model.slope, model.bias = logistic(x, np.array([float(r.toxic) for r in held]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, score, predicted, n_tokens, passages (start, end in tokens, score) that are significant."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            for text in batch.column(1):
                n, found = model.segments(text.as_py())
                evidence, passages = model.evidence(n, found)
                p = model.probability(evidence)
                for c, v in zip(cols, (p, int(p >= 0.5), n, [{"start": a, "end": b, "score": s} for a, b, s in passages]), strict=True):
                    c.append(v)
            kinds = [pa.float64(), pa.int32(), pa.int64(), passage]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "score", "predicted", "n_tokens", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, n_tokens long, passages array<struct<start:long,end:long,score:double>>"
    )
