"""Language identification: averaged hashed subword embeddings and a linear softmax.

Letters are lower-cased, all else is a space; every run of three or four bytes
without a space inside is hashed to a row of an embedding table. A text's
vector is the mean of its rows; a linear layer and a softmax give languages.
Table and layer are trained together by stochastic gradient descent in numpy on
at most MAX_ROWS rows and MAX_BYTES bytes of whole texts (parameters), drawn
evenly by a hash of doc_id, whole and as short excerpts. Scoring multiplies
table and layer once, so a text is a mean of looked-up rows.

Rejection: a temperature is fitted on rows held back from training. Whole texts
and short excerpts have a threshold each: the score that all but REJECT of the
rightly predicted held-back ones exceed. A text is rejected if its score is
below the threshold of its length (SHORT bytes of letters part the two), or if
it has no letter.

Defined results: a null text or one without a letter is "und" with score 0 and
rejected; rows with null lang or doc_id are not learned from; with nothing to
learn from every text is "und"; repeated rows give repeated result rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import give_back

MAX_ROWS, MAX_BYTES = 4000, 32_000_000
BUCKETS, DIM, EPOCHS, RATE = 1 << 15, 8, 4, 8.0
REJECT, SHORT = 0.005, 200
UNKNOWN = "und"
#: All that is not of the Unicode category of letters.
_OTHER = regex.compile(r"\P{L}+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> bytes:
    """Lower-case letters, one space elsewhere and at both ends; empty if there is no letter."""
    body = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return b" " + body.encode() + b" " if body else b""


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all subwords of normalised bytes, and the position of each."""
    rows, places = [], []
    space = data == 32
    for size in (3, 4):
        n = len(data) - size + 1
        if n <= 0:
            continue
        value = np.full(n, size, np.uint64)
        for k in range(size):
            value = value << np.uint64(8) | data[k : n + k]
        inside = space[1 : n + 1].copy()
        for k in range(2, size - 1):
            inside |= space[k : n + k]
        at = np.flatnonzero(~inside)
        rows.append((value[at] * _GOLD >> np.uint64(64 - 15)).astype(np.int64) & (BUCKETS - 1))
        places.append(at)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(places)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # of each table row
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0  # of whole texts
    short: float = 0.0  # of excerpts
    report: dict = field(default_factory=dict)

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Logits by text; half a MB of bytes at once, or a longer text (some 60 bytes of memory each)."""
        out = np.zeros((len(texts), len(self.langs)))
        held, size, first = [], 0, 0

        def flush(last: int) -> None:
            data = np.frombuffer(b"".join(held), np.uint8)
            rows, places = subwords(data)
            ends = np.cumsum([len(h) for h in held])
            owner = np.searchsorted(ends, places, side="right")
            count = np.maximum(np.bincount(owner, minlength=len(held)), 1)
            for k in range(len(self.langs)):
                out[first:last, k] += np.bincount(owner, weights=self.logits[rows, k], minlength=len(held)) / count

        for i, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size > 1 << 19:
                flush(i + 1)
                held, size, first = [], 0, i + 1
        if held:
            flush(len(texts))
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection by text."""
        data = [normalised(t) for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best, score = top(self.raw(data) / self.temperature)
        known = np.array([len(d) > 0 for d in data], bool)
        score = np.where(known, score, 0.0)
        least = np.array([self.short if len(d) < SHORT else self.threshold for d in data])
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, ~known | (score < least)


def top(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return best, p[np.arange(len(p)), best]


def excerpts(data: bytes, rng: np.random.Generator) -> list[bytes]:
    """The whole text and a short run of its words."""
    words = data.split()
    size = int(rng.integers(3, 12))
    at = int(rng.integers(0, max(len(words) - size, 0) + 1))
    return [data, b" " + b" ".join(words[at : at + size]) + b" "]


def train(rows: list[tuple[str, str]], seed: int = 1) -> Model:
    """rows of (text, lang); a fifth of them calibrates."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    examples = [(subwords(np.frombuffer(x, np.uint8))[0], langs.index(lang), k % 5 == 0, x) for k, (text, lang) in enumerate(rows) if (d := normalised(text)) for x in excerpts(d, rng)]
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 0.3, (DIM, len(langs))), np.zeros(len(langs))
    steps = [(*np.unique(r, return_counts=True), y) for r, y, held, _ in examples if not held and len(r)]
    done, total = 0, max(EPOCHS * len(steps), 1)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(steps)):
            ids, counts, y = steps[i]
            share = counts / counts.sum()
            hidden = share @ table[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = RATE * (1 - done / total) + 1e-3
            back = layer @ p
            layer -= 0.05 * rate * np.outer(hidden, p)
            bias -= 0.01 * rate * p
            table[ids] -= rate * share[:, None] * back
            done += 1
    model = Model(langs, (table @ layer).astype(np.float32), bias)
    held = [(x, y) for _, y, h, x in examples if h]
    if held:
        logits, y = model.raw([x for x, _ in held]), np.array([y for _, y in held])

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

        model.temperature = min(np.geomspace(0.1, 10, 41), key=loss)
        best, score = top(logits / model.temperature)
        brief = np.array([len(x) < SHORT for x, _ in held])
        for name, some in (("threshold", ~brief), ("short", brief)):
            right = score[(best == y) & some]
            setattr(model, name, float(np.quantile(right, REJECT, method="lower")) if len(right) else 0.0)
        model.report = {"held": len(y), "accuracy": float((best == y).mean())}
    return model


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Trains on docs(doc_id, text, lang), already restricted to what may be learned."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text", "lang")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, 0.9 * max_rows / max(n, 1), 0.9 * max_bytes / max(size, 1))
    place = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    chosen = rows.where(place).orderBy(F.xxhash64("id", "text")).limit(max_rows).select("text", "lang").collect()
    return train([(r.text, r.lang) for r in chosen]) if chosen else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (the columns named, whatever their names) and text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("text").cast("string").alias("text"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected added (in place of columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {a.name for a in added}]
    schema = T.StructType([*kept, *added])

    def run(batches):
        for batch in batches:
            lang, score, rejected = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return _packed(docs, [f.name for f in kept]).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs that are not rejected, with docs' own columns, whatever their names."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        for batch in batches:
            rejected = shared.value.predict(batch.column(1).to_pylist())[2]
            yield pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=names).filter(pa.array(~rejected))
        give_back()

    return _packed(docs, names).mapInArrow(run, docs.schema)
