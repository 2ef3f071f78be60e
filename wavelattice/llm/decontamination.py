"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are put into one automaton (states, suffix links,
lengths). Each document's words are streamed through it; at every word the
automaton gives the longest run of words, ending there, that occurs in an item.
A run of `window` words or more (or a whole shorter item) marks its words.
Words that no item has, and pairs of words that no item has side by side, break
every run, so only stretches free of such breaks are streamed.

The automaton is broadcast, so its size is bounded: items are taken in blocks
of at most BLOCK_WORDS words (or a single longer item), and the driver and each
Python worker hold one block at a time. Each block is a pass over the documents.
With one block, documents are never shuffled; with more, what each pass found
is written and united by document.

Defined results: a null or empty text has no words and no hits; null item texts
have no windows; rows of one item_id are one item (a null item_id is written
"null"); repeated document rows give repeated result rows; an empty benchmark
hits nothing; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, document_key, few, give_back

#: A-Z to a-z, digits and bytes over 0x7F as they are, all else to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Words of test items in one broadcast automaton (some 100 bytes each).
BLOCK_WORDS = 200_000
_BITS = 22


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over word ids, with the items of every window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.step: dict[tuple[int, int], int] = {}
        self.link, self.length, out = [-1], [0], [[]]
        sequences = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items if ws]
        for _, seq in sequences:
            last = 0
            for token in seq:
                last = self._extend(last, token, out)
        n = len(self.link)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.at = [0] * n  # the state of the last `window` words of a longer match
        for v in order:
            up = self.link[v]
            self.at[v] = self.at[up] if self.length[up] >= window else v
        owners: dict[int, set[str]] = {}  # by state of a window: one entry a word of the items at most
        whole: dict[int, set[tuple[int, str]]] = {}
        for name, seq in sequences:
            state = 0
            for pos, token in enumerate(seq, 1):
                state = self.step[state, token]
                if pos >= window:
                    owners.setdefault(self.at[state], set()).add(name)
            if len(seq) < window:
                whole.setdefault(state, set()).add((len(seq), name))
        self.short: dict[int, list[tuple[int, str]]] = {}
        for v in order:
            if mine := sorted(whole.get(v, set()) | set(self.short.get(self.link[v], ()))):
                self.short[v] = mine
        self.owners = {v: tuple(x) for v, x in owners.items()}
        self.least = min((min(len(s), window) for _, s in sequences), default=window)
        pairs = np.zeros(1 << _BITS, bool)
        for _, seq in sequences:
            if len(seq) > 1:
                pairs[self._slot(np.array(seq[:-1]), np.array(seq[1:]))] = True
        self.pairs = np.packbits(pairs)

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _BITS)

    def _extend(self, last: int, token: int, out: list[list[int]]) -> int:
        step, link, length = self.step, self.link, self.length

        def split(p: int, q: int) -> int:
            clone = len(link)
            link.append(link[q])
            length.append(length[p] + 1)
            out.append(list(out[q]))
            for t in out[q]:
                step[clone, t] = step[q, t]
            link[q] = clone
            while p >= 0 and step.get((p, token)) == q:
                step[p, token] = clone
                p = link[p]
            return clone

        q = step.get((last, token))
        if q is not None:
            return q if length[q] == length[last] + 1 else split(last, q)
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        out.append([])
        p = last
        while p >= 0 and (p, token) not in step:
            step[p, token] = new
            out[p].append(token)
            p = link[p]
        if p >= 0:
            q = step[p, token]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def stretches(self, ids: np.ndarray):
        """(start, end) of runs of known words whose neighbours may stand side by side in an item."""
        known = ids >= 0
        if not known.any():
            return []
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        slot = self._slot(ids[at], ids[at + 1]).astype(np.int64)
        joined[at] = (self.pairs[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
        starts = known & ~np.concatenate([[False], joined])
        ends = known & ~np.concatenate([joined, [False]])
        a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return zip(a[wide := b - a >= self.least].tolist(), b[wide].tolist(), strict=True)

    def scan(self, tokens: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [start, end) runs of hit words, and the items that hit."""
        get, step, link, length = self.ids.get, self.step, self.link, self.length
        ids = np.array([get(w, -1) for w in tokens], np.int64)
        runs: list[list[int]] = []
        found: set[str] = set()

        def mark(a: int, b: int) -> None:
            while runs and runs[-1][1] >= a:
                a = min(a, runs.pop()[0])
            runs.append([a, b])

        for a, b in self.stretches(ids):
            state = size = 0
            for pos, token in enumerate(ids[a:b].tolist(), a):
                while state and (state, token) not in step:
                    state = link[state]
                    size = length[state]
                state = step.get((state, token), 0)
                size = size + 1 if state else 0
                if size >= self.window:
                    mark(pos + 1 - self.window, pos + 1)
                    found.update(self.owners[self.at[state]])
                for n, name in self.short.get(state, ()):
                    if n <= size:
                        mark(pos + 1 - n, pos + 1)
                        found.add(name)
        return runs, found


def blocks_of(benchmark: DataFrame, block_words: int):
    """Lists of items (name, words), a block at a time. The items go through the driver, one partition after another."""
    items: list[tuple[str, list[bytes]]] = []
    n = 0
    for name, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator():
        if ws := words(text):
            if items and n + len(ws) > block_words:
                yield items
                items, n = [], 0
            items.append((name, ws))
            n += len(ws)
    yield items


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _spans(runs: list[list[list[int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], pa.list_(_SPAN))


def _hit_only(batch: pa.RecordBatch, counts: list[int], runs: list, items: list) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([batch.column("k0"), batch.column("k1"), _spans(runs), pa.array(items, pa.list_(pa.string()))], names=["k0", "k1", "spans", "items"])
    return out.filter(pa.array([bool(r) for r in runs], pa.bool_()))


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, finish, schema) -> DataFrame:
    """finish, made into a frame of `schema`: from a batch of docs (k0, k1, text and others) and, by row, words, hit runs and items."""
    spark, where = docs.sparkSession, docs.columns.index("text")

    def scanned(items, finish, schema) -> DataFrame:
        block = spark.sparkContext.broadcast(Automaton(items, window))

        def run(batches):
            for batch in batches:
                counts, runs, found = [], [], []
                for text in batch.column(where):
                    tokens = words(text.as_py())
                    hit, names = block.value.scan(tokens)
                    counts.append(len(tokens))
                    runs.append(hit)
                    found.append(sorted(names))
                yield finish(batch, counts, runs, found)
            give_back()

        return docs.mapInArrow(run, schema)

    rest = blocks_of(benchmark, block_words)
    first, second = next(rest), next(rest, None)
    if second is None:
        return scanned(first, finish, schema)
    scratch, found = Scratch(spark), []
    for k, items in enumerate(itertools.chain([first, second], rest)):
        found.append(scratch.store(scanned(items, _hit_only, "k0 long, k1 long, spans array<struct<start:long,end:long>>, items array<string>"), f"block{k}"))
    united = functools.reduce(DataFrame.unionByName, found).groupBy(F.col("k0").alias("w0"), F.col("k1").alias("w1"))
    united = united.agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items"))
    own = len(docs.columns)

    def joined(batches):
        for batch in batches:
            runs = [_united([[s["start"], s["end"]] for s in spans.as_py() or []]) for spans in batch.column(own)]
            counts = [len(words(text.as_py())) for text in batch.column(where)]
            yield finish(batch.select(list(range(own))), counts, runs, [x.as_py() or [] for x in batch.column(own + 1)])

    return docs.join(few(united), (F.col("k0") == F.col("w0")) & (F.col("k1") == F.col("w1")), "left").drop("w0", "w1").mapInArrow(joined, schema)


def _united(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit words, [start, end))."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *document_key(docs), F.col("text").cast("string").alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]

    def finish(batch, counts, runs, items):
        hit = [sum(b - a for a, b in r) for r in runs]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        cols = (counts, hit, [len(x) for x in items], digests, [h > 0 for h in hit])
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), _spans(runs)], names=names)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
    return with_hits(rows, benchmark, window, block_words, finish, schema)


def without_spans(text: str, runs: list[list[int]]) -> str:
    """text without the given runs of words (and what stands between the words of a run)."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, last = [], 0
    for a, b in runs:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with hit spans cut out of text; a document of which more than max_coverage of the words is hit goes.

    n_chars, where docs has it, follows the text that is left. All columns are
    kept by name, whatever else docs holds.
    """
    names = docs.columns
    where, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *document_key(docs), F.col("text").cast("string").alias("text"))

    def finish(batch, counts, runs, items):
        cols = batch.column(0).flatten()
        keep, texts, chars_of = [], cols[where].to_pylist(), {}
        for i, (n, run) in enumerate(zip(counts, runs, strict=True)):
            if run:
                if sum(b - a for a, b in run) > max_coverage * n:
                    continue
                texts[i] = without_spans(texts[i], run)
                chars_of[i] = len(texts[i])
            keep.append(i)
        cols[where] = pa.array(texts, cols[where].type)
        if chars is not None:
            old = cols[chars].to_pylist()
            cols[chars] = pa.array([chars_of.get(i, old[i]) for i in range(len(old))], cols[chars].type)
        return pa.RecordBatch.from_arrays(cols, names=names).take(pa.array(keep, pa.int64()))

    return with_hits(rows, benchmark, window, block_words, finish, docs.schema)
