"""Removes every byte of a long string that occurs more than once in the corpus.

1. Each text is cut into segments (_windows.py): runs of window starts that
   share an anchor, a string of 64 bytes that all occurrences of a window share.
   What is shuffled is a few dozen bytes per 170 bytes of text.
2. Segments are counted by (anchor, digest). A segment found twice is repeated
   as a whole, however many copies there are; one of them stands for all.
3. Of anchors with two or more different segments, one segment of each kind is
   fetched from its text and ordered in blocks by two-stage suffix sorting
   (suffix_order.py); neighbours whose common prefix has `width` bytes are repeats.
4. An anchor of more than HOT different segments is split over blocks by
   digest. What is single within a block is then matched across blocks by the
   digest of its window, so no group is held by one task.

Anchors and digests of 64 bits each are used together: segments count as equal
if both agree. Apart from removal, documents that share a shorter passage with
another one are marked (passages).

Positions are bytes of the UTF-8 text; matches never cross documents.

Defined results: null and empty texts have no bytes, nothing to remove and the
digest of the empty string; a repeated row is another occurrence, so all its
windows go; a null doc_id is kept as it is; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest
from zstandard import ZstdCompressor, ZstdDecompressor

from ._util import Scratch, document_key
from ._windows import marks, segments
from .suffix_order import common_prefixes, suffix_array

#: Different segments of one anchor that one block takes (some 550 bytes each, so 4 MB of text to sort).
HOT = 8000
#: Bytes of a passage that a document shares with another (some 50 words), and of the strings that tell.
PASSAGE, MARK = 300, 160
#: Bytes of a block, but for its last group.
BLOCK = 2 << 20


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", *document_key(docs), "text")


def _shrunk(keyed: DataFrame) -> DataFrame:
    """keyed with raw, the compressed bytes, in place of text: what is shuffled by document."""

    def run(batches):
        pack = ZstdCompressor(level=3).compress
        for batch in batches:
            raw = pa.array([pack(t.as_py().encode()) for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], raw], names=["doc_id", "k0", "k1", "raw"])

    return keyed.mapInArrow(run, "doc_id long, k0 long, k1 long, raw binary")


def _segments(keyed: DataFrame, width: int) -> DataFrame:
    names = ["k0", "k1", "anchor", "digest", "lo", "n"]

    def run(batches):
        for batch in batches:
            for k0, k1, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                if len(raw) >= width:
                    anchors, digests, lo, n = segments(raw, width)
                    size = len(lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, k0.as_py())), pa.array(np.full(size, k1.as_py())), pa.array(anchors), pa.array(digests), pa.array(lo, pa.int64()), pa.array(n, pa.int32())],
                        names=names,
                    )

    def gathered(batches, rows=20_000):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return keyed.select("k0", "k1", "text").mapInArrow(gathered, "k0 long, k1 long, anchor long, digest long, lo long, n int")


def _fetch(keyed: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted rows with their segment's bytes; each text is read once."""
    per_text = wanted.groupBy(F.col("k0").alias("w0"), F.col("k1").alias("w1")).agg(
        F.collect_list(F.struct("anchor", "salt", "parts", "digest", "lo", "n", "m")).alias("want")
    )
    joined = _shrunk(keyed).join(per_text, (F.col("k0") == F.col("w0")) & (F.col("k1") == F.col("w1"))).select("k0", "k1", "raw", "want")

    def run(batches):
        unpack = ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for k0, k1, text, want in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw, k0, k1 = unpack(text.as_py()), k0.as_py(), k1.as_py()
                for w in want.as_py():
                    rows.append((w["anchor"], w["salt"], w["parts"], w["digest"], k0, k1, w["lo"], w["n"], w["m"], raw[w["lo"] : w["lo"] + w["n"] + width - 1]))
                    if len(rows) >= 4000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "salt", "parts", "digest", "k0", "k1", "lo", "n", "m", "raw"])

    return joined.mapInArrow(run, "anchor long, salt int, parts int, digest long, k0 long, k1 long, lo long, n int, m long, raw binary")


def block_repeats(rows: list[dict], width: int):
    """(k0, k1, start, end, anchor, window) of one block; window is null where the span is settled."""
    data = np.frombuffer(b"".join(r["raw"] for r in rows), np.uint8)
    sizes = np.array([len(r["raw"]) for r in rows])
    base = np.cumsum(sizes) - sizes
    starts = np.zeros(len(data), bool)
    for r, b in zip(rows, base.tolist(), strict=True):
        starts[b : b + r["n"]] = True
    order = suffix_array(data, width, starts)
    order = order[starts[order]]
    alike = common_prefixes(data, order, width) >= width
    repeated = np.zeros(len(data), bool)
    repeated[order[:-1][alike]] = True
    repeated[order[1:][alike]] = True
    head = np.zeros(len(data), bool)  # one of each class of equal windows
    head[order[np.concatenate([[True], ~alike])]] = True
    for r, b in zip(rows, base.tolist(), strict=True):
        known = repeated[b : b + r["n"]]
        if r["m"] < 2:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                yield r["k0"], r["k1"], r["lo"] + lo, r["lo"] + hi - 1 + width, r["anchor"], None
        if r["parts"] > 1:
            raw = r["raw"]
            for p in np.flatnonzero(head[b : b + r["n"]]).tolist():
                window = xxh3_64_intdigest(raw[p : p + width])
                window -= (window >> 63) << 64
                settled = known[p] or r["m"] >= 2
                yield None if settled else r["k0"], r["k1"], r["lo"] + p, r["lo"] + p + width, r["anchor"], window


def _sorted_blocks(fetched: DataFrame, width: int) -> DataFrame:
    names = ["k0", "k1", "start", "end", "anchor", "window"]

    def rows_of(batches):
        for batch in batches:
            yield from batch.to_pylist()

    def blocks(batches):
        held, size = [], 0
        for _, same in groupby(rows_of(batches), lambda r: (r["anchor"], r["salt"])):
            last = None
            for r in same:
                if r["digest"] != last:  # a repeated row of documents fetches a segment twice
                    held.append(r)
                    size += len(r["raw"])
                last = r["digest"]
            if size >= BLOCK:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        for block in blocks(batches):
            if found := list(block_repeats(block, width)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    dealt = fetched.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "digest")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def passages(docs: DataFrame, scratch: Scratch, passage: int = PASSAGE, gram: int = MARK) -> DataFrame:
    """(k0, k1) of documents that share a passage with another one.

    Every string of `passage` bytes that also stands in another document is
    found; a common string of `gram` bytes is enough to count.
    """
    names = ["k0", "k1", "mark"]

    def run(batches):
        for batch in batches:
            keys, sizes, found = [], [], []
            for text in batch.column(2):
                found.append(marks(text.as_py().encode(), gram, passage))
                sizes.append(len(found[-1]))
            for k in range(2):
                keys.append(pa.array(np.repeat(batch.column(k).to_numpy(), sizes)))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=names)

    found = scratch.store(_keyed(docs).select("k0", "k1", "text").mapInArrow(run, "k0 long, k1 long, mark long"), "marks")
    doc = F.xxhash64("k0", "k1")
    several = scratch.store(found.groupBy(F.col("mark").alias("m")).agg(F.min(doc).alias("a"), F.max(doc).alias("b")).where("a != b").select("m"), "several")
    out = scratch.store(found.join(several, F.col("mark") == F.col("m")).select("k0", "k1").distinct(), "passages")
    scratch.drop("marks", "several")
    return out


def repeats(docs: DataFrame, width: int = 400, hot: int = HOT) -> DataFrame:
    """(k0, k1, start, end): byte spans of repeated windows, by document key; spans may overlap."""
    if width < 128:
        raise ValueError("width is 128 bytes at least")
    scratch, keyed = Scratch(docs.sparkSession), _keyed(docs)
    found = scratch.store(_segments(keyed, width), "segments")
    kinds = found.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("k0", "k1", "lo", "n")).alias("one")).select("anchor", "digest", "m", "one.*")
    kinds = kinds.withColumn("d", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("m > 1 or d > 1")
    kinds = scratch.store(kinds, "kinds")
    # One row a kind, written before the join, so that adaptive execution can split the segments of a hot one.
    copies = kinds.where("m > 1").select(F.col("anchor").alias("a"), F.col("digest").alias("s"))
    whole = found.join(copies, (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("s"))).select(
        "k0", "k1", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + (width - 1)).alias("end")
    )
    whole = scratch.store(whole, "whole")
    scratch.drop("segments")
    parts = F.ceil(F.col("d") / F.lit(hot)).cast("int")
    wanted = kinds.where("d > 1").select(
        "anchor", "digest", "m", "k0", "k1", "lo", "n", parts.alias("parts"), F.pmod(F.col("digest"), parts.cast("long")).cast("int").alias("salt")
    )
    blocks = scratch.store(_sorted_blocks(_fetch(keyed, wanted, width), width), "blocks")
    open_ = blocks.where(F.col("window").isNotNull())
    twice = scratch.store(open_.groupBy(F.col("anchor").alias("a"), F.col("window").alias("w")).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "twice")
    across = open_.where(F.col("k0").isNotNull()).join(twice, (F.col("anchor") == F.col("a")) & (F.col("window") == F.col("w")))
    out = ["k0", "k1", "start", "end"]
    return whole.unionByName(blocks.where(F.col("window").isNull()).select(out)).unionByName(across.select(out))


def remove_repeats(docs: DataFrame, width: int = 400, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, spans (removed [start, end) bytes), kept (the bytes left) and shares_passage (see passages)."""
    shared = passages(docs, Scratch(docs.sparkSession)).select("k0", "k1", F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    by_text = repeats(docs, width, hot).unionByName(shared).groupBy(F.col("k0").alias("w0"), F.col("k1").alias("w1")).agg(F.collect_set(F.struct("start", "end")).alias("want"))
    joined = _shrunk(_keyed(docs)).join(by_text, (F.col("k0") == F.col("w0")) & (F.col("k1") == F.col("w1")), "left").select("doc_id", "raw", "want")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        unpack = ZstdDecompressor().decompress
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text, want in zip(batch.column(1), batch.column(2), strict=True):
                raw = unpack(text.as_py())
                runs: list[list[int]] = []
                shares = False
                for a, b in sorted((w["start"], w["end"]) for w in want.as_py() or ()):
                    if a < 0:
                        shares = True
                    elif runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for c, v in zip(cols, (len(raw), len(raw) - len(kept), len(runs), [{"start": a, "end": b} for a, b in runs], kept, shares), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "shares_passage"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, shares_passage boolean")
