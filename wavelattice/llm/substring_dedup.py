"""Substring dedup by hashing paragraphs of sentences: of equal units the earliest stays.

Each text is cut after every line break and after white space that follows a
full stop, an exclamation mark or a question mark. Pieces are gathered to units
of MIN_WORDS words or more; a piece that has as many by itself stands alone. So
the cuts depend on nearby text only, and a passage is found whatever stands
around it. A unit is normalised (A-Z lower-cased, ASCII white space made
single) and digested (128 bits). Digests are grouped over the corpus with
map-side partial aggregates, the earliest occurrence by (doc_id, text hash,
place) is found as a minimum, and all others are removed with the white space
after them. Offsets are characters of the original text. Units that stay
shorter (before a long piece, at the end) are never removed: such are mostly
stock phrases that honest documents share.

A digest held by a third of all units is one aggregated row; that table is
written before it is joined with its units, so that adaptive execution can
split the units of such a digest.

Defined results: null and empty texts have one empty unit and nothing to
remove; a null doc_id comes before all others; rows with the same doc_id and
text are one document and get the same result; of rows with one doc_id and
different texts the order is by a hash of the text; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ._util import Scratch, document_key

MIN_WORDS = 20
#: Where a text is cut: after what this finds.
CUT = r"[.!?][\x20\x09-\x0D]+|\n"
_CUT = re.compile(CUT)


def units(text: str):
    """(place, digest or None for a short unit, start, end), with the white space after a unit in its span."""
    start, at, place, held = 0, 0, 0, []

    def unit():
        return place, (xxh3_128_digest(b" ".join(held)) if len(held) >= MIN_WORDS else None), start, at

    for end in [*(m.end() for m in _CUT.finditer(text)), len(text)]:
        words = text[at:end].encode().lower().split()
        if len(held) >= MIN_WORDS or (held and len(words) >= MIN_WORDS):
            yield unit()
            start, place, held = at, place + 1, []
        held, at = held + words, end
    yield unit()


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", *document_key(docs), "text")


def repeated_units(docs: DataFrame) -> DataFrame:
    """(k0, k1, start, end, first) of every unit that occurs more than once; first marks its earliest occurrence."""
    scratch = Scratch(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for k0, k1, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                k0, k1 = k0.as_py(), k1.as_py()
                rows += [(k0, k1, d, i, a, b) for i, d, a, b in units(text.as_py()) if d is not None]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["k0", "k1", "digest", "place", "start", "end"])

    found = scratch.store(_keyed(docs).select("k0", "k1", "text").mapInArrow(run, "k0 long, k1 long, digest binary, place int, start long, end long"), "units")
    where = F.struct("k0", "k1", "place")
    several = found.groupBy(F.col("digest").alias("d")).agg(F.min(where).alias("least"), F.max(where).alias("most")).where("least != most")
    several = scratch.store(several.select("d", "least"), "several")
    return found.join(several, F.col("digest") == F.col("d")).select("k0", "k1", "start", "end", (where == F.col("least")).alias("first"))


def remove_units(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_units, n_repeats (units found elsewhere too), n_removed, spans (removed [start, end) characters) and kept (the text left)."""
    by_text = repeated_units(docs).groupBy(F.col("k0").alias("w0"), F.col("k1").alias("w1")).agg(F.collect_set(F.struct("start", "end", "first")).alias("want"))
    joined = _keyed(docs).join(by_text, (F.col("k0") == F.col("w0")) & (F.col("k1") == F.col("w1")), "left").select("doc_id", "text", "want")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
    names = ["doc_id", "n_units", "n_repeats", "n_removed", "spans", "kept"]

    def run(batches):
        for batch in batches:
            out = []
            for text, want in zip(batch.column(1), batch.column(2), strict=True):
                text, want = text.as_py(), want.as_py() or []
                spans = sorted((w["start"], w["end"]) for w in want if not w["first"])
                pieces, last = [], 0
                for a, b in spans:
                    pieces.append(text[last:a])
                    last = b
                out.append((sum(1 for _ in units(text)), len(want), len(spans), [{"start": a, "end": b} for a, b in spans], "".join([*pieces, text[last:]])))
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return joined.mapInArrow(run, "doc_id long, n_units long, n_repeats long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
