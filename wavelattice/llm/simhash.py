"""SimHash near-duplicates by segment-popcount embedding.

A document's 64-bit fingerprint is cut into 16 segments of four bits. The
vector of their bit counts is an embedding in which the Manhattan distance
never exceeds the Hamming distance of the fingerprints. Two vectors at distance
2 or less have a grid cell within distance 1 of both, so each distinct
fingerprint is put into its own cell and the (at most 32) cells beside it, cells
are joined by equality, and the Hamming distance is then verified on the
fingerprints themselves.

Only distinct fingerprints are joined: a group of a million copies is one row.
The number of cells per fingerprint is constant, so the join's input grows in
proportion to the corpus.

Defined results: null and empty texts have no words, hence fingerprint zero,
linked like any other; a repeated row is a copy; a null doc_id takes its
group's smallest non-null doc_id; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._util import Scratch, connected_components, cut, few, give_back

SEED = 42
#: Per byte value, its eight bits as eight one-byte counters of a word.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
#: Rows whose one-byte counters can be added without overflow.
_STEP = 255
#: Bits of the parity sketch of a shingle set, at least; twice as many as it has shingles, rounded up to a power of two.
SKETCH = 1024
#: Different texts in which frequent shingles are looked for, about, and frequent shingles remembered, at most. They order shingles only; any order finds the same pairs.
SAMPLE, FREQUENT = 20_000, 1 << 17


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split() if text else []


def shingles(tokens: list[bytes], n: int) -> list[bytes]:
    if len(tokens) <= n:
        return [b" ".join(tokens)] if tokens else []
    return [b" ".join(t) for t in zip(*(tokens[k:] for k in range(n)), strict=False)]


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the unsigned 64-bit hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = _SPREAD[hashes.view(np.uint8)].reshape(n, 8)
    sums = np.add.reduceat(lanes, np.arange(0, n, _STEP), axis=0)
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                grams = shingles(words(text.as_py()), shingle_words)
                out[i] = fingerprint(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 16 four-bit segments, four bits each, as one long."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in (1, 2, 3)), fp.bitwiseAND(ones))


def grid_cells(counts: Column) -> Column:
    """The cell of an embedding and the valid cells at Manhattan distance 1."""
    out = [counts]
    for k in range(16):
        one = 1 << 4 * k
        here = F.shiftrightunsigned(counts, 4 * k).bitwiseAND(F.lit(15))
        out += [F.when(here < 4, counts + F.lit(one)), F.when(here > 0, counts - F.lit(one))]
    return F.array_compact(F.array(*out))


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v), u < v: pairs of distinct fingerprints (column fp) at max_bits differing bits or fewer."""
    if not 0 <= max_bits <= 2:
        raise ValueError("cells beside each other cover at most 2 differing bits")
    cells = distinct.select("fp", F.explode(grid_cells(segment_counts(F.col("fp")))).alias("cell"))
    a, b = cells.select("cell", F.col("fp").alias("u")), cells.select("cell", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    return a.join(b, (a["cell"] == b["cell"]) & (F.col("u") < F.col("v")) & near).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    prints = cut(fingerprints(docs, shingle_words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = connected_components(links(distinct.select("fp"), max_bits))
    groups = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = groups.groupBy("label").agg(F.min("first").alias("component_id"))
    groups = groups.join(smallest, "label").select(F.col("fp").alias("fp_"), "component_id")
    return prints.join(groups, F.col("fp") == F.col("fp_")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The different shingles of n words as sorted 64-bit hashes."""
    grams = set(shingles(words(text), n))
    return np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), _id, _text (hash) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_text"), text.alias("text"))


def frequent_shingles(keyed: DataFrame, n: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of shingles that several of some SAMPLE texts hold, and how many do: the most frequent, FREQUENT at most."""
    every = max(1, -(-keyed.count() // SAMPLE))
    texts = keyed.where(F.pmod("_text", F.lit(every)) == 0).groupBy("_text").agg(F.first("text").alias("text")).select("text")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 50):
                hashes = np.concatenate([shingle_set(t.as_py(), n) for t in batch.column(0)[k : k + 50]])
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["h"])
        give_back()

    most = 1000
    counts = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counts = scratch.store(counts.select("h", F.least("c", F.lit(most)).cast("int").alias("c")), "frequent")
    total, least = 0, most + 1
    for c, rows in sorted(counts.groupBy("c").count().collect(), reverse=True):  # `most` rows at most
        total += rows
        if total > FREQUENT:
            break
        least = c
    table = counts.where(F.col("c") >= least).toArrow()
    scratch.drop("frequent")
    hashes, times = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order]


def rarest_first(have: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A sorted set in the one order of all sets: by how frequent a shingle is, then by hash."""
    hashes, times = frequent
    if not len(hashes) or not len(have):
        return have
    place = np.minimum(np.searchsorted(hashes, have), len(hashes) - 1)
    return have[np.argsort(np.where(hashes[place] == have, times[place], 0), kind="stable")]


NONE = np.zeros(0, np.uint64), np.zeros(0, np.int32)


def shingle_prefixes(keyed: DataFrame, n: int, frequent: tuple[np.ndarray, np.ndarray] = NONE) -> DataFrame:
    """(_id, _text, node, n, fp, prefix, sketch) by row: node is a digest of the shingle set, n its size, fp its fingerprint.

    Sets that share four fifths of their union share a hash among the first
    fifth (and one more) of each, in any one order; these are the prefix.
    Shingles known to be frequent come last: else the pairs that meet at a
    shingle grow with the square of the corpus. Each hash flips one bit
    of the sketch, so sets differ in at least as many hashes as their sketches in bits.
    """

    def run(batches):
        for batch in batches:
            nodes, sizes, prints, prefixes, sketches = [], [], [], [], []
            for text in batch.column(2):
                have = shingle_set(text.as_py(), n)
                nodes.append(xxh64_intdigest(have.tobytes(), SEED))
                sizes.append(len(have))
                prints.append(fingerprint(have))
                prefixes.append(rarest_first(have, frequent)[: len(have) - -(-4 * len(have) // 5) + 1].view(np.int64))
                size = max(SKETCH, 1 << (2 * len(have) - 1).bit_length()) if len(have) else SKETCH
                odd = np.bincount((have % np.uint64(size)).astype(np.int64), minlength=size) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (prefixes, sketches)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], node, pa.array(sizes, pa.int64()), fp, *lists], names=["_id", "_text", "node", "n", "fp", "prefix", "sketch"])
        give_back()

    return keyed.select("_id", "_text", F.col("text").cast("string").alias("text")).mapInArrow(run, "_id long, _text long, node long, n long, fp long, prefix array<long>, sketch array<long>")


def sets_of(keyed: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, have): the whole shingle sets of wanted(node, id_, text_), from their texts."""
    few_, texts = few(wanted), keyed.select("_id", "_text", "text")
    texts = texts.join(few_, texts["_id"].eqNullSafe(wanted["id_"]) & (texts["_text"] == wanted["text_"])).select("node", "text")

    def run(batches):
        for batch in batches:
            have = [shingle_set(t.as_py(), n).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(have, pa.list_(pa.int64()))], names=["node", "have"])

    return texts.mapInArrow(run, "node long, have array<long>").dropDuplicates(["node"])


def folded(sketch: Column, size: Column) -> Column:
    """A sketch brought to `size` longs, half as many as it has at most: slots that meet are added by parity."""
    half = (F.size(sketch) / 2).cast("int")
    both = F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > size, both).otherwise(sketch)


def print_pairs(first: DataFrame) -> DataFrame:
    """(u, v), u < v: pairs of sets by their fingerprints. Sets of one fingerprint are paired with the least of them, and least sets with those of linked fingerprints."""
    least = first.groupBy("fp").agg(F.min("node").alias("least"))
    same = first.select("fp", "node").join(least, "fp").where("node != least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    ends = [least.select(F.col("fp").alias(x), F.col("least").alias(f"l{x}")) for x in "uv"]
    near = links(least.select("fp")).join(ends[0], "u").join(ends[1], "v")
    return same.unionByName(near.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")))


def groups_of_sets(keyed: DataFrame, first: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(node, label) of sets that are linked to another one.

    Links are looked for by SimHash first: sets whose fingerprints are linked
    (print_pairs) are verified. What two bits do not reach is found by prefixes.

    A semi-join keeps the prefix hashes at which a set has any possible partner:
    at a pair's common hash, what follows it in either set bounds the overlap,
    which has to be 4/9 of the two sizes together. Along each such hash the
    first set and the one before are looked at, and each set is verified against
    the one that it meets most often; links found so make groups. Only sets of
    different groups are then joined in pairs, so that a group of g near copies
    does not make g x g rows. Pairs are verified after their sketches.
    """
    rows = first.select("node", "n", F.posexplode("prefix").alias("rank", "key")).select("node", "n", (F.col("n") - F.col("rank")).alias("left"), "key")

    def possible(x: str, y: str) -> Column:
        return 9 * F.least(f"{x}.left", f"{y}.left") >= 4 * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    hits = rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & possible("x", "y"), "left_semi")
    hits = scratch.store(hits, "hits")
    known = hits.select("node").distinct().join(first, "node").select("node", "n", "sketch", F.col("_id").alias("id_"), F.col("_text").alias("text_"))
    known = scratch.store(known, "known")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (u, v), those whose sets have a Jaccard similarity of 0.8 or more."""
        a, b = (known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "uv")
        size = F.least(F.size("su"), F.size("sv"))
        bits = F.aggregate(F.zip_with(folded(F.col("su"), size), folded(F.col("sv"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        pairs = scratch.store(pairs.join(a, "u").join(b, "v").where(9 * bits <= F.col("nu") + F.col("nv")).select("u", "v"), f"{name}_near")
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        sets = scratch.store(sets_of(keyed, scratch.store(known.drop("sketch").join(ends, "node"), f"{name}_ends"), n), f"{name}_sets")
        a, b = sets.select(F.col("node").alias("u"), F.col("have").alias("x")), sets.select(F.col("node").alias("v"), F.col("have").alias("y"))
        out = pairs.join(a, "u").join(b, "v").where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("u", "v")
        out = scratch.store(out, name)
        scratch.drop(f"{name}_near", f"{name}_ends", f"{name}_sets")
        return out

    along = Window.partitionBy("key").orderBy("node")
    me = F.struct("node", "n", "left")
    beside = hits.select(me.alias("x"), F.first(me).over(along).alias("first"), F.lag(me).over(along).alias("prev"))
    beside = beside.select("x", F.explode(F.array("first", "prev")).alias("y")).where("y is not null and x.node != y.node").where(possible("x", "y"))
    met = beside.groupBy(F.col("y.node").alias("u"), F.col("x.node").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    met = met.groupBy("v").agg(F.max_by("u", F.struct("c", "u")).alias("u")).select("u", "v")
    tried = scratch.store(print_pairs(first).unionByName(met).distinct(), "tried")
    found = verified(tried, "links")
    groups = scratch.store(connected_components(found), "groups")
    label = hits.join(groups.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select("node", "n", "left", "key", F.coalesce("label", "node").alias("label"))
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & possible("x", "y")
    rest = label.alias("x").join(label.alias("y"), apart).select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    more = verified(rest, "more")
    return groups if more.isEmpty() else scratch.store(connected_components(found.unionByName(more)), "all_groups")


def deduplicate(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """docs with exactly one row of each group of near copies kept: the one of the smallest doc_id.

    Near copies have a Jaccard similarity of 0.8 or more between their sets of
    shingles, and groups are connected by such pairs. Pairs of 0.8 differ in
    some ten of 64 fingerprint bits, often in far more, so no bound on bits finds
    all of them: beside the pairs of linked fingerprints, candidates are joined by
    their shingles, none is left out, and each is verified on the sets of its texts.

    A row without a doc_id stays only where its group has no doc_id at all; of
    rows with one doc_id the text hash decides, of repeated rows any one stays.
    Texts without words are one group.
    """
    keyed, scratch = _keyed(docs), Scratch(docs.sparkSession)
    frequent = frequent_shingles(keyed, shingle_words, scratch)
    prefixes = scratch.store(shingle_prefixes(keyed, shingle_words, frequent), "prefixes")
    first = prefixes.groupBy("node").agg(F.min_by(F.struct("_id", "_text", "n", "fp", "prefix", "sketch"), F.struct("_id", "_text")).alias("f")).select("node", "f.*")
    found = groups_of_sets(keyed, scratch.store(first, "first"), shingle_words, scratch)
    scratch.drop("first", "hits", "known")
    mine = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id_"), F.col("_text").alias("text_"))
    members = prefixes.groupBy("_id", "_text", "node").agg(F.count(F.lit(1)).alias("rows"))
    members = members.join(found.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select(mine.alias("me"), "rows", F.coalesce("label", "node").alias("label"))
    members = scratch.store(members, "members")
    best = scratch.store(members.groupBy(F.col("label").alias("label_")).agg(F.min("me").alias("best")), "best")
    state = members.join(best, F.col("label") == F.col("label_"))
    same = lambda t: keyed["_id"].eqNullSafe(t["id_"]) & (keyed["_text"] == t["text_"])
    gone = scratch.store(state.where("me != best").select("me.id_", "me.text_"), "gone")
    several = scratch.store(state.where("me = best and rows > 1").select("me.id_", "me.text_"), "several")
    scratch.drop("prefixes", "members", "best")
    kept = keyed.join(few(gone), same(gone), "left_anti")
    if several.isEmpty():
        return kept.select("row.*")
    once = kept.join(few(several), same(several), "left_semi").dropDuplicates(["_id", "_text"])
    return kept.join(few(several), same(several), "left_anti").unionByName(once).select("row.*")
