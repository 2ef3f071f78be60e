"""Packs token ids into sequences along a space-filling curve.

Each document's ids are projected (a fixed random vector per id, averaged) to
DIMS numbers, squashed to a grid, and given the cell's place on a Hilbert
curve. Documents are range-partitioned and sorted by that key, with the
document's own hash as a further key so that a third of equal documents spreads
over partitions of some PART bytes, and laid end to end within each partition. A sequence is cut at `length` ids. What
is left at a partition's end is cut into powers of two, which need no padding,
so no sequence is padded.

Ids are computed once and checkpointed, as range partitioning reads its input
twice.

Defined results: null and empty texts are the end id alone; repeated rows are
separate documents; a null doc_id stays null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._util import cut, give_back

DIMS, BITS = 3, 16
END = 1
_DOUBLE = re.compile(r"\s\s")
#: White space, and characters beyond Latin letters, whose classes may differ between libraries.
_ODD = re.compile("[\\s\u0250-\U0010ffff]")
#: RE2: neighbouring white space, white space other than blanks and line breaks, and characters beyond Latin letters.
_CARE = r"[ \n]{2}|[\t\x0B-\r\x1C-\x1F\x{85}\x{A0}\x{250}-\x{10FFFF}]"
#: The usual cutting pattern where no white space has neighbours but a blank after a line break; without a look-ahead it runs as an automaton.
_SINGLE = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")
#: ASCII marks, none of which is a letter, a digit or white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words remembered by a worker (some 200 bytes each).
MEMO = 250_000
#: Characters of text that are looked up at a time, and words that are encoded as one text.
CHUNK, RUN = 1 << 21, 4000
#: Bytes of ids in a partition that is packed.
PART = 32 << 20


def _within_a_word(token: dict) -> bool:
    """Whether an added token is never cut by white space or between letters and marks."""
    content = token["content"]
    return not re.search(r"\s", content) and content[0] in MARKS and content.strip(MARKS) != "" and not token["lstrip"] and not token["rstrip"]


def ranked(spec: dict):
    """A function from a text to its ids, by merge ranks alone; None unless the tokenizer (its JSON) is plain byte-level BPE.

    It is the same vocabulary and the same merges, run by another library at a
    quarter of the cost. Strings of added tokens are ordinary text to it, and
    white space must be single, but for a blank after a line break.
    """
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not spec.get("normalizer")
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    # Printable bytes stand for themselves, the others for the characters from U+0100 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
    tokens = [bytes([b]) for b in range(256)] + [bytes(byte[c] for c in "".join(pair)) for pair in merges]
    ids = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if all(c in byte for c in token)}
    if len(set(tokens)) < len(tokens) or not ids.keys() >= set(tokens):
        return None
    table = np.array([ids[t] for t in tokens], "<u4")
    encode = tiktoken.Encoding("ranked", pat_str=_SINGLE, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={}).encode_to_numpy
    return lambda text: table[encode(text)]


class Words:
    """Ids of words with a given text before each of them; a word is encoded when it is first met."""

    def __init__(self, ids: Ids, before: str, marks: Words | None = None):
        """marks: knows the marks after a word, which are encoded apart from its letters; by default this one."""
        self.ids, self.before, self.kind, self.marks = ids, before, ids.type, marks or self
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.pool, self.bounds = np.empty(0, self.kind), np.zeros(1, np.int64)

    def _add(self, words: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.place)
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        self.pool = np.concatenate([self.pool, flat])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])

    def _encoded(self, words: list[str]) -> None:
        """Adds words: those without white space as lines of one text, as no token reaches over a line break."""
        special = self.ids.added
        odd = [w for w in words if not w or _ODD.search(w) or any(x in w for x in special)]
        if odd:
            apart = set(odd)
            words = [w for w in words if w not in apart]
        order, flat, counts = [], [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for k in range(0, len(words), RUN):
            run = words[k : k + RUN]
            got = self.ids.one("\n".join([self.before + w for w in run])).astype(self.kind)
            breaks = np.flatnonzero(got == self.ids.line_break)
            if len(breaks) == len(run) - 1:
                order += run
                flat.append(np.delete(got, breaks))
                counts.append(np.diff(np.concatenate([[-1], breaks, [len(got)]])) - 1)
            else:
                odd += run
        for w, got in zip(odd, self.ids.encode([self.before + w for w in odd]), strict=True):
            order.append(w)
            flat.append(got)
            counts.append(np.array([len(got)]))
        self._add(order, np.concatenate(flat), np.concatenate(counts))

    def _learn(self, words: list[str]) -> None:
        ended, whole = [], []
        for w in words:
            letters = w.rstrip(MARKS)
            if len(letters) < len(w) and letters.isalpha():
                ended.append((w, letters, w[len(letters) :]))
            else:
                whole.append(w)
        self._encoded(whole)
        if ended:
            words, letters, marks = zip(*ended, strict=True)
            left, right = self(list(letters)), self.marks(list(marks))
            ids = [np.empty(0, self.kind)]
            for k, m in zip(left.tolist(), right.tolist(), strict=True):
                ids.append(self.pool[self.bounds[k] : self.bounds[k + 1]])
                ids.append(self.marks.pool[self.marks.bounds[m] : self.marks.bounds[m + 1]])
            self._add(list(words), np.concatenate(ids), self.counts(left) + self.marks.counts(right))

    def counts(self, places: np.ndarray) -> np.ndarray:
        return self.bounds[places + 1] - self.bounds[places]

    def __call__(self, words: list[str]) -> np.ndarray:
        """Places of words in bounds."""
        got = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(got < 0)
        if len(unknown):
            new = [words[k] for k in unknown.tolist()]
            self._learn(list(dict.fromkeys(new)))
            got[unknown] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        return got


class Ids:
    """Token ids of texts as little-endian bytes.

    Latin texts without neighbouring white space are encoded whole by merge
    ranks, where the tokenizer allows it. In others, words met before are
    looked up: a byte-level tokenizer never joins what stands before a single
    space or on both sides of a single line break, so a text without
    neighbouring white space is the sum of its words; nor does it join letters
    and marks after them. Texts with neighbouring white space, and other kinds
    of tokenizer, are encoded whole by `tokenizers`.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([END], self.type).tobytes()
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        by_rank = ranked(spec)
        self.one = by_rank or (lambda text: self.encode([text])[0])
        line_break = self.encode(["\n"])[0]
        self.line_break = int(line_break[0])
        self.by_word = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and len(line_break) == 1 and all(map(_within_a_word, spec.get("added_tokens") or []))
        self.by_rank = by_rank if self.by_word else None
        self.bare = Words(self, "")
        self.spaced = Words(self, " ", self.bare)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without neighbouring white space: each different word of all is looked up once."""
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n "), " ")
        first = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        bare = np.zeros(len(code), bool)  # no space before it: first of the text or of a line, or a line break
        bare[first[:-1]] = True
        if "\n" in words:
            breaks = code == words.index("\n")
            bare[1:] |= breaks[:-1]
            bare |= breaks
        # A chunk has fewer than 2^31 ids, and so has a pool.
        pools, starts, counts, before = [], np.empty(len(code), np.int32), np.empty(len(code), np.int32), 0
        for known, here in ((self.bare, np.flatnonzero(bare)), (self.spaced, np.flatnonzero(~bare))):
            used = np.flatnonzero(np.bincount(code[here], minlength=len(words)))
            at = known([words[k] for k in used.tolist()])
            start, count = np.zeros((2, len(words)), np.int32)
            start[used], count[used] = known.bounds[at] + before, known.counts(at)
            starts[here], counts[here] = start[code[here]], count[code[here]]
            pools.append(known.pool)
            before += len(known.pool)
        ends = np.cumsum(counts, dtype=np.int32)
        ids = np.concatenate(pools)[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1], dtype=np.int32)]
        bounds = np.concatenate([[0], ends])[first]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        for known in (self.bare, self.spaced):
            if len(known.place) > MEMO:
                known.clear()
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        care = pc.match_substring_regex(pa.array(texts, pa.large_string()), _CARE).to_pylist()
        for k, text in enumerate(texts):
            if self.by_rank and not care[k] and not any(x in text for x in self.added):
                out[k] = self.by_rank(text).astype(self.type).tobytes()
            elif self.by_word and not _DOUBLE.search(text):
                plain.append(k)
            else:
                out[k] = self.encode([text])[0].tobytes()
        if plain:
            for k, ids in zip(plain, self._by_words([texts[k] for k in plain]), strict=True):
                out[k] = ids
        return [ids + self.end for ids in out]


@functools.lru_cache(maxsize=1)
def worker_ids(path: str) -> Ids:
    """One per worker process, so that words are remembered from task to task."""
    return Ids(path)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows of cells), as longs."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    level = top
    while level > 1:  # rotations and reflections, from the coarsest level down
        low = level - 1
        for k in range(dims):
            flip = (x[k] & level) != 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
        level >>= 1
    for k in range(1, dims):  # Gray code
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    level = top
    while level > 1:
        turn = np.where((x[-1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            key = key << 1 | (x[k] >> b & 1)
    return key


def tokenized(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row of docs: doc_id, ids (little-endian, two or four bytes each), curve (Hilbert key), salt."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        give_back()
        encode = worker_ids(tokenizer_path)
        table = np.random.default_rng(7).standard_normal((encode.tokenizer.get_vocab_size(), DIMS), np.float32)
        def coded(ids: list, texts: list[str]):
            raw = encode(texts)
            vectors = np.array([table[np.frombuffer(r, encode.type)].mean(axis=0) for r in raw], np.float32).reshape(-1, DIMS)
            cells = np.minimum(((np.tanh(3 * vectors) + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(hilbert(cells)), pa.array([encode.type.itemsize] * len(raw), pa.int32())], names=["doc_id", "ids", "curve", "width"])

        ids, held, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc.as_py())
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size > CHUNK:
                    yield coded(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield coded(ids, held)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, curve long, width int")


def lay_out(rows, length: int, first_sequence: int):
    """Pieces (doc_id, start, ids, doc_tokens, sequence, offset) of documents (doc_id, ids) laid end to end."""
    sequence, held, used = first_sequence, [], 0

    def placed(pieces, at):
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, sequence, at
            at += len(ids)

    for doc, ids in rows:
        total, start = len(ids), 0
        while start < total:
            take = min(length - used, total - start)
            held.append((doc, start, ids[start : start + take], total))
            start, used = start + take, used + take
            if used == length:
                yield from placed(held, 0)
                sequence, held, used = sequence + 1, [], 0
    while used:
        room = 1 << used.bit_length() - 1
        now, used = [], used - room
        while room:
            doc, start, ids, total = held.pop(0)
            now.append((doc, start, ids[:room], total))
            if len(ids) > room:
                held.insert(0, (doc, start + room, ids[room:], total))
            room -= len(now[-1][2])
        yield from placed(now, 0)
        sequence += 1


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id is the partition's number times 2^40 plus a count.
    """
    ids = cut(tokenized(docs, tokenizer_path))
    salt = F.xxhash64("doc_id", "ids")
    parts = max(1, math.ceil((ids.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) / PART))
    dealt = ids.withColumn("salt", salt).repartitionByRange(parts, "curve", "salt").sortWithinPartitions("curve", "salt", "doc_id")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows_of(batches):
        for batch in batches:
            for doc, raw, width in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                yield doc.as_py(), np.frombuffer(raw.as_py(), f"<u{width.as_py()}")

    def run(batches):
        out: list[tuple] = []
        for doc, start, got, total, sequence, offset in lay_out(rows_of(batches), length, TaskContext.get().partitionId() << 40):
            raw = got.astype("<u4").tobytes()
            out.append((doc, start, len(got), raw, crc32(raw), total, sequence, offset))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return dealt.select("doc_id", "ids", "width").mapInArrow(run, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
