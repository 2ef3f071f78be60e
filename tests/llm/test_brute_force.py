"""Queries that SQL cannot express, over the whole smallest table, against direct versions."""

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from wavelattice.llm import queries, simhash

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.text for r in rows}


def fingerprint(text):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    counts = Counter(b for p in parts for h in [xxhash.xxh64_intdigest(p.encode(), seed=42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, c in counts.items() if 2 * c > len(parts))


def test_simhash_near_dedup(spark, texts):
    prints = {k: fingerprint(t) for k, t in texts.items()}
    label = {k: k for k in prints}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash_near_dedup(spark, SF).collect()}
    assert got == {k: (f"{prints[k]:016x}", root(k)) for k in ids}


def test_deduplicate_by_five_word_shingles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    base = [f"w{k}" for k in range(400)]
    rows = [(r.doc_id, r.text) for r in rows]
    for k in range(1, 9):  # from one to eight words in 400 replaced: similarities around 0.8
        rows.append((10_000 + k, " ".join(f"x{k}{i}" if i % (400 // k) == 7 else w for i, w in enumerate(base))))
    rows += [(20_000, "one two three"), (None, "One  two three"), (20_000, "one two three"), (20_000, "four five"), (None, "six seven"), (None, "six seven"), (20_001, None), (20_002, " ")]
    sets = []
    for _, t in rows:
        words = WORD.findall((t or "").translate(UPPER))
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    holding, near = defaultdict(list), 0
    for i, s in enumerate(sets):
        shared = Counter(j for g in s or [None] for j in holding[g])
        for j, n in shared.items():
            if not s or 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                label[root(i)] = root(j)
                near += s != sets[j]
        for g in s or [None]:
            holding[g].append(i)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k])
    want = Counter()
    for members in groups.values():
        ids = [m[0] for m in members if m[0] is not None]
        want[min(ids) if ids else None] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(r.doc_id for r in simhash.deduplicate(docs).collect())
    assert near >= 12 and got == want and simhash.deduplicate(docs.limit(0)).count() == 0


def test_line_dedup(spark, texts):
    units = [(k, n, frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", u.lower()) if w)) for k in sorted(texts) for n, u in enumerate((texts[k] or "").split("\n"))]
    units = [u for u in units if u[2]]
    holding, lines, removed = defaultdict(list), Counter(), Counter()
    for place, (k, _, words) in enumerate(units):
        shared = Counter(p for w in words for p in holding[w])
        lines[k] += 1
        removed[k] += any(5 * s >= 4 * (len(words) + len(units[p][2]) - s) for p, s in shared.items())
        for w in words:
            holding[w].append(place)
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in queries.op8_line_dedup(spark, SF).collect()}
    assert got == {k: (lines[k], removed[k]) for k in texts} and sum(removed.values()) > 0


def test_suffix_array_dedup(spark, texts):
    raw = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(hash(b[i : i + 400]) for b in raw.values() for i in range(len(b) - 399))
    want = {}
    for k, b in raw.items():
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                edge[i] += 1
                edge[i + 400] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_array_dedup(spark, SF).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op10_packing(spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for k, rows in list(pieces.items()) + list(sequences.items()):
        at = 0
        for start, length in sorted(rows):
            assert start == at and length > 0
            at += length
    assert all(sum(n for _, n in pieces[k]) == len(v) for k, v in ids.items())
    used = [sum(n for _, n in rows) for rows in sequences.values()]
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert max(used) <= 2048 and padded == 0


@pytest.mark.parametrize("text", ["", "a\n", "\na", " a", "a ", "a\nb c. d!?\tq", "x y  z", "don't can't' it's, '' 's 't", "ab12, 12. <|endoftext|> a<|endoftext|>", "a\n\nb  c", "é́x b. 日本。"])
def test_word_lookup_equals_whole_texts(text):
    from wavelattice.llm.packing import Ids

    encode = Ids(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode.by_word
    want = encode.tokenizer.encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(encode([text])[0], encode.type).tolist() == want
