"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wavelattice.llm import decontamination, language_id, licenses, line_dedup, packing, quality, simhash, substring_dedup, suffix_dedup, toxicity
from wavelattice.llm.suffix_order import suffix_array

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rejected int"


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n)) + "."


LONG = prose(4000)
BASE = "\n".join(prose(40) for _ in range(4))
ITEM = prose(15)
ROWS = [
    (1, BASE, "en", "s", 1, "x", 0), (2, BASE, "en", "s", 1, "x", 0), (2, BASE, "en", "s", 1, "x", 0), (3, BASE + " " + prose(1), None, None, None, None, None),
    (4, None, "en", "s", None, None, 1), (5, "", "en", "s", 0, None, 1), (6, "  \n\n ", "de", "s", 5, None, 1), (None, prose(60), "de", "s", 5, None, 1),
    (7, LONG, "de", "s", 5, None, 1), (8, prose(30) + " " + ITEM + " " + prose(30), "de", "s", 5, None, 1), (9, "Released under the MIT Licence.\n" + prose(30), "de", "s", 5, None, 1),
    (10, "a" * 3000, "de", "s", 5, None, 1), (11, "12345 !!", "de", "s", 5, None, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, "zq zr"), (None, "")], "item_id long, text string")


def model():
    return language_id.train([(prose(50), "en") for _ in range(20)] + [("zzz yyy xxx " * 10, "zz") for _ in range(20)])


def test_one_row_per_row_and_empty_tables(docs, empty, benchmark, tmp_path):
    import public_tokenizers

    toxic = toxicity.Model({b"bad": 3.0})
    made = {
        "toxicity": lambda d: toxicity.score(d, toxic), "language": lambda d: language_id.identify(d, model()), "quality": quality.quality, "simhash": simhash.near_duplicates,
        "decontamination": lambda d: decontamination.scan_documents(d, benchmark), "substring": substring_dedup.remove_units, "suffix": suffix_dedup.remove_repeats,
    }
    for name, f in made.items():
        assert f(docs).count() == len(ROWS), name
        assert f(empty).count() == 0, name
    ids = len({r[0] for r in ROWS})
    assert line_dedup.report(docs).count() == ids and line_dedup.report(empty).count() == 0
    assert licenses.scan(docs).count() == ids and licenses.scan(empty).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(docs, path, 64)
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(x) // 2 for x in packing.Ids(path)([r[1] or "" for r in ROWS]))
    assert packing.pack(empty, path).count() == 0


def test_simhash_groups(docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] == 1 and got[4] == got[5] == got[6] == 4 and got[7] == 7
    assert simhash.deduplicate(docs).columns == docs.columns


def test_segment_counts_bound_hamming(spark):
    pairs = [(R.getrandbits(64) - (1 << 63), R.getrandbits(64) - (1 << 63)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.segment_counts(F.col("a")).alias("x"), simhash.segment_counts(F.col("b")).alias("y"))
    for r in df.collect():
        gap = sum(abs((r.x >> 4 * k & 15) - (r.y >> 4 * k & 15)) for k in range(16))
        assert gap <= bin((r.a ^ r.b) & (1 << 64) - 1).count("1")


def test_decontamination(docs, benchmark):
    got = {r.doc_id: r for r in decontamination.scan_documents(docs, benchmark).collect()}
    assert got[8].n_hit >= 15 and got[8].n_items == 1 and not got[7].contaminated
    left = {r.doc_id: r.text for r in decontamination.decontaminate(docs, benchmark).collect()}
    assert ITEM.rstrip(".") not in left[8] and left[7] == LONG


def test_automaton_against_brute_force():
    for _ in range(30):
        items = [(str(k), [R.choice([b"a", b"b", b"c"]) for _ in range(R.randint(1, 9))]) for k in range(4)]
        text = [R.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        hit, names = set(), set()
        for name, ws in items:
            n = min(len(ws), 4)
            for i in range(len(ws) - n + 1):
                for j in range(len(text) - n + 1):
                    if text[j : j + n] == ws[i : i + n]:
                        hit |= set(range(j, j + n))
                        names.add(name)
        runs, found = decontamination.Automaton(items, 4).scan(text)
        assert {p for a, b in runs for p in range(a, b)} == hit and found == names


def test_maximal_segments():
    for _ in range(100):
        scores = [(i, float(R.randint(-3, 3))) for i in range(12) if R.random() < 0.7]
        full = [-0.5] * 12
        for i, s in scores:
            full[i] = s
        best = max((sum(full[a:b]) for a in range(12) for b in range(a + 1, 13)), default=0)
        got = toxicity.maximal_segments(scores, 0.5)
        assert max((s for *_, s in got), default=0.0) == pytest.approx(max(best, 0.0))
        assert all(s == pytest.approx(sum(full[a:b])) for a, b, s in got)


def test_suffix_order():
    for _ in range(40):
        data = bytes(R.choice(b"ab\x00\xff") for _ in range(R.randint(1, 200)))
        import numpy as np

        order = suffix_array(np.frombuffer(data, np.uint8), 24)
        keys = [data[i : i + 24].ljust(24, b"\0") for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(len(data)))


def test_repeats_split_over_blocks(docs):
    one = sorted(map(str, suffix_dedup.remove_repeats(docs).drop("spans").collect()))
    two = sorted(map(str, suffix_dedup.remove_repeats(docs, hot=1).drop("spans").collect()))
    assert one == two
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[1].n_removed == len(BASE) and got[10].n_removed == 3000 and got[7].n_removed == 0


def test_licence_notice(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[9].notice_licenses == "MIT" and got[7].n_notices == 0


def test_whole_licences(spark):
    missing = {"CC-BY-4.0", "CC-BY-NC-4.0"}  # known as notices only
    names = sorted((set(licenses.NOTICES) - missing) | {"LGPL-2.1", "LGPL-3.0", "MPL-2.0"})
    folder = Path(licenses.__file__).parent / "license_texts"
    rows = [(k, "Copyright (c) 2019 Some Owner\n" + (folder / f"{n}.txt").read_text().upper().replace("\n", "  \n") if n != "MIT" else licenses.TEXTS[n]) for k, n in enumerate(names)]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(names)) and not missing & set(licenses.TEXTS)


def test_padded_licence_notice(spark):
    rows = [(1, "*" * 400 + " Released under the MIT License. " + "*" * 400), (2, " " * 500 + "Licensed under CC BY 4.0"), (3, prose(200))]
    got = {r.doc_id: r.notice_licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "CC-BY-4.0", 3: ""}


def test_lines(docs):
    kept = line_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    got = {r.doc_id: r for r in line_dedup.report(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 4 and got[7].n_removed == 0


def test_quality(docs):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert got[7].kept and not got[4].kept and got[4].n_words == 0 and got[10].n_words == 1


def test_common_prefixes():
    import numpy as np

    from wavelattice.llm.suffix_order import common_prefixes

    for _ in range(60):
        data = bytes(R.choice(b"ab\x00\xff") for _ in range(R.randint(1, 200)))
        order = suffix_array(np.frombuffer(data, np.uint8), 24)
        for a, b, n in zip(order, order[1:], common_prefixes(np.frombuffer(data, np.uint8), order, 24), strict=False):
            x, y = data[a : a + 24], data[b : b + 24]
            assert n == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_shared_passage(spark):
    passage = prose(70)
    rows = [(1, prose(50) + passage), (2, passage + prose(90)), (3, prose(200)), (4, passage[:150]), (5, None), (None, passage), (None, "")]
    got = [(r.doc_id, r.shares_passage) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, True), (2, True), (3, False), (4, False), (5, False), (None, True), (None, False)]))


def test_decontamination_in_blocks(spark, docs, benchmark):
    items = benchmark.unionByName(spark.createDataFrame([(k, prose(12)) for k in range(10, 16)] + [(20, LONG[:200])], "item_id long, text string"))
    one, two = (sorted(map(str, decontamination.scan_documents(docs, items, block_words=n).collect())) for n in (10**6, 20))
    assert one == two and any("contaminated=True" in r for r in one)
    left = [sorted(map(str, decontamination.decontaminate(docs, items, block_words=n).collect())) for n in (10**6, 20)]
    assert left[0] == left[1]


def test_empty_benchmark_and_documents(spark, docs, empty, benchmark):
    none = benchmark.limit(0)
    assert not any(r.contaminated for r in decontamination.scan_documents(docs, none).collect())
    assert decontamination.decontaminate(docs, none).count() == len(ROWS) and decontamination.decontaminate(empty, benchmark).count() == 0


CLASHING = "doc_id long, text string, n_chars long, score string, lang_pred string, rejected string, k0 string, w0 string, w1 string, lost string, row string, spans string, items string, n_words string, node string, have string, _id string, _text string, id_ string, text_ string, `a.b` string"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(r[0], r[1], r[4], *["x"] * 18) for r in ROWS]
    return spark.createDataFrame(rows, CLASHING)


def test_pipeline_stages_keep_columns_of_any_name(clashing, benchmark):
    for name, f in {
        "accepted": lambda d: language_id.accepted(d, model()), "lines": line_dedup.deduplicate, "simhash": simhash.deduplicate, "decontaminate": lambda d: decontamination.decontaminate(d, benchmark),
    }.items():
        got = f(clashing)
        assert got.columns == clashing.columns, name
        assert got.count() > 0 and f(clashing.limit(0)).count() == 0, name
        assert all(r["a.b"] == "x" and r["k0"] == "x" for r in got.collect()), name


def test_language_letters_and_rejection():
    rng = random.Random(3)
    known = {"aa": "the of and to in is that for it with as was".split(), "bb": "der die und das nicht ein sich mit auf ist".split()}
    text = lambda lang, n: " ".join(rng.choice(known[lang]) for _ in range(n))
    m = language_id.train([(text(x, 80), x) for x in known for _ in range(150)])
    lang, score, rejected = m.predict([None, "", "\u00b2 \u00bd \u2167 \u2460 12", text("aa", 60), text("bb", 60), "qxz zqj xxqz jjq wvq " * 20])
    assert lang[:3] == ["und"] * 3 and not score[:3].any() and rejected[:3].all()
    assert lang[3:5] == ["aa", "bb"] and not rejected[3:5].any() and rejected[5]
