"""Packing: which texts are encoded whole, and that it makes no difference."""

import random

import public_tokenizers

from wavelattice.llm.packing import Ids

LATIN = [*map(chr, range(0x20, 0x250)), *" \n'std9²½."*20]


def same(encode, texts):
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    return [list(memoryview(raw).cast("H")) for raw in encode(texts)] == want


def test_single_spaced_latin_texts_are_encoded_whole_not_by_word():
    encode = Ids(public_tokenizers.path("byte_bpe_50k.json"))
    assert same(encode, ["Some words, never met before:\nthey're 12 or so.", "", "a", "é's"])
    assert not encode.spaced.place and not encode.bare.place


def test_texts_of_any_kind_get_the_ids_of_the_tokenizer():
    rng = random.Random(3)
    encode = Ids(public_tokenizers.path("byte_bpe_50k.json"))
    rare = LATIN + list("\t\r\x1c\x85\xa0’日") * 3 + ["<|endoftext|>"] * 3
    assert same(encode, ["".join(rng.choices(k, k=rng.randint(0, 40))) for k in (LATIN, rare) for _ in range(3000)])
