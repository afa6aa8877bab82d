"""Encoder, token files and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest

from storyspark.llm import packing, token_files
from storyspark.llm.encoder import Encoder, default_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "bc", "é", "ß", "日本", "😀", "'s", "'ll", "1", "23", ".", "!!", " ", "　", "\x1c", "\x85", "  \n ", "foo", "<|endoftext|>", "\0", "​", "_"]
    texts = ["", " ", "x"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(1500)]
    enc, got = Encoder(default_path(), keep=50), []
    for k in range(0, len(texts), 100):
        got += enc.encode(texts[k:k + 100])
    assert [list(enc.ids(r)) for r in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark, tokenizer, odd, empty):
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    manifest = token_files.write(odd)
    got = sorted((tuple(r) for r in token_files.read(manifest).collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, text in rows:
        own = ids(tokenizer, text, 0)
        want.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert got == want
    first = manifest.orderBy("part").first()
    raw, offsets = (token_files.load(first["folder"], first["name"], *x) for x in (("bin", "<u2"), ("off", "<u8")))
    assert len(raw) == first["n_tokens"] == offsets[-1] and len(offsets) == first["n_docs"] + 1
    assert token_files.read(token_files.write(empty)).count() == 0


def test_cut_puts_the_short_piece_first():
    assert packing.cut(5, 4) == [(0, 1), (1, 5)] and packing.cut(8, 4) == [(0, 4), (4, 8)] and packing.cut(3, 4) == [(0, 3)] and packing.cut(4, 4) == [(0, 4)]


def test_best_fit_takes_the_fullest_bin_that_has_room():
    assert packing.best_fit([4, 6, 3, 7, 5, 5], 10) == [[3, 2], [1, 0], [4, 5]]
    rng = random.Random(3)
    sizes = [rng.randrange(1, 100) for _ in range(3000)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(k for b in bins for k in b) == list(range(3000)) and all(sum(sizes[k] for k in b) <= 100 for b in bins)
    assert len(bins) <= 1.02 * -(-sum(sizes) // 100)


@pytest.mark.parametrize("carry", [50_000, 2])
def test_packing_holds_every_piece_once(spark, tokenizer, odd, empty, carry):
    rng = random.Random(4)
    more = spark.createDataFrame([(100 + k, "word " * rng.randrange(60)) for k in range(80)], "doc_id long, text string").repartition(5)
    docs = odd.select("doc_id", "text").unionByName(more)
    got = packing.pack(docs, capacity=64, carry=carry, fan_in=2).collect()
    want = []
    for r in docs.collect():
        own = ids(tokenizer, r["text"], 2)
        want += [(r["doc_id"] or -1, p, a, b - a, zlib.crc32(own[a:b].tobytes())) for p, (a, b) in enumerate(packing.cut(len(own), 64))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert len({(r["row"], r["piece"]) for r in got}) == len(got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    if carry > 2:
        assert len(bins) <= 1.05 * -(-sum(r["length"] for r in got) // 64)
    assert packing.pack(empty).count() == 0


def test_bins_beyond_carry_meet_in_later_rounds(spark):
    """Far more underfull bins than a group may carry: as good a packing as in one group, since none leaves for being one too many."""
    rng = random.Random(6)
    texts = [(k, "word " * rng.choice([33, 34, 36, 40, 44, 48])) for k in range(150)] + [(500 + k, "word " * rng.randrange(8, 24)) for k in range(150)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(12).cache()
    sequences = [packing.pack(docs, capacity=64, carry=carry, fan_in=4).select("sequence_id").distinct().count() for carry in (50_000, 20)]
    assert sequences[1] <= 1.03 * sequences[0]


def test_special_tokens_are_what_the_library_makes_of_them(spark, tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n<|endoftext|> y", "a <|endoftext| b"]
    enc = Encoder(default_path())
    assert enc.ids(enc.encode(texts)[0]).tolist() == [64, 220, 50256, 275]
    assert [enc.ids(r).tolist() for r in enc.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.read(token_files.write(df)).collect()}
    assert got == {k: (len(x := ids(tokenizer, t, 0)), zlib.crc32(x.tobytes())) for k, t in enumerate(texts)}
