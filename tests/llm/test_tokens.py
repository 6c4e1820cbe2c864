from __future__ import annotations

import random
import zlib
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import packing, token_files
from corpusloom.llm.queries import tokenizer_file
from corpusloom.llm.tokens import Encoder
from corpusloom.runtime import scratch_path
from tests.llm import cases

BYTES, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
ENCODERS = [Encoder(BYTES, False, cuts=50, pieces=20), Encoder(WORDS, True, cuts=50, pieces=20)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab AB'.,\n\t  \x85éßİ12½<|>_日", max_size=40)))
def test_cuts_give_the_ids_of_the_whole_text(text):
    text = text.encode("utf-8", "ignore").decode()
    for encoder in ENCODERS:
        assert encoder.ids(text) == encoder.whole(text)


def test_ids_are_those_of_the_file_with_added_tokens_in_the_text():
    texts = ["plain words", "<|endoftext|>", "one <|endoftext|> two", "a<|startoftext|>b <|endoftext|>", "A <|STARTOFTEXT|>\nb  <|EndOfText|> ", "<|endoftext|", "x\n<|endoftext|>\n\n<|startoftext|> y"]
    for path, encoder in zip((BYTES, WORDS), ENCODERS, strict=True):
        fresh = Tokenizer.from_file(path)
        for text in texts:
            assert list(array("I", encoder.ids(text))) == fresh.encode(text, add_special_tokens=False).ids, text
    assert 50256 in array("I", ENCODERS[0].ids("one <|endoftext|> two"))


def test_token_files_round_trip(spark):
    docs = cases.documents(spark)
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(docs, folder, BYTES, shards=3)
    got = [tuple(r) for r in token_files.digests(token_files.read_token_files(spark, folder)).orderBy("start").collect()]
    ordered = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc_id, text, *_ in ordered:
        data = ENCODERS[0].whole(text or "") + array("I", [0]).tobytes()
        want.append((doc_id, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert got == want


def test_token_files_of_an_empty_table(spark):
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(cases.empty(spark), folder, BYTES)
    assert token_files.read_token_files(spark, folder).count() == 0


@pytest.mark.parametrize("window", [16, 2048])
def test_packing_places_every_id_once(spark, window):
    docs = cases.documents(spark)
    pieces = packing.cut_documents(docs, WORDS, window=window).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens").cache()
    got = packing.pack(pieces, window).collect()
    want, whole = [], {}
    for doc_id, text, *_ in cases.rows():
        data = ENCODERS[1].whole(text or "") + array("I", [1]).tobytes()
        n = len(data) // 4
        want += [(doc_id, a, min(window, n - a), zlib.crc32(data[4 * a : 4 * (a + window)]), n) for a in range(0, n, window)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    total = sum(r["length"] for r in got)
    assert len(whole) <= total / window * 1.15 + 2


def test_packing_of_an_empty_table(spark):
    pieces = packing.cut_documents(cases.empty(spark), WORDS).drop("ids")
    assert packing.pack(pieces).count() == 0


def test_fullest_is_the_best_sum():
    rng = random.Random(3)
    for _ in range(200):
        room = rng.randrange(1, 40)
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        sums = {0}
        for length, n in counts.items():
            sums |= {s + length * k for s in sums for k in range(n + 1)}
        used = packing.fullest(counts, room)
        assert all(used[k] <= counts[k] for k in used)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_length():
    rng = random.Random(4)
    counts = {n: rng.randrange(1, 500) for n in range(1, 257)}
    done = dict.fromkeys(counts, 0)
    plan = packing.plan(counts, 256)
    for copies, used in plan:
        assert sum(k * n for k, n in used.items()) <= 256
        for k, n in used.items():
            done[k] += copies * n
    assert done == counts
    least = max(sum(k * n for k, n in counts.items()) / 256, sum(n for k, n in counts.items() if k > 128))
    assert sum(c for c, _ in plan) <= least * 1.02 + 1
