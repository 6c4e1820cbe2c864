from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from corpusloom.llm import alignment
from corpusloom.llm.queries import tokenizer_file
from tests.llm import cases

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
PARTS = ["<|endoftext|>", "<s>", "▁", "  ", "\n", "\n\n", " the", " of", "Ab", "é", "́", "日本", "　", "\t", "\x00", "ﬁ", "😀", "'s", "1", "23", ".", ",", " ", "x", "\r", "\x85", "​", "ª"]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = {chr(c): k for k, c in ({k: k for k in range(256)} | alignment.BYTE_CHARS).items()}

    def ranges(text):
        """(id, first byte, end) of the tokens of both kinds, by the libraries on the whole text; [] where bytes differ."""
        if not text:
            return [], []
        out = []
        for ids, data in (
            (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(alphabet[c] for c in a.id_to_token(i))),
            (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
        ):
            at, each, joined = 0, [], b""
            for i in ids:
                each.append((i, at, at + len(data(i))))
                at += len(data(i))
                joined += data(i)
            if joined != (" " + text).encode():
                return [], []
            out.append(each)
        return out

    return ranges


def brute(texts):
    ranges = libraries()
    each = [ranges(t) for t in texts]
    pairs = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in each]
    count = Counter(p for some in pairs for p in some)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (a, b), some in zip(each, pairs, strict=True):
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if before < x[2] <= end) for side in (a, b)))
            before = end
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(some), sum(count[p] == most[p[1]] for p in some), sum(count[p] for p in some), sha))
    return out


def texts():
    rng = random.Random(4)
    words = [r[1][:600] if r[1] else r[1] for r in cases.rows()]
    return words + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))) for _ in range(300)]


@pytest.mark.parametrize("common", [alignment.COMMON, 40])
def test_agrees_with_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    got = alignment.align(cases.plain(spark, texts()).repartition(3), A, B).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts())


def test_cuts_agree_with_whole_texts():
    ranges, aligner, rng = libraries(), alignment.Aligner(A, B), random.Random(6)
    some = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 20))) for _ in range(3000)]
    for text, got in zip(some, aligner.documents(some), strict=True):
        a, b = ranges(text)
        assert got[:2] == (len(a), len(b)), repr(text)


def test_pointer_jumping_ends_in_each_groups_last_token():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(1, 200))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, size + 1), int(rng.integers(0, size)), replace=False)), size + 1) for _ in range(2))
        to_a, to_b = alignment.terminals(a, b)
        shared = np.intersect1d(a, b)
        assert (b[to_a] == shared[np.searchsorted(shared, a)]).all()
        assert (b[to_b] == shared[np.searchsorted(shared, b)]).all()


def test_awkward_rows_and_empty_table(spark):
    docs = cases.documents(spark)
    assert alignment.align(docs, A, B).count() == docs.count()
    assert alignment.align(cases.empty(spark), A, B).count() == 0
