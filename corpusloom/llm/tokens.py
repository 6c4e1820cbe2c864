"""Token ids of whole texts by a public tokenizer file, at a speed that whole corpora allow.

The library's merges stay inside the pieces that its pre-tokenizer makes, and neither tokenizer makes a piece that
reaches over the start of a word (with its leading blank). So a text is cut there, each distinct cut is encoded by
the library, and frequent cuts are remembered. A text with characters that the library may class otherwise than
Python is encoded whole, and so is one that holds the string of an added token, such as ``<|endoftext|>``: the ids
are those of the library with ``add_special_tokens=False``, which gives such a string the added token's id.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Entries of the memos of one task (about 250 bytes each). Cuts beyond them are encoded where they occur; the ids
#: don't change. A task's memos go with it: a worker's next task may be another operator's.
MEMO_CUTS = 400_000
MEMO_PIECES = 200_000

#: The pre-tokenizer's treatment of white space: runs give their last blank to the word behind them.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space other than blank and line end, and characters that the library may class otherwise than Python.
ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
#: Cuts of Latin letters, digits and signs without apostrophe, whose pieces need no Unicode tables.
PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+")
SINGLE_DIGITS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: How byte-level models write a byte: itself if it prints, else the next code point from 256.
SHOWN = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in SHOWN)}


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer, loaded once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: How byte-level models split plain cuts.
SPLIT = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


@lru_cache(maxsize=2)
def same_merges(path: str):
    """For a byte-level BPE whose ids are numbered as its merges: a faster encoder with the merges of the same file, for
    Latin letters, digits and common signs. Those need no Unicode tables to be split, so both give the same ids there.
    None for other models."""
    import json

    import tiktoken

    tokenizer = library(path)
    model = json.loads(tokenizer.to_str())["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get("".join(m)) != 256 + k for k, m in enumerate(merges)):
        return None
    byte_of = {chr(BYTE_CHARS.get(k, k)): k for k in range(256)}
    ranks = {bytes(byte_of[c] for c in tokenizer.id_to_token(i)): i for i in range(256 + len(merges))}
    return tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Memo(dict):
    """Encodes what is missing, and keeps it while there is room."""

    def __init__(self, encode, limit: int, prefix: str = ""):
        self.encode, self.limit, self.prefix = encode, limit, prefix

    def __missing__(self, key: str) -> bytes:
        value = self.encode(self.prefix + key)
        if len(self) < self.limit:
            self[key] = value
        return value


class Encoder:
    """ids(text) gives the ids as little-endian unsigned 32-bit integers.

    ``words``: for the tokenizer that drops white space and case, whose cuts are words; else the byte-level one,
    where a word keeps its leading blank.
    """

    def __init__(self, path: str, words: bool, cuts: int = MEMO_CUTS, pieces: int = MEMO_PIECES):
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        self.words = words
        self.fast = None if words else same_merges(path)
        # In lower case, since an added token may be sought in the normalised text.
        self.added = [token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = Memo(lambda c: c.encode().decode("latin-1").translate(BYTE_CHARS), 10_000)
        self.pieces = Memo(self.piece, pieces)
        self.plain = Memo(self.cut, cuts)
        self.spaced = Memo(self.cut, cuts, " ")
        self.line_end = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        if self.fast:
            return array("I", self.fast(piece)).tobytes()
        shown = "".join(map(self.shown.__getitem__, piece))
        return array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()

    def cut(self, cut: str) -> bytes:
        same = cut.lower() if self.words else cut
        found = SINGLE_DIGITS.findall(same) if self.words else PIECES.findall(same)
        if sum(map(len, found)) < len(same):
            return self.whole(cut)
        return b"".join(map(self.pieces.__getitem__, found))

    def ids(self, text: str) -> bytes:
        low = text.lower()
        if ODD.search(text) or any(token in low for token in self.added):
            return self.whole(text)
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        if self.words:
            return b"".join(map(plain, text.split()))
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace():
            return b"".join(map(plain, SPACED.findall(text)))
        if not text:
            return b""
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(plain(first) + b"".join(map(spaced, rest)))
        return self.line_end.join(lines)
