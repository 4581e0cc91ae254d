"""Encoding and decoding against the tokenizer's own library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from memspark.llm import byte_bpe
from memspark.llm.registered import RANKS

from .test_scalar_ops import ODD, frame, some_texts


def test_encode_and_decode(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = ODD + some_texts(30) + ["=" * 700 + " " * 900 + "x", "".join(r.choice("acgt") for _ in range(2000))]
    for own in (texts, [t for t in texts if not t or len(t) < 60]):
        got = {x.doc_id: x for x in byte_bpe.encode(frame(spark, own), RANKS, dictionary=30).collect()}
        assert len(got) == len(own)
        for i, t in enumerate(own):
            ids = lib.encode_ordinary(t or "")
            assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), repr(t)
            assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode(frame(spark, ["a"]).limit(0), RANKS).collect() == []
    twice = byte_bpe.encode(frame(spark, ["same row", "same row", None, None], [1, 1, None, None]), RANKS).collect()
    assert sorted((x.doc_id or 0, x.n_tokens) for x in twice) == [(0, 0), (0, 0), (1, len(lib.encode_ordinary("same row")))] + [(1, len(lib.encode_ordinary("same row")))]


def test_heap_is_exact():
    ranks = byte_bpe.load_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    for n in (1, 2, 3, 50, 600):
        for letters in ("ab", "the an", "aeiourst"):
            w = "".join(r.choice(letters.strip()) for _ in range(n)).encode()
            assert byte_bpe.merge_bytes(w.replace(b" ", b""), ranks) == lib.encode_ordinary(w.replace(b" ", b"").decode())
