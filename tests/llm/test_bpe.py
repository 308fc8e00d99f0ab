import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessella.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGE = ["", None, "<|endoftext|> it's", " " * 5000, "a" * 20_000, "ab" * 9_000, "é日本語\u0000\x1f  \U0001f600", "x\ty\r\n\n z", "x"]


@pytest.fixture(scope="module")
def pair():
    own = bpe.tokenizer(PATH, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_equals_the_library(pair):
    own, lib = pair
    rnd = random.Random(5)
    sets = ["aetnorsi", "ab", "0123456789", "éàü ñ", "{}();=\n\t ", "日本語한글", "the of and ing "]
    texts = [t or "" for t in EDGE] + ["".join(rnd.choice(rnd.choice(sets)) for _ in range(rnd.randint(0, 90))) for _ in range(4000)]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_table(spark, pair):
    rows = [(i, t, 7) for i, t in enumerate(EDGE)] + [(8, "x", 8), (None, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = pair[1].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(docs.where("false"), PATH).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
