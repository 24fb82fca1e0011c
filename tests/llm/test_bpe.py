"""Encoding equals the public library's, pre-token by pre-token, and decodes exactly."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from cases import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from loomnote.llm import bpe, bytetext

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, cache_words=500)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def encode(codec, texts):
    out = []
    for chunk in bytetext.chunks(pa.array(texts, pa.string())):
        out += [[i for piece in doc for i in piece] for doc in codec.encode_chunk(chunk.data, chunk.starts)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" '\n\tstmdrevlLZ1²é中😀!.,  ́\x1c\x85", max_size=30), max_size=8))
def test_equals_library(codec, library, texts):
    assert encode(codec, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_boundaries_equal_the_pattern(texts):
    data = "".join(texts).encode()
    starts = np.cumsum([0] + [len(t.encode()) for t in texts])
    where, row = bpe.pre_tokens(np.frombuffer(data, np.uint8), starts)
    for i, text in enumerate(texts):
        cuts = [*where[row[i] : row[i + 1]].tolist(), starts[i + 1]]
        assert [data[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)] == regex.findall(public.PATTERN, text)


def test_composition_is_associative():
    _, table, values = bpe.monoid()
    rng = np.random.default_rng(1)
    f, g, h = rng.integers(0, len(table), (3, 500))
    assert (table[table[f, g], h] == table[f, table[g, h]]).all()
    assert all((values[table[a, b]] == values[b][values[a]]).all() for a, b in zip(f, g, strict=True))


def test_long_words(codec, library):
    for text in ("ab" * 3000, "x" * 5000, " " * 4000, "!?" * 2000 + "é" * 700):
        assert encode(codec, [text]) == [library.encode_ordinary(text)]


def test_round_trip(spark, docs, library):
    got = {}
    for r in bpe.round_trip(spark, docs(ODD), PATH).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    for i, text in ODD:
        ids = library.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())) in got[i]
    assert bpe.round_trip(spark, docs([]), PATH).count() == 0


def test_encode_and_decode(spark, docs, codec):
    rows = [(1, "It's 12 o'clock, é😀"), (2, None)]
    encoded = bpe.encode(spark, docs(rows), PATH)
    for r in encoded.collect():
        data = (dict(rows)[r.doc_id] or "").encode()
        edge = [*r.offsets, len(data)]
        assert [codec.of_id[i] for i in r.ids] == [data[a:b] for a, b in zip(edge, edge[1:], strict=False)]
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(spark, encoded, PATH).collect()} == {i: (t or "").encode() for i, t in rows}
