"""Encoding against the tiktoken library, decoding by round trip."""

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoplens.llm import bpe
from shoplens.llm.bpe import json_codec, rank_codec

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@lru_cache
def tiktoken_library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def reference():
    return tiktoken_library()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abAB the 12\n\t'sñéß中文😀́.,!_\x1c\x85\r")), max_size=80))
def test_ids_equal_tiktoken(text):
    codec = rank_codec(RANKS, P.PATTERN)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tiktoken_library().encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_memo_limit_does_not_change_ids(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MEMO", 3)
    codec = bpe.rank_codec.__wrapped__(RANKS, P.PATTERN)
    text = "one two three four five one two six"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_json_vocabulary_equals_the_library():
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    codec = json_codec(P.path("byte_bpe_50k.json"), P.PATTERN)
    for text in ("", "hello  world\n\n x", "ñandú 中文😀", "<|endoftext|> a", " " * 40,
                 "a <|endoftext|> b", "<|endoftext|><|endoftext|>ñ 中<|endoftext|", "x<|endoftext|>\n\n y  <|endoftext|>"):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text.encode()


def test_offsets_cover_split_characters():
    codec = rank_codec(RANKS, P.PATTERN)
    text = "a 😀b 中"
    starts, ends = codec.offsets(text)
    assert len(starts) == len(codec.encode(text)) // 4
    assert min(starts) == 0 and max(ends) == len(text)
    assert all(a < b for a, b in zip(starts, ends))
    covered = {i for a, b in zip(starts, ends) for i in range(a, b)}
    assert covered == set(range(len(text)))


def test_rows(messy, no_docs, clashing, reference):
    out = bpe.encode(messy, RANKS, P.PATTERN, decoded=True, offsets=True)
    rows = out.collect()
    assert len(rows) == messy.count()
    for r in rows:
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
        assert len(r["starts"]) == len(r["ids"]) // 4
    again = bpe.decode(out.select("doc_id", "text", "ids"), RANKS, P.PATTERN).where(
        bpe.decoded_text() != F.coalesce("text", F.lit("")))
    assert again.count() == 0
    assert bpe.encode(no_docs, RANKS, P.PATTERN, decoded=True).count() == 0
    other = bpe.encode(clashing, RANKS, P.PATTERN, decoded=True)
    assert other.columns.count("ids") == 1 and other.columns.count("decoded") == 1
    assert sorted(bytes(r["ids"]) for r in other.collect()) == sorted(bytes(r["ids"]) for r in rows)


def test_digest_columns(messy):
    got = bpe.fingerprints(bpe.encode(messy.where("doc_id = 4"), RANKS, P.PATTERN, decoded=True), "doc_id").first()
    none = hashlib.sha256(b"").hexdigest()
    assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == (0, none, none)
