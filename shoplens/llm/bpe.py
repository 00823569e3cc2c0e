"""Byte-level BPE: encode whole texts to ids and decode ids to bytes.

A rank file becomes a ``tokenizers`` BPE model over the byte alphabet: each
byte stands for one printable character, and a token's merges are all the
ways to cut it into two known tokens, in rank order. Texts are cut by the
pre-token pattern, each distinct pre-token is mapped byte by byte into that
alphabet and merged by the model, and its ids are kept in a bounded memo of
the Python worker, so that frequent words cost one lookup. Nothing depends on
other rows, so there is no shuffle; a lost task runs again alone.

Rows: a null text counts as empty (no ids). Repeated rows, ties and empty
tables need no care. Output columns replace input columns of the same name.
Very long texts are handled whole; only a worker's batch grows with them.
"""

from __future__ import annotations

import base64
import codecs
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from .common import others, slices, text_input, with_fields

#: Distinct pre-tokens a worker remembers before it starts anew (bounds its memory; results do not depend on it).
MEMO = 600_000


def byte_alphabet() -> list[str]:
    """The 256 characters that stand for the bytes: printable ones stand for themselves, the rest for 256, 257, ..."""
    spare = iter(range(256, 512))
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def latin_finder(pattern: str) -> Callable[[bytes], list[bytes]] | None:
    """The pattern's ``findall`` over Latin-1 bytes, with its classes spelled out for those 256 characters (a third of
    the time of the general one); none if it uses other classes than letter, number and space."""
    def spelled(*majors: str) -> str:
        return "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] in majors)

    inside = {r"\p{L}": spelled("L"), r"\p{N}": spelled("N"), r"\s": r"\t-\r \x85\xa0"}
    known = "|".join(map(re.escape, inside))
    if re.search(r"\\", re.sub(rf"{known}|\\S", "", pattern)):
        return None
    out = re.sub(rf"\[\^(?:{known})+\]", lambda m: "[^" + "".join(
        inside[x] for x in re.findall(known, m.group())) + "]", pattern)
    out = re.sub(rf"(?<!\[\^)(?:{re.escape(chr(92))}p\{{[LN]\}}|{re.escape(chr(92))}s)", lambda m: f"[{inside[m.group()]}]", out)
    return re.compile(out.replace(r"\S", f"[^{inside[chr(92) + 's']}]").encode("latin-1")).findall


class Memo(dict):
    """Packed ids by pre-token, made on first use; it starts anew when full."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str | bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        tokens = self.codec.tokens(word)
        ids = self[word] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids


class Codec:
    """One vocabulary in one Python worker."""

    def __init__(self, model: models.BPE, table: list[bytes], pattern: str, added: dict[str, int] | None = None):
        self.model, self.table = model, table
        self.added = added or {}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.find = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.latin = latin_finder(pattern)
        self.alphabet = "".join(byte_alphabet())
        self.memo = Memo(self)

    def tokens(self, word: str | bytes):
        """Tokens of a pre-token (bytes are Latin-1)."""
        if isinstance(word, bytes):
            word = word if word.isascii() else word.decode("latin-1").encode()
        else:
            word = word.encode()
        return self.model.tokenize(codecs.charmap_decode(word, "strict", self.alphabet)[0])

    def words(self, text: str) -> list[str] | list[bytes]:
        """The pre-tokens, as Latin-1 bytes if the whole text can be."""
        if self.latin is not None:
            try:
                return self.latin(text.encode("latin-1"))
            except UnicodeEncodeError:
                pass
        return self.find(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.marks is None or not any(mark in text for mark in self.added):
            return b"".join(map(self.memo.__getitem__, self.words(text)))
        out, at = [], 0
        for m in self.marks.finditer(text):                 # what stands between added tokens is encoded on its own
            out += [*map(self.memo.__getitem__, self.words(text[at:m.start()])), struct.pack("<I", self.added[m.group()])]
            at = m.end()
        return b"".join([*out, *map(self.memo.__getitem__, self.words(text[at:]))])

    def offsets(self, text: str) -> tuple[list[int], list[int]]:
        """First and end code point of each token; a token that holds part of a character covers the whole of it."""
        starts, ends = [], []
        for m in self.spans(text):
            word, first = m.group(), m.start()
            chars = np.repeat(np.arange(len(word)), [len(c.encode()) for c in word])
            at = 0
            for t in self.tokens(word):
                n = len(self.table[t.id])
                starts.append(first + int(chars[at]))
                ends.append(first + int(chars[at + n - 1]) + 1)
                at += n
        return starts, ends

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens in a row; a character split over tokens is whole again once they are joined."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def rank_codec(path: str, pattern: str) -> Codec:
    """Codec of a rank file (lines of base64 bytes and rank)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    names = byte_alphabet()
    spell = {b: "".join(names[x] for x in b) for b in ranks}
    merges = []
    for whole in sorted(ranks, key=ranks.get):
        cuts = [(whole[:i], whole[i:]) for i in range(1, len(whole))]
        known = [(a, b) for a, b in cuts if a in ranks and b in ranks]
        known.sort(key=lambda p: (ranks[p[0]], ranks[p[1]]))
        merges += [(spell[a], spell[b]) for a, b in known]
    model = models.BPE(vocab={spell[b]: r for b, r in ranks.items()}, merges=merges, ignore_merges=True)
    table = [b""] * (max(ranks.values()) + 1)
    for b, r in ranks.items():
        table[r] = b
    return Codec(model, table, pattern)


@lru_cache(maxsize=4)
def json_codec(path: str, pattern: str) -> Codec:
    """Codec of a byte-level BPE saved by the ``tokenizers`` library; its added tokens are one id each wherever their
    string stands, as the library has it."""
    whole = Tokenizer.from_file(path)
    code = {c: b for b, c in enumerate(byte_alphabet())}
    added = {}
    for i, token in whole.get_added_tokens_decoder().items():
        if token.single_word or token.lstrip or token.rstrip:
            raise ValueError(f"added token {token.content!r} takes in its surroundings, which is not supported")
        added[token.content] = i
    vocab = whole.get_vocab(with_added_tokens=False)
    table = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in vocab.items():
        if all(c in code for c in token):
            table[i] = bytes(code[c] for c in token)
    for token, i in added.items():
        table[i] = token.encode()
    return Codec(whole.model, table, pattern, added)


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", decoded: bool = False,
           offsets: bool = False, keep_text: bool = True) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit), and on demand ``decoded`` (the ids' bytes again) and
    ``starts``/``ends`` (code points of each token). ``ranks`` is a path that every executor can open."""
    new: dict[str, T.DataType] = {"ids": T.BinaryType()}
    if decoded:
        new["decoded"] = T.BinaryType()
    if offsets:
        new |= {"starts": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType())}
    src, names, column = text_input(df, text, list(new), keep_text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = rank_codec(ranks, pattern)
        for batch in batches:
            for pdf in slices(batch, column):
                texts = [x or "" for x in pdf[column]]
                made = pdf[names].copy()
                made["ids"] = [codec.encode(x) for x in texts]
                if decoded:
                    made["decoded"] = [codec.decode(x) for x in made["ids"]]
                if offsets:
                    spans = [codec.offsets(x) for x in texts]
                    made["starts"] = [s for s, _ in spans]
                    made["ends"] = [e for _, e in spans]
                yield made

    return src.mapInPandas(run, with_fields(df, names, new))


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary) to a table of packed ids (null: empty)."""
    src = df.select(*others(df, ["decoded"]))
    names = src.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = rank_codec(ranks, pattern)
        for batch in batches:
            for pdf in slices(batch, ids):
                made = pdf[names].copy()
                made["decoded"] = [codec.decode(x or b"") for x in pdf[ids]]
                yield made

    return src.mapInPandas(run, with_fields(df, names, {"decoded": T.BinaryType()}))


def decoded_text(column: str = "decoded"):
    """Text of decoded bytes; bytes that are no whole character (ids cut out of their text) become U+FFFD."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def fingerprints(encoded: DataFrame, key: str) -> DataFrame:
    """Token counts and digests of a table with ``ids`` and ``decoded``."""
    return encoded.select(F.col(key), (F.length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
