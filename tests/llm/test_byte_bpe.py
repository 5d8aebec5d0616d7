"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from trustlake.llm import byte_bpe
from trustlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


DECODERS = {}


def encoder_of(ranks):
    encoder = byte_bpe.Encoder(ranks, byte_bpe.spelled(ranks.pattern, 0xFFFF), byte_bpe.spelled(ranks.pattern))
    DECODERS[encoder] = byte_bpe.Decoder(ranks)
    return encoder


@pytest.fixture(scope="module")
def encoder():
    return encoder_of(RANKS)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding(
        "own", pat_str=RANKS.pattern, mergeable_ranks=encoder.merger.rank, special_tokens={}
    )


def same(encoder, library, texts):
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:99]
        assert DECODERS[encoder].decode(ids) == text.encode()


def test_random_texts(encoder, library):
    rnd = random.Random(3)
    wide = [*map(chr, range(1, 400)), " ", "　", "中", "😀", "𐐀", "٠", "²", "Ω"]
    for letters, longest, count in ((wide, 40, 3000), ("ab '\n\tst", 200, 500), ("anthe", 1500, 60), ("a", 900, 50)):
        same(encoder, library, ["".join(rnd.choices(letters, k=rnd.randint(0, longest))) for _ in range(count)])


def test_every_kind_of_character(encoder, library):
    chars = [chr(c) for c in range(0, 0x110000, 11) if not 0xD800 <= c < 0xE000]
    same(encoder, library, [f"x{c} {c}{c}'s" for c in chars])


def test_long_pieces(encoder, library):
    rnd = random.Random(5)
    same(encoder, library, ["".join(rnd.choices("acgt", k=60_000)), "ab" * 40_000, " " * 5000, "\n" * 5001])


def test_blocks_and_forgetting(encoder, library, monkeypatch):
    for name, value in (("BLOCK", 50), ("HELD", 20), ("REMEMBERED", 30), ("SHORT", 4)):
        monkeypatch.setattr(byte_bpe, name, value)
    same(encoder, library, ["the quick brown foxes jumped " * 9, "", "a" * 300, "antidisestablishment " * 8])


def test_every_token_is_its_own_merge(encoder):
    tokens = [t for t in RANKS.tokens if t]
    assert [int.from_bytes(x, "little") for x in encoder.merger.merge(tokens)] == [
        encoder.merger.rank[t] for t in tokens
    ]


def test_ranks_out_of_order_are_refused():
    tokens = tuple(bytes([b]) for b in range(256)) + (b"bc", b"abc", b"ab")
    merger = byte_bpe.Merger(tokens)
    assert merger.merge([b"abc", b""]) == [(257).to_bytes(4, "little"), b""]
    with pytest.raises(ValueError, match="order"):
        byte_bpe.Merger(tokens[:256] + (b"abc", b"ab")).merge([b"xabc"])


def test_other_rank_file(library):
    ranks = byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    other = encoder_of(ranks)
    theirs = tiktoken.Encoding("multi", pat_str=ranks.pattern, mergeable_ranks=other.merger.rank, special_tokens={})
    same(other, theirs, ["Über die Brücke gehen, naïve façade", "据说 12345 это слово", "  \t x"])


def test_query(spark, rows, library):
    found = {r.doc_id: r for r in QUERIES["op13_byte_bpe"](spark, SF).collect()}
    want = rows("select doc_id, text from documents")
    assert len(found) == len(want)
    for doc_id, text in want:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        r = found[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_edges(spark, edges, nothing, library):
    encoded = byte_bpe.encode(edges, RANKS)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    decoded = byte_bpe.decode(encoded.selectExpr("*", "'y' as decoded", "doc_id as ids_of"), RANKS)
    assert decoded.columns == ["doc_id", "n_tokens", "ids_of", "decoded"]
    found = sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in decoded.collect())
    want = sorted(
        (r.doc_id or 0, len(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in edges.collect()
    )
    assert found == want
    assert byte_bpe.decode(byte_bpe.encode(nothing, RANKS), RANKS).collect() == []
    unknown = spark.createDataFrame([(1, b"\xff\xff\xff\x00")], "doc_id long, ids binary")
    with pytest.raises(Exception, match="no token has id 16777215"):
        byte_bpe.decode(unknown, RANKS).collect()
    assert byte_bpe.decode(unknown.selectExpr("doc_id", "null ids"), RANKS).first().decoded == b""
