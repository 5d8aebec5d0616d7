import os
import random

import pytest
from tokenizers import Tokenizer, models

from trustlake.llm.token_count import SPACE, VOCABULARY, Counter, Vocabulary, count_tokens, load

BYTES = [(f"<0x{i:02X}>", 0.0) for i in range(256)]


def library(vocabulary):
    pieces = [("<unk>", 0.0), *(BYTES if vocabulary.byte_fallback else []), *vocabulary.pieces]
    return Tokenizer(models.Unigram(pieces, 0, vocabulary.byte_fallback))


def tokens(tokenizer, text):
    return len(tokenizer.encode(SPACE + text.replace(" ", SPACE)).ids) if text else 0


@pytest.mark.parametrize("seed", range(60))
def test_random_vocabularies(seed):
    rng = random.Random(seed)
    letters = "abc" + SPACE
    pieces = {"".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(12)}
    vocabulary = Vocabulary(tuple((p, float(-rng.randint(1, 5))) for p in sorted(pieces)), seed % 2 == 0)
    counter, tokenizer = Counter(vocabulary), library(vocabulary)
    for _ in range(25):
        text = "".join(rng.choices("abcdé \n", k=rng.randint(0, 20)))
        assert counter.count(text)[0] == tokens(tokenizer, text), (vocabulary, text)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_documents(spark, rows):
    vocabulary = load(VOCABULARY)
    tokenizer = library(vocabulary)
    texts = dict(rows("select doc_id, text from documents"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, vocabulary).collect()}
    assert got == {d: tokens(tokenizer, t) for d, t in texts.items()}


def test_score_is_the_best():
    vocabulary = Vocabulary(((SPACE, -1.0), ("a", -2.0), ("aa", -3.0), ("b", -1.5)), False)
    assert Counter(vocabulary).count("aab") == (3, -5.5)
    assert Counter(vocabulary).count("a?b")[0] == 4


def test_edges(spark, edges, nothing):
    vocabulary = Vocabulary(((SPACE, -1.0), ("one", -2.0), ("two", -3.0)), True)
    rows = count_tokens(edges, vocabulary).collect()
    assert len(rows) == edges.count()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5)} == {4}
    assert count_tokens(nothing, vocabulary).collect() == []
