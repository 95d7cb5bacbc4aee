import random

import pytest
import tiktoken

from coterie.llm import tokenise as t

ENC = t.encoder(t.VOCABULARY)
REF = tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})
ALPHABET = "ab  \n\t.,!'sté字🙂ह​0123<|>endoftx"


@pytest.mark.parametrize("seed", range(20))
def test_equals_reference_on_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(50):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60)))
        assert ENC.encode(s) == REF.encode_ordinary(s)


@pytest.mark.parametrize("text", ["", None, " ", "<|endoftext|>", "a" * 20_000, "ab" * 5_000, " " * 3_000, "字" * 2_000, "x1" * 3_000])
def test_equals_reference_on_edge_cases(text):
    assert ENC.encode(text) == REF.encode_ordinary(text or "")


def test_round_trip():
    s = "Ünï çødé — 🙂\n\n  naïve   text\x00"
    assert REF.decode(ENC.encode(s)) == s


def test_memory_of_pieces_is_bounded():
    small = t.Encoder(ENC.ranks, remember=3)
    for w in "alpha beta gamma delta epsilon zeta".split():
        small.encode(w)
    assert len(small.known) <= 3


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "<|endoftext|>", None)], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in t.encode_texts(df).collect())
    assert got == [(1, tuple(REF.encode_ordinary("hello world"))), (2, ()), (3, ()), (3, ()), (4, tuple(REF.encode_ordinary("<|endoftext|>")))]
    assert t.encode_texts(df.limit(0)).collect() == []
