import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bpe
from tessera.llm.queries import tokenizer_path

ALPHABET = [" ", "\n", "\t", "a", "b", "é", "日", "🙂", "'s", "t", "12", ".", ",", "<|endoftext|>", "́", "\x1c", "\x85", "　", "В", "²"]


def expected(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = t.encode(text or "", add_special_tokens=False).ids
    return np.asarray(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("bits", [3, 6, 9])
def test_chunks_and_joins_give_the_library_s_ids(bits):
    rng = random.Random(bits)
    texts = ["", " ", "a", "x" * 4000, "a b " * 2000, " " * 3000 + "z", "<|endoftext|> a<|endoftext|>b"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 800))) for _ in range(60)]
    e = bpe.ChunkEncoder(tokenizer_path(), chunk_bits=bits)
    for text, got in zip(texts, e.encode_all(pa.array(texts)), strict=True):
        assert got == expected(text)[0], text[:80]


def test_shared_chunks_are_encoded_once():
    e = bpe.ChunkEncoder(tokenizer_path(), chunk_bits=5)
    body = " ".join(f"word{i}" for i in range(3000))
    e.encode_all(pa.array([body]))
    before = e.encoded
    e.encode_all(pa.array(["Another start here. " + body]))
    assert e.encoded - before < 0.05 * before


def test_operator_and_edge_rows(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, "null id"), (2, None), (3, ""), (4, "a<|endoftext|>b " * 500)]
    df = spark.createDataFrame([(a, b, "clash", 9) for a, b in rows], "doc_id long, text string, ids string, near__ int")
    for got in (bpe.encode(df, tokenizer_path(), decoded=True), bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path())):
        got = sorted((r.doc_id or -1, bytes(r.ids), r.text) for r in got.collect())
        assert got == sorted((a or -1, *expected(b)) for a, b in rows)
    assert bpe.token_ids(bpe.encode(df.where("doc_id = 1"), tokenizer_path())).first().token_ids == [15496, 995]
    assert bpe.encode(df.limit(0), tokenizer_path()).count() == 0
