"""Ids of texts that spell out an added token are those of the unmodified library."""

import zlib

import numpy as np
import pytest

from promptlake.llm import packing, token_files
from promptlake.llm.tokens import encoder

TEXTS = ["<|endoftext|> x", "a<|endoftext|>", "one <|startoftext|>two<|endoftext|>", "<|EndOfText|> up", "<|endoftext |>", "plain text", "日本<|endoftext|>語", "<|endoftext|>" * 3, ""]


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path


def plain_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids(tokenizer, name):
    path = tokenizer(name)
    assert encoder(path, added=True).encode(TEXTS) == [np.array(plain_ids(path, t), dtype="<u4").tobytes() for t in TEXTS]


def test_token_files_and_packing(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    path = tokenizer("word_bpe_49k.json")
    token_files.write(docs, f"{tmp_path}/f", path)
    at = 0
    got = {r["doc_id"]: r for r in token_files.digests(token_files.read(spark, f"{tmp_path}/f")).collect()}
    for i, t in enumerate(TEXTS):
        ids = plain_ids(path, t)
        ids = np.array([*ids, 1], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = tokenizer("byte_bpe_50k.json")
    length = {r["doc_id"]: r["length"] for r in packing.pack(docs, path).collect()}
    assert length == {i: len(plain_ids(path, t)) + 1 for i, t in enumerate(TEXTS)}
