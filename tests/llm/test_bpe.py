import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clewline.llm import bpe, vocab

NAME = bpe.VOCABULARY


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocab.public_path(NAME))


def agree(library, texts):
    ids = bpe.encode_array(NAME, pa.array(texts))
    decoded = bpe.decode_array(NAME, ids).to_pylist()
    for text, own, back, want in zip(texts, ids.to_pylist(), decoded, library.encode_batch(texts, add_special_tokens=False)):
        assert own == want.ids, text
        assert back == library.decode(want.ids, skip_special_tokens=False), text


def test_known_texts(library):
    agree(library, ["", "  \n", "Hello <|endoftext|> World's don't I'LL", "ΣΑΣ ΟΔΟΣ", "İstanbul ß", "a\x1cb\x1dc", "x̧̀ é", "日本語 12345 ¼½",
                    "<|startoftext|>x<|endoftext|>y", "'s't'RE'x", "a" * 5000, "thethe" * 300, "🤦🏼‍♂️!!!???", " a　b", "<|EndOfText|>"])


def test_random_letters(library):
    rnd = random.Random(3)
    agree(library, ["".join(rnd.choice("abcdeinth'ersSQ é0,.") for _ in range(rnd.randint(1, 80))) for _ in range(3000)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_any_latin_text(library, texts):
    agree(library, texts)


def test_given_documents(library, spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    agree(library, texts)


def test_columns(frame):
    df = frame([(1, None, "x"), (2, "", "y"), (3, "The cat", "z"), (3, "The cat", "z")], "doc_id bigint, text string, ids string")
    got = {(r.doc_id, tuple(r.found), r.back, r.ids) for r in df.withColumn("found", bpe.encode(F.col("text"))).withColumn("back", bpe.decode(F.col("found"))).collect()}
    assert got == {(1, (), "", "x"), (2, (), "", "y"), (3, (518, 2368), "the</w> cat</w>", "z")}
    assert df.where("false").select(bpe.encode(F.col("text"))).collect() == []


def test_decode_leaves_out_unknown_ids(frame):
    df = frame([([518, None, -1, 10**6, 2368],), (None,), ([],)], "ids array<int>")
    assert sorted(r[0] for r in df.select(bpe.decode(F.col("ids"))).collect()) == ["", "", "the</w> cat</w>"]


def test_query(spark, library):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in entry.queries()["op1_bpe_backtracking"](spark, folder).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
