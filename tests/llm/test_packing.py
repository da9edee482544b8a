import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from clewline.llm import packing, vocab

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocab.public_path(packing.VOCABULARY))


def check(docs, pieces, library, window):
    """Pieces give every document's ids back and fill sequences without a gap."""
    ids = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for d, t in docs.items()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length == len(part) > 0
        assert p.ids_crc32 == zlib.crc32(part.tobytes())
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    short = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short += at < window
    assert short <= 1 and set(by_sequence) == set(range(len(by_sequence)))


def test_given_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    check(docs, packing.op8(spark, folder).collect(), library, packing.WINDOW)


def test_odd_texts(frame, library):
    docs = dict(enumerate([None, "", " ", "a  b\n\n c \t d", "x<|endoftext|>y", "word " * 3000, "  　x", "don't  stop'S", "é́ ñ 日本", "\n", "tail  "]))
    check(docs, packing.pack(frame(list(docs.items()), SCHEMA), window=16).collect(), library, 16)


def test_repeated_and_null_ids_stay(frame):
    got = packing.pack(frame([(1, "a b"), (1, "a b"), (None, "c")], SCHEMA), window=4).collect()
    assert sum(p.length for p in got) == 3 + 3 + 2 and {p.doc_id for p in got} == {1, None}


def test_empty_table_and_other_columns(frame):
    df = frame([(1, "a", 5)], SCHEMA + ", start int")
    assert [(p.doc_id, p.start) for p in packing.pack(df).collect()] == [(1, 0)]
    assert packing.pack(df.where("false")).collect() == []
