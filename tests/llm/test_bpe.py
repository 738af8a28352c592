import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlake.llm import bpe
from chatlake.llm.common import pair

PATH = public_tokenizers.path(bpe.RANKS)
CODER = tiktoken.Encoding(
    "own",
    pat_str=public_tokenizers.PATTERN,
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))},
    special_tokens={},
)


def ids(text):
    return np.array(CODER.encode_ordinary(text or ""), "<u4").tobytes()


def test_whole_texts_and_chunks_equal_the_library(spark, texts, docs):
    odd = [(100, "a" * 900 + " b" * 300), (101, "x  y\n\n z " * 200), (102, " " * 1500 + "it's'll ''ll" * 100), (103, "-" * 2000), (104, "\x1c\x1d a" * 300)]
    table = pair(docs).union(spark.createDataFrame(odd, "doc_id long, text string"))
    want = sorted((str(i), ids(t)) for i, t in [*texts, *odd])
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (200, 40)):
        got = bpe.encode(table, PATH, chunk=chunk, overlap=overlap).collect()
        assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
        assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in [*texts, *odd])


def test_empty_table(nothing):
    assert bpe.encode(pair(nothing), PATH).count() == 0


def test_query(spark, folder, texts):
    got = {r.doc_id: r for r in bpe.op1(spark, folder).collect()}
    for i, t in texts:
        assert got[i].n_tokens == len(ids(t)) // 4
        assert got[i].ids_sha256 == hashlib.sha256(ids(t)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab 1'\n\tl.,é\x1c ", max_size=40), max_size=5))
def test_pieces(some):
    assert bpe.memo(PATH, public_tokenizers.PATTERN).encode(some) == [ids(t) for t in some]


def test_pieces_that_are_forgotten_are_encoded_again(texts):
    some = [f"word{k} w{k % 7} the, end.\n\n x" for k in range(300)] + ["", " ", "a", " lead", "trail ", "a  b", "tab\t x"] + [t or "" for _, t in texts]
    coder = bpe.memo(PATH, public_tokenizers.PATTERN)
    small = bpe.PieceMemo(coder.encode_many, limit=10)
    for at in range(0, len(some), 5):
        part = some[at : at + 5]
        assert small.encode(part) == coder.encode(part) == [ids(t) for t in part]
    assert len(small.words) <= 10
