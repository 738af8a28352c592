import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from chatlake.llm import tokenfiles
from chatlake.llm.common import pair

PATH = public_tokenizers.path(tokenfiles.TOKENIZER)
CODER = Tokenizer.from_file(PATH)


def ids(text):
    return np.array([*CODER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def expected(texts):
    at, out = 0, []
    for i, t in sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        x = ids(t)
        out.append((str(i), at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    return sorted(out)


def test_files(spark, tmp_path, docs, texts, nothing):
    more = [(200 + k, t) for k, t in enumerate(["<|endoftext|> a <|endoftext|>", "a  b \n\n c", " lead", "trail "])]
    table = pair(docs).union(spark.createDataFrame(more, "doc_id long, text string"))
    tokenfiles.write(table, f"{tmp_path}/a", PATH, length=64)
    rows = tokenfiles.read(spark, f"{tmp_path}/a").collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in rows) == expected([*texts, *more])
    tokenfiles.write(pair(nothing), f"{tmp_path}/b", PATH)
    assert tokenfiles.read(spark, f"{tmp_path}/b").count() == 0


def test_random_access_copies_nothing():
    n = 70_000
    data = np.arange(n, dtype="<u2")
    lengths = [40_000, 1, 29_999]
    raw = tokenfiles.write_stream([5, None, 6], lengths, data, length=16) + b"\0"
    buffer = pa.py_buffer(raw)
    file = tokenfiles.TokenFile(buffer)
    assert len(file) == -(-n // 16)
    for k in (0, 511, 512, 4000, len(file) - 1):
        got = file.sequence(k)
        assert np.array_equal(got[: min(16, n - 16 * k)], data[16 * k : 16 * k + 16])
        assert buffer.address <= got.__array_interface__["data"][0] < buffer.address + buffer.size
    assert file.mask(len(file) - 1).sum() == n - 16 * (len(file) - 1) and file.mask(3).all()
    assert [(d, a, len(x)) for d, a, x in file.documents()] == [(5, 0, 40_000), (None, 40_000, 1), (6, 40_001, 29_999)]
