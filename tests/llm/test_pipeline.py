import corpus_pipeline
from chatlake.llm import bpe, common, decontaminate, quality, simhash, suffixes
from chatlake.llm.catalog import load


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    scores = {r.doc_id: r.predicted for r in quality.op8(spark, sf_dir).collect()}
    left = {i for i in rows if scores[i] == 1}
    kept = spark.createDataFrame([(i, rows[i]) for i in left], "doc_id long, text string")
    left = {r.doc_id for r in simhash.near_duplicates(kept).collect() if r.doc_id == r.component_id}
    kept = spark.createDataFrame([(i, rows[i]) for i in left], "doc_id long, text string")
    texts = {r.doc_id: bytes(r.text).decode("utf-8", "ignore") for r in suffixes.cut_repeats(kept).collect()}
    blocks = decontaminate.load(common.table(spark, sf_dir, "benchmark"))
    dirty = {list(texts)[r[0]] for b in blocks for r in b.search(list(texts.values()))}
    assert {i: r.text for i, r in out.items()} == {i: t for i, t in texts.items() if i not in dirty}
    memo = bpe.memo(bpe.public_tokenizers.path(bpe.RANKS), bpe.public_tokenizers.PATTERN)
    assert all(bytes(r.ids) == memo.encode([r.text])[0] and r.n_tokens == len(r.ids) // 4 for r in out.values())


def test_one_query_for_each_operator():
    names = [n for n in load()[0] if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def test_rows_that_share_an_id(spark):
    line = "one long passage that every one of these rows has, word for word, and more"
    rows = [(1, f"{line} first"), (2, f"zeta eta {line} second"), (2, f"theta iota {line} third"), (2, f"theta iota {line} third")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = suffixes.stage(spark, docs, "").collect()
    assert sorted(r.text for r in left) == sorted([f"{line} first", "zeta eta second", "theta iota third", "theta iota third"])
    assert all(r.n_chars == len(r.text) for r in left)
    kept = sorted(r.text for r in simhash.stage(spark, docs, "").collect())
    assert kept == sorted({t for _, t in rows})
