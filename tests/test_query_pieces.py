"""Only pieces that may be more than words are classified; words keep their order."""

from pyspark.sql import functions as F

from chatlake.operators import querytable


def test_plain_words_are_not_classified_and_keep_their_place(spark):
    said = 'one x:y two -no "a phrase" has:foo three : from:me four'
    rows = spark.createDataFrame([(1, said), (2, "just some words"), (3, None), (4, "")], "query_id long, text string")
    pieces = F.regexp_extract_all("text", F.lit(querytable.PIECE), F.lit(0))
    found = rows.select(F.size(querytable._numbered(pieces, querytable._special)).alias("n")).collect()
    assert [r["n"] for r in found[:2]] == [6, 0]
    parsed = {r["query_id"]: r for r in querytable.parse(rows).collect()}
    assert parsed[1]["words"] == ["one", "x:y", "two", "has:foo", "three", ":", "four"]
    assert (parsed[1]["excluded"], parsed[1]["phrases"], parsed[1]["from_vals"]) == (["no"], ["a phrase"], ["me"])
    assert parsed[2]["words"] == ["just", "some", "words"] and parsed[3]["words"] is None and parsed[4]["words"] == []
