import numpy as np
import pytest
from tokenizers import Tokenizer

from weekcast.llm.bpe import TOKENIZER, Splitter, encode_decode
from weekcast.llm.tokens import byte_letters

ODD = [None, "", " ", "   ", "It's we'll 'stop ''x 12ab3 É!?'s", "<|endoftext|> a<|endoftext|><|endoftext|>b", "Σίσυφος  ΟΔΟΣ İstanbul", "é ﬁ   x\x1cy\x85z​",
       "漢字かな 🙂👍🏽", "a\x00b \x00", "tab\t\tand\r\n\r\n  new", "word " * 9000, "don't DON'T ÀÉ×÷ß ŸĀ ½ ²", "x" * 50000, "\n\n\n", "1234567 ٣٤", "<|endoftext|"]


def test_matches_the_library(docs_of, documents):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ODD + [r.text for r in documents.collect()]
    got = {r.doc_id: r for r in encode_decode(docs_of(texts).repartition(3).persist()).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, i
        assert got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False), i


def test_few_buckets(documents):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = encode_decode(documents, buckets=3).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == texts[r.doc_id] for r in rows)


def test_null_and_repeated_ids_and_empty(docs_of):
    rows = encode_decode(docs_of([(1, "a b"), (1, "a b"), (None, "c"), (None, None)])).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in rows) == [("1", "a b"), ("1", "a b"), ("None", ""), ("None", "c")]
    assert encode_decode(docs_of([])).collect() == []
    assert [r.decoded for r in encode_decode(docs_of([None, ""])).collect()] == ["", ""]


def test_letters_cover_every_byte():
    assert sorted(byte_letters().values()) == list(range(256))


def test_special_tokens_are_words():
    assert Splitter(TOKENIZER).words("a<|endoftext|> b") == ["a", "<|endoftext|>", " b"]


def test_readings_that_differ_raise(spark):
    from pyspark.sql import functions as F

    shaky = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.rand().cast("string") for _ in range(3)]).alias("text"))
    shaky = shaky.select("doc_id", F.udf(lambda t: __import__("uuid").uuid4().hex, "string").asNondeterministic()("text").alias("text"))
    with pytest.raises(Exception, match="two readings"):
        encode_decode(shaky).collect()


@pytest.mark.parametrize("kind", ["smallint", "tinyint", "int", "string"])
def test_ids_of_other_types(spark, kind):
    rows = encode_decode(spark.createDataFrame([(1, "one two"), (2, None), (None, "x")], "doc_id int, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text"))
    assert rows.schema["doc_id"].dataType.simpleString() == kind
    assert sorted((str(r.doc_id), r.decoded) for r in rows.collect()) == [("1", "one two"), ("2", ""), ("None", "x")]
