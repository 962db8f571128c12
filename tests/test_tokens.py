import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from blockloom.operators import tokens as T
from blockloom.plans.catalog import word_tokenizer_json
from blockloom.plans.prepare import pack_documents
from blockloom.schemas import SPECIALS

TEXTS = ["the cat, the dog.", "", "été 42!", "the  \n the\tunknownword", None, "<s> bos"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "train", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, split string, text string").repartition(3)


@pytest.fixture(scope="module")
def vocab(docs):
    return T.load_vocab(T.build_vocab(docs, 12))


def test_vocab_is_ranked_by_count_then_word(docs, vocab):
    rows = list(zip(vocab["token"].to_pylist(), vocab["id"].to_pylist()))
    assert dict(rows)["the"] == max(SPECIALS.values()) + 1
    assert sorted(i for _, i in rows) == list(range(5, 5 + len(rows)))
    ranked = T.build_vocab(docs, 3).orderBy("id").collect()
    # One count each after "é", so text order decides.
    assert [r["token"] for r in ranked] == ["the", "é", "!"]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_native_ids(docs, vocab):
    ids = dict(zip(vocab["token"].to_pylist(), vocab["id"].to_pylist()))
    got = by_id(T.tokenize(docs, vocab))
    assert "text" not in got[0]
    words = ["the", "cat", ",", "the", "dog", "."]
    assert got[0]["input_ids"] == [2, *[ids.get(w, 1) for w in words], 3]
    assert got[1]["input_ids"] == got[4]["input_ids"] == [2, 3]
    assert got[0]["special_tokens_mask"] == [1, 0, 0, 0, 0, 0, 0, 1]
    assert all(r["attention_mask"] == [1] * len(r["input_ids"]) for r in got.values())


def test_text_cannot_fake_special_tokens(docs, vocab):
    row = by_id(T.tokenize(docs, vocab))[5]
    assert row["special_tokens_mask"] == [1, 0, 0, 0, 0, 1]
    assert not set(row["input_ids"][1:-1]) & {0, 2, 3, 4}


def test_file_back_end_equals_native(docs, vocab):
    native = by_id(T.tokenize(docs, vocab))
    loaded = by_id(T.tokenize_with_file(docs, word_tokenizer_json(vocab)))
    assert {k: tuple(v)[2:] for k, v in native.items()} == {k: tuple(v)[2:] for k, v in loaded.items()}


def test_truncation_counts_specials(docs, vocab):
    full = by_id(T.tokenize(docs, vocab))
    for limit in (2, 4, 100):
        cut = by_id(T.tokenize(docs, vocab, truncate=True, max_len=limit))
        for k, row in cut.items():
            assert row["input_ids"] == (full[k]["input_ids"][: limit - 1] + [3])[:limit] or (
                row["input_ids"] == full[k]["input_ids"]
            )
            assert len(row["input_ids"]) == min(limit, len(full[k]["input_ids"]))
    with pytest.raises(ValueError):
        T.tokenize(docs, vocab, truncate=True)
    with pytest.raises(ValueError):
        T.tokenize(docs, vocab, truncate=True, max_len=1)


def test_either_special_may_be_left_out(docs, vocab):
    row = by_id(T.tokenize(docs, vocab, bos=None))[0]
    assert row["input_ids"][-1] == 3 and row["special_tokens_mask"] == [0] * 6 + [1]
    row = by_id(T.tokenize(docs, vocab, bos=None, eos=None))[1]
    assert row["input_ids"] == [] and row["special_tokens_mask"] == [] and row["attention_mask"] == []


def test_count_equals_tokenization(docs, vocab):
    counted = {r["doc_id"]: r["n"] for r in docs.select("doc_id", T.count_tokens(F.col("text")).alias("n")).collect()}
    full = by_id(T.tokenize(docs, vocab, bos=None, eos=None))
    assert counted == {k: len(r["input_ids"]) for k, r in full.items()}


ODD = ["", " \n\t\x0b\f\r ", "a\x0bb", "\u00a0x\u2003y", "a_b-c", "😀😀 z", "\u0301e", " lead", "trail ", "0x1F,,;", "\x1c\x85"]


def test_kernels_split_like_the_built_in_expression(spark, sf, monkeypatch):
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    texts = odd.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    words = texts.select("doc_id", T.word_tokens(F.col("text")).alias("w"))
    counted = {r["token"]: r["freq"] for r in T.count_words(texts).collect()}
    want = {r["t"]: r["count"] for r in words.select(F.explode("w").alias("t")).groupBy("t").count().collect()}
    assert counted == want
    every = T.load_vocab(T.build_vocab(texts, len(want)))
    ids = dict(zip(every["token"].to_pylist(), every["id"].to_pylist()))
    got = {r["doc_id"]: r["i"] for r in texts.select("doc_id", T.word_ids(F.col("text"), every, 1).alias("i")).collect()}
    assert got == {r["doc_id"]: [ids[t] for t in r["w"]] for r in words.collect()}


@pytest.mark.parametrize("limit", [1, 7, 40, 10**6])
def test_batches_go_through_in_parts(monkeypatch, limit):
    monkeypatch.setattr(T, "PART_BYTES", limit)
    texts = pa.array(["a b", "", "c, d", None, "e" * 30, "f g h", ""])
    parts = list(T._parts(texts))
    assert pa.concat_arrays(parts).equals(texts)
    assert len(parts) == 1 or limit < 10**6
    counts = [c for p in parts for c in T._split_words(p)[1].to_pylist()]
    assert counts == [2, 0, 3, 0, 1, 3, 0]
    assert sum(len(T._split_words(p)[0]) for p in parts) == 9


def test_kernels_give_a_batch_in_small_parts(vocab):
    text = "the cat, the dog. " * 500
    batch = pa.array([text, None, ""] * 1000)
    found = list(T._known_ids(iter([batch]), vocab["token"].combine_chunks(), vocab["id"].combine_chunks(), 1))
    assert sum(map(len, found)) == len(batch) and max(map(len, found)) * len(text) <= 3 * (T.PART_BYTES + len(text))
    # A serialized tokenizer holds about a hundred times the text.
    batch = batch.slice(0, 300)
    found = list(T._encoded(iter([batch]), word_tokenizer_json(vocab)))
    assert sum(map(len, found)) == len(batch) and max(map(len, found)) * len(text) <= 3 * (T.ENCODE_BYTES + len(text))


def test_vocab_check(docs, vocab):
    row = T.vocab_check(T.tokenize(docs, vocab), 8).first()
    ids = [i for r in T.tokenize(docs, vocab).collect() for i in r["input_ids"]]
    assert (row["tokens"], row["max_id"]) == (len(ids), max(ids))
    assert row["out_of_range"] == sum(i >= 8 for i in ids)
    assert row["unknown"] == sum(i == 1 for i in ids)


def test_vocab_bounds(docs, monkeypatch):
    with pytest.raises(ValueError):
        T.build_vocab(docs, 0)
    big = T.build_vocab(docs, 9)
    monkeypatch.setattr(T, "MAX_VOCAB", 4)
    with pytest.raises(ValueError):
        T.load_vocab(big)


def test_packed_mask_is_that_of_the_tokens(docs, vocab):
    """Also when a vocabulary gives a word the id of a special token."""
    clash = pa.table({"token": vocab["token"], "id": pc.subtract(vocab["id"], 3).cast(pa.int32())})
    assert 2 in clash["id"].to_pylist()
    for table in (vocab, clash):
        tokens = T.tokenize(docs, table)
        plain = {r["doc_id"]: (r["input_ids"], r["special_tokens_mask"]) for r in tokens.collect()}
        blocks = pack_documents(docs, table, "doc_id", 1000, 1).collect()
        assert len(blocks) == 1
        assert blocks[0]["input_ids"] == [i for k in sorted(plain) for i in plain[k][0]]
        assert blocks[0]["special_tokens_mask"] == [m for k in sorted(plain) for m in plain[k][1]]
    ends = pack_documents(docs, vocab, "doc_id", 1000, 1, bos=None, eos=None).first()
    assert set(ends["special_tokens_mask"]) == {0}
