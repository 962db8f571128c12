"""Memory of Python workers: what kernels hold at a time."""

import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockloom.llm import jaccard, simhash
from blockloom.llm import sentencepiece_codec as codec
from blockloom.plans import catalog
from blockloom.session import BATCH_BYTES, bounded_batches

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def no_limit(spark):
    held = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT) if held is None else spark.conf.set(LIMIT, held)


def _largest_batch(spark, rows: int = 1000, width: int = 20_000) -> tuple[int, int]:
    """Bytes of the largest batch that a worker gets of wide texts, and rows of all."""

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["size", "n"])

    wide = spark.range(0, rows, 1, 1).select(F.repeat(F.lit("x"), width).alias("text"))
    return tuple(wide.mapInArrow(sizes, "size long, n long").agg(F.max("size"), F.sum("n")).first())


def _documents(spark, tmp_path):
    docs = [(1, "en", "web", "a few words"), (2, "en", "web", None), (None, "de", "", "  ein  Wort ")]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_pipeline_stage_bounds_batches_by_bytes(no_limit, tmp_path):
    spark = no_limit
    assert _largest_batch(spark) == (pytest.approx(20_000_000, rel=0.01), 1000)
    found = corpus_pipeline.encode_pieces(spark, _documents(spark, tmp_path), "")
    assert [r["same"] for r in found.collect()] == [True] * 3
    size, n = _largest_batch(spark)
    assert size <= BATCH_BYTES + 100_000 and n == 1000


@pytest.mark.parametrize("step", [catalog._vocab, catalog._totals])
def test_token_queries_bound_batches_by_bytes(no_limit, tmp_path, step):
    _documents(no_limit, tmp_path)
    step(no_limit, str(tmp_path))
    size, n = _largest_batch(no_limit)
    assert size <= BATCH_BYTES + 100_000 and n == 1000


def test_limit_of_the_session_stays(no_limit):
    no_limit.conf.set(LIMIT, "1000000")
    bounded_batches(no_limit)
    assert no_limit.conf.get(LIMIT) == "1000000"


def test_decoding_takes_a_few_bytes_for_each_of_the_text():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = codec.PieceModel.parse(f.read())
    encoder, decoder = codec.Encoder(model), codec.Decoder(model)
    texts = ["several words of one long text, " * 30_000, "", " a  b ", "▁x"]
    ids, offsets = encoder.encode_all(texts)
    tracemalloc.start()
    decoded = decoder.decode_all(ids, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert decoded.to_pylist() == [t.replace("▁", " ") for t in texts]
    assert peak < 12 * len(texts[0])


@pytest.mark.parametrize("work", ["first", "open", "forest"])
def test_pairs_of_a_large_group_are_held_a_few_at_a_time(work):
    n = 2_500
    same, ids = np.zeros(n, np.int64), np.arange(n)
    sketch = np.array([jaccard.odd_sketch(np.arange(120, dtype=np.uint64) * np.uint64(977) + np.uint64(i % 7)) for i in range(n)], object)
    made = {
        "first": lambda: jaccard._first(same, same, same, ids, same + 120, same, sketch),
        "open": lambda: jaccard._open(same, same, same, ids, same + 120, same, ids % 40, sketch),
        "forest": lambda: [simhash._forest(same, same, ids << 20, 3)],
    }[work]
    tracemalloc.start()
    count = sum(len(part[0]) for part in made())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count
    assert peak < 45e6
