"""What the physical plans must look like to hold at scale."""

import re

import pytest
from blockloom.operators import packing as P
from blockloom.operators import tokens as T
from blockloom.plans import catalog
from blockloom.plans import views as V
from blockloom.plans.prepare import feed, pack_documents, store_blocks
from blockloom.sources import readers
from blockloom.sources.store import PreparedStore


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pack_plan(spark, sf):
    docs = V.docs(spark, sf)
    vocab = T.load_vocab(T.build_vocab(docs, 100))
    placed = P.assign_batches(docs, "doc_id", 4)
    return plan_of(P.pack(T.tokenize(placed, vocab), 64, "doc_id", ("input_ids", "special_tokens_mask")))


def test_documents_move_once(pack_plan):
    # From the top down to the scan of the texts there is one exchange: by batch.
    above_scan = pack_plan[: pack_plan.index("BroadcastExchange")]
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", above_scan)) == 1
    assert "Exchange hashpartitioning(split" in above_scan


def test_texts_are_tokenized_once(pack_plan):
    assert pack_plan.count("ArrowEvalPython") == 1


def test_positions_read_the_key_only(pack_plan):
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", pack_plan)
    assert schemas.count("struct<doc_id:bigint,text:string>") == 1
    assert set(schemas) == {"struct<doc_id:bigint,text:string>", "struct<doc_id:bigint>"}


def jobs_of(spark, name, work):
    """How many jobs ``work`` starts, and what it gives."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        got = work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), got
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_spreading_runs_nothing(spark, sf):
    placed = P.assign_batches(V.docs(spark, sf), "doc_id", 4)
    for df in (placed, placed.join(placed.select("doc_id", "batch").distinct(), ["doc_id", "batch"])):
        n, spread = jobs_of(spark, f"spread-{id(df)}", lambda df=df: readers.spread(df, "doc_id"))
        assert n == 0 and "RoundRobin" not in plan_of(spread)


def test_blocks_are_written_once_and_never_moved(spark, sf, tmp_path):
    docs = V.docs(spark, sf)
    vocab = T.load_vocab(T.build_vocab(docs, 100))
    packed = pack_documents(docs, vocab, "doc_id", 64, 8, 7)
    blocks = store_blocks(spark, packed, str(tmp_path / "blocks"))
    (part,) = (tmp_path / "blocks" / "data").iterdir()
    assert sum(f.name.endswith(".parquet") for f in part.iterdir()) <= 4 * 8
    noted = PreparedStore(spark, str(tmp_path / "blocks")).manifest()["entries"][0]["observed"]
    lengths = P.pack_validate(packed, ("input_ids", "special_tokens_mask")).collect()
    assert noted["blocks"] == sum(r["blocks"] for r in lengths) == blocks.count()
    assert noted["tokens"] == sum(r["blocks"] * r["length"] for r in lengths)
    assert (noted["shortest"], noted["longest"], noted["uneven"]) == (min(r["length"] for r in lengths), max(r["length"] for r in lengths), 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(feed(blocks, 1, 0, 2, 4))
        # From the scan of the arrays up to the join that brings positions to them there is no exchange.
        lines = plan.splitlines()
        at = next(i for i, line in enumerate(lines) if "FileScan" in line and "input_ids" in line.split("FileScan")[1][:300])
        assert "Bucketed: true" in lines[at]
        while "SortMergeJoin" not in lines[at]:
            at -= 1
            assert "Exchange" not in lines[at]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert feed(blocks, 1, 0, 2, 4).count() >= blocks.count()
    again = PreparedStore(spark, str(tmp_path / "blocks")).load()
    assert again.count() == blocks.count()


def test_no_query_multiplies_rows(spark, sf):
    for name, query in catalog.queries().items():
        plan = plan_of(query(spark, sf))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
