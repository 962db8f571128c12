"""Streams give what the batch job gives, also when files arrive in several rounds."""

import pytest

from blockloom.operators import tokens as T
from blockloom.plans import views as V
from blockloom.plans.prepare import pack_documents
from blockloom.streaming import carry, live


def test_lines_arriving_in_rounds(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    vocab = T.load_vocab(T.build_vocab(spark.createDataFrame([("a b c d .",)], "text string"), 20))

    def arrive(name, lines):
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        query = live.stream_pack(live.stream_lines(spark, source), vocab, out, state, 8, 2, 3)
        query.awaitTermination()

    rounds = [["a b c", "d", "", "a . b c d a b"], ["c c c"] * 7]
    for i, lines in enumerate(rounds):
        arrive(f"{i}.txt", lines)

    got = spark.read.parquet(out)
    for i, lines in enumerate(rounds):
        docs = spark.createDataFrame([("train", n, t) for n, t in enumerate(lines)], "split string, n long, text string")
        want = pack_documents(docs, vocab, "n", 8, 2, 3)
        part = got.filter(got["stream_batch"] == i).drop("stream_batch")
        assert sorted(map(str, part.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_in_a_folder_is_streamed(spark, tmp_path, files):
    from blockloom.plans import catalog

    rows = spark.createDataFrame([(i, f"the cat {i} sat, on {i * 7} mats") for i in range(200)], "doc_id long, text string")
    rows.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    # Not part of the table.
    rows.write.parquet(str(tmp_path / "other.parquet"))
    found = catalog.stream_pack(spark, str(tmp_path)).collect()
    assert found and sorted(found) == sorted(catalog.pack_blocks(spark, str(tmp_path)).collect())


def test_totals_over_several_micro_batches(spark, sf, tmp_path):
    events = V.table(spark, sf, "events")
    source = str(tmp_path / "events")
    events.repartition(5, "event_id").write.parquet(source)
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    live.stream_totals(V.events_as_steps(raw), out, state).awaitTermination()
    assert spark.read.parquet(out).select("stream_batch").distinct().count() > 1
    got = {r["run_id"]: (r["samples"], r["tokens"]) for r in live.read_totals(spark, out).collect()}
    want = {}
    for r in V.events_as_steps(events).collect():
        s, t = want.get(r["run_id"], (0, 0))
        n = r["batch_size"] * r["devices"] if r["rank"] == 0 and r["phase"] == "train" else 0
        want[r["run_id"]] = (s + n, t + n * r["width"])
    assert got == want


def concatenated(docs, vocab, block, shards):
    """Literal packing: per split and shard all ids in order, cut into blocks, the rest dropped unless alone."""
    ids = {r["n"]: r["input_ids"] for r in T.tokenize(docs.select("n", "text"), vocab).collect()}
    flat = {}
    for r in sorted(docs.collect(), key=lambda r: r["n"]):
        flat.setdefault((r["split"], r["n"] % shards), []).extend(ids[r["n"]])
    out = {}
    for (split, shard), row in flat.items():
        full = max(len(row) // block, 1 if row else 0)
        for b in range(full):
            out[split, shard, b] = row[b * block : (b + 1) * block]
    return out


def test_blocks_cross_micro_batches(spark, tmp_path):
    import random

    rng = random.Random(9)
    words = "a b c d . e ff".split()
    rows = [("val" if n % 5 == 0 else "train", n, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for n in range(150)]
    rows += [("alone", 1000, "a b")]
    schema = "split string, n long, text string"
    docs = spark.createDataFrame(rows, schema)
    vocab = T.load_vocab(T.build_vocab(docs, 20))
    want = concatenated(docs, vocab, 8, 3)
    for name, cuts in (("three", [0, 40, 41, 151]), ("one", [0, 151])):
        source, out, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
        for low, high in zip(cuts, cuts[1:]):
            spark.createDataFrame(rows[low:high], schema).repartition(2).write.mode("append").parquet(source)
            raw = live.stream_table(spark, source, docs.schema)
            # A new query from the same checkpoint each time: what is open comes from the state store.
            carry.stream_pack_carry(raw, vocab, out, state, 8, 3, key="n").awaitTermination()
        found = carry.finished_blocks(spark, out, state).collect()
        assert {(r["split"], r["shard"], r["blk"]): list(r["input_ids"]) for r in found} == want
        assert len(found) == len(want) and all(len(r["special_tokens_mask"]) == len(r["input_ids"]) for r in found)
        left = {(r["split"], r["shard"]): len(r["input_ids"]) for r in carry.open_remainders(spark, state).collect()}
        assert all(n < 8 for n in left.values()) and left["alone", 1] == 4
    # Starting again without anything new changes nothing.
    carry.stream_pack_carry(live.stream_table(spark, source, docs.schema), vocab, out, state, 8, 3, key="n").awaitTermination()
    assert carry.finished_blocks(spark, out, state).count() == len(want)


def test_events_sent_again_count_once_and_late_ones_are_dropped(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    schema = "event_id long, at timestamp, run_id long, rank long, phase string, batch_size long, devices long, width long"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def event(i, minute):
        return (i, start + dt.timedelta(minutes=minute), 1, 0, "train", 2, 1, 8)

    rounds = [
        [event(0, 0), event(1, 5), event(1, 5)],
        [event(1, 5), event(2, 60), event(0, 0)],
        [event(3, 20), event(4, 55), event(2, 60)],
        # Only now has the newest event of the round before moved the watermark to minute 50.
        [event(5, 10), event(6, 70)],
    ]
    late = 0
    for rows in rounds:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        raw = live.stream_table(spark, source, spark.createDataFrame([], schema).schema)
        query = live.stream_totals(live.events_once(raw, "at", "10 minutes"), out, state)
        query.awaitTermination()
        late += live.late_events(query)
    got = [(r["run_id"], r["samples"], r["tokens"]) for r in live.read_totals(spark, out).collect()]
    # Events 3 and 5 came after the watermark had passed them.
    assert got == [(1, 2 * 5, 2 * 5 * 8)] and late == 2
