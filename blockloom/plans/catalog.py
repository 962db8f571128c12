"""Registered queries: every operator over the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import format_elapsed, round_up
from ..functions.permute import Permutation
from ..operators import artifacts as A
from ..operators import budget as G
from ..operators import collate as C
from ..operators import loading as L
from ..operators import metrics as M
from ..operators import packing as P
from ..operators import reports as R
from ..operators import tokens as T
from ..schemas import SPECIALS
from ..session import bounded_batches, scratch_dir, stored
from ..sources import prepared as S
from ..sources import readers
from ..streaming import carry, live
from . import views as V
from .prepare import feed, pack_documents, prepare, prepare_incremental, store_blocks

# Columns of the step log that counters and losses are made of.
COUNTED = ("run_id", "session", "rank", "phase", "batch_idx", "step", "batch_size", "devices", "width")
LOSSES = ("run_id", "rank", "phase", "step", "loss", "batch_size")

Query = Callable[[SparkSession, str], DataFrame]

VOCAB_SIZE = 30_000
MODEL_VOCAB = 20_000
BLOCK = 512
SHARDS = 16
ROWS = 16_000
# A second setting whose batches are often shorter than a block.
SHORT_BLOCK, SHORT_ROWS = 4096, 5
SEED, EPOCH = 42, 1
WORLD, MICRO, ACCUM = 4, 8, 2
EVAL_SAMPLES = 50
MASK_P = 0.15
EVAL_EVERY, SAVE_EVERY, LOG_ACCUM = 3, 5, 4
CACHE_LIMIT = 20_000_000_000
BLOCK_SIZES = (512, 1024, 2048)


def _text(array: str) -> Column:
    return F.col(array).cast("string")


def _vocab(spark: SparkSession, sf: str):
    bounded_batches(spark)
    return T.load_vocab(T.build_vocab(V.spread_docs(spark, sf), VOCAB_SIZE))


def _packed(spark: SparkSession, sf: str, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    return pack_documents(V.docs(spark, sf), _vocab(spark, sf), "doc_id", block, SHARDS, rows)


def _totals(spark: SparkSession, sf: str, rows: int = ROWS) -> DataFrame:
    """Token counts per batch; stored, so that the texts are read once."""
    bounded_batches(spark)
    placed = readers.spread(P.assign_batches(V.docs(spark, sf), "doc_id", SHARDS, rows), "doc_id")
    # Start and end ids count as tokens.
    counted = placed.select(*P.GROUP, (T.count_tokens(F.col("text")) + 2).alias("n_tokens"))
    return stored(P.batch_totals(counted), "totals")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return P.index_blocks(_totals(spark, sf), BLOCK)


def _of(split: str) -> Column:
    return F.col("split") == split


def _shuffled_ranks(totals: DataFrame, block: int) -> DataFrame:
    """Training blocks in an epoch's order, dealt to the ranks."""
    placed = L.shuffle(P.index_blocks(totals, block).filter(_of("train")), SEED, EPOCH)
    return L.shard_by_rank(placed, WORLD, counts=P.block_counts(totals, block))


# --- sources ---------------------------------------------------------------------------------


def src_lines(spark, sf):
    return readers.explode_lines(V.table(spark, sf, "documents"), "doc_id").select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "line"
    )


def src_text_files(spark, sf):
    """Lines written as text files in order, read back with their positions."""
    path = scratch_dir(spark, "lines")
    cores = spark.sparkContext.defaultParallelism
    lines = readers.explode_lines(V.table(spark, sf, "documents"), "doc_id")
    ordered = lines.repartitionByRange(cores, "doc_id").sortWithinPartitions("doc_id", "line_no")
    ordered.select(F.col("line").alias("value")).write.text(path)
    return readers.read_lines(spark, path)


def src_dispatch(spark, sf):
    """The reader chosen by the file extension."""
    return readers.read_corpus(spark, f"{sf}/documents.parquet")


def named_splits(spark, sf):
    paths = {"train": f"{sf}/documents.parquet", "val": f"{sf}/conversations.parquet"}
    return readers.named_splits(spark, paths)


def split_counts(spark, sf):
    return R.split_counts(V.docs(spark, sf))


def prepared_roundtrip(spark, sf):
    path = scratch_dir(spark, "prepared")
    S.save_prepared(_packed(spark, sf), path)
    return _block_view(S.load_prepared(spark, path))


def _split_folders(spark, sf) -> dict[str, str]:
    """``documents`` as one folder of files per split, in the order of their ids."""
    root, paths = scratch_dir(spark, "inputs"), {}
    for split in ("train", "val"):
        rows = V.docs(spark, sf).filter(_of(split)).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        paths[split] = f"{root}/{split}.parquet"
        rows.select("text").write.parquet(paths[split])
    return paths


def _prepare(spark, sf, paths, root, **how):
    return prepare(spark, paths, root, _vocab(spark, sf), "words", BLOCK, SHARDS, ROWS, **how)


def force_rebuild(spark, sf):
    """Prepared, then made anew beside the version in force, and read."""
    paths, root = _split_folders(spark, sf), scratch_dir(spark, "tokenized")
    _prepare(spark, sf, paths, root, prepare_only=True)
    return _block_view(_prepare(spark, sf, paths, root, force_rebuild=True))


def prepare_only(spark, sf):
    """One call only prepares, the next one finds what it left."""
    paths, root = _split_folders(spark, sf), scratch_dir(spark, "tokenized")
    if _prepare(spark, sf, paths, root, prepare_only=True) is not None:
        raise AssertionError("a job that only prepares returns nothing")
    return _block_view(_prepare(spark, sf, paths, root))


# Entries of the incremental input: documents by id modulo this.
ENTRIES = 5


def prepared_incremental(spark, sf):
    """Four entries, then a fifth and another content of the second; only these two are packed again."""
    root, source = scratch_dir(spark, "tokenized"), scratch_dir(spark, "entries")
    docs, vocab = V.docs(spark, sf), _vocab(spark, sf)

    def put(i: int, rows: DataFrame) -> None:
        part = rows.filter(F.col("doc_id") % ENTRIES == i).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        part.select("text").write.mode("overwrite").parquet(f"{source}/{i}")

    for i in range(ENTRIES - 1):
        put(i, docs.filter("doc_id < 7") if i == 1 else docs)
    prepare_incremental(spark, {"train": source}, root, vocab, "words", BLOCK, ROWS, fmt="parquet", prepare_only=True)
    put(1, docs)
    put(ENTRIES - 1, docs)
    return _block_view(prepare_incremental(spark, {"train": source}, root, vocab, "words", BLOCK, ROWS, fmt="parquet"))


def cache_lookup(spark, sf):
    found = S.lookup_prepared(V.cache_requests(spark, sf), V.cache_entries(spark, sf))
    return found.select("c_custkey", "match", "path")


def corpus_preview(spark, sf):
    return readers.corpus_preview(V.docs(spark, sf), "doc_id", 2)


def corpus_stats(spark, sf):
    return R.corpus_stats(_totals(spark, sf), BLOCK_SIZES)


# --- tokens ----------------------------------------------------------------------------------


def _token_view(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "split",
        F.size("input_ids").cast("long").alias("n_tokens"),
        _text("input_ids").alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"),
        _text("special_tokens_mask").alias("special"),
    )


def tokenize_native(spark, sf):
    return _token_view(T.tokenize(V.spread_docs(spark, sf), _vocab(spark, sf)))


def tokenize_file(spark, sf):
    """A serialized word tokenizer made of the same vocabulary; equals the native back end."""
    return _token_view(T.tokenize_with_file(V.spread_docs(spark, sf), word_tokenizer_json(_vocab(spark, sf))))


def word_tokenizer_json(vocab) -> str:
    """Serialize a vocabulary as a tokenizer file with start and end tokens."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers, processors

    words = dict(zip(vocab["token"].to_pylist(), vocab["id"].to_pylist()))
    # Names with spaces cannot occur as words of a text.
    marks = {name: f" {name} " for name in SPECIALS}
    words.update({marks[name]: i for name, i in SPECIALS.items()})
    tokenizer = Tokenizer(models.WordLevel(words, unk_token=marks["unk"]))
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(T.WORD_PATTERN), "removed", invert=True)
    tokenizer.post_processor = processors.TemplateProcessing(
        single=[f"{marks['bos']}:0", "$A:0", f"{marks['eos']}:0"],
        special_tokens=[(marks["bos"], SPECIALS["bos"]), (marks["eos"], SPECIALS["eos"])],
    )
    return tokenizer.to_str()


def tokenize_truncated(spark, sf):
    return _token_view(T.tokenize(V.spread_docs(spark, sf), _vocab(spark, sf), truncate=True, max_len=64))


def special_mask(spark, sf):
    tokens = T.tokenize(V.spread_docs(spark, sf), _vocab(spark, sf), eos=None)
    specials = F.aggregate("special_tokens_mask", F.lit(0), lambda a, x: a + x)
    return tokens.select(
        "doc_id",
        specials.cast("long").alias("specials"),
        F.get("special_tokens_mask", F.lit(0)).cast("long").alias("first"),
        F.element_at("special_tokens_mask", -1).cast("long").alias("last"),
    )


def vocab_topk(spark, sf):
    return T.build_vocab(V.spread_docs(spark, sf), VOCAB_SIZE)


def vocab_check(spark, sf):
    return T.vocab_check(T.tokenize(V.spread_docs(spark, sf), _vocab(spark, sf)), MODEL_VOCAB)


def round_up_query(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", round_up(F.col("l_partkey"), F.col("l_linenumber")).alias("rounded")
    )


# --- packing ---------------------------------------------------------------------------------


def row_index(spark, sf):
    return P.index_batches(V.docs(spark, sf), "doc_id", SHARDS).select("split", "doc_id", "row_idx")


def shard_ranges(spark, sf):
    return (
        P.index_batches(V.docs(spark, sf), "doc_id", SHARDS, SHORT_ROWS)
        .groupBy("split", "shard", "batch")
        .agg(F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), F.count("*").alias("docs"))
    )


def _block_view(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "split",
        "shard",
        "batch",
        "blk",
        *more,
        _text("input_ids").alias("ids"),
        _text("special_tokens_mask").alias("special"),
    )


def pack_blocks(spark, sf):
    return _block_view(_packed(spark, sf))


def pack_blocks_short(spark, sf):
    """Short batches, with the dense number of each block in its split."""
    blocks = _packed(spark, sf, SHORT_BLOCK, SHORT_ROWS)
    return _block_view(P.number_blocks(blocks, _totals(spark, sf, SHORT_ROWS), SHORT_BLOCK), "block_idx")


def pack_dropped(spark, sf):
    return P.pack_loss(_totals(spark, sf), BLOCK)


def block_lengths(spark, sf):
    return P.pack_validate(_packed(spark, sf, SHORT_BLOCK, SHORT_ROWS), ("input_ids", "special_tokens_mask"))


# --- loading ---------------------------------------------------------------------------------


def shuffle_epoch(spark, sf):
    train = _blocks(spark, sf).filter(_of("train"))
    return L.shuffle(train, SEED, EPOCH).select("split", "block_idx", "pos")


def micro_batches(spark, sf):
    sequential = _blocks(spark, sf).withColumn("pos", F.col("block_idx"))
    return L.batches(sequential, MICRO).select("split", "block_idx", "batch_idx", "slot")


def _val_batches(spark, sf):
    totals = _totals(spark, sf)
    val = P.index_blocks(totals, BLOCK).filter(_of("val")).withColumn("pos", F.col("block_idx"))
    return L.batches(L.shard_by_rank(val, WORLD, counts=P.block_counts(totals, BLOCK)), MICRO)


def eval_limit(spark, sf):
    return L.limit_eval(_val_batches(spark, sf), EVAL_SAMPLES, MICRO).select("rank", "batch_idx", "slot", "block_idx")


def rank_shards(spark, sf):
    return _shuffled_ranks(_totals(spark, sf), BLOCK).select("block_idx", "rank", "pos", "is_pad")


# The optimizer step that an interrupted epoch goes on from.
RESUME_STEP = 2


def resume_epoch(spark, sf):
    """What is left of an epoch's training blocks, from an optimizer step on."""
    n = P.block_counts(_totals(spark, sf), BLOCK).filter(_of("train")).first()
    order = Permutation(n["n"] if n else 0, SEED, EPOCH)
    return L.resume_epoch(spark, order, WORLD, MICRO, ACCUM, RESUME_STEP)


def optimizer_steps(spark, sf):
    dealt = L.batches(_shuffled_ranks(_totals(spark, sf), BLOCK), MICRO)
    return L.check_steps(L.accumulate(dealt, ACCUM), MICRO * WORLD * ACCUM)


def due_steps(spark, sf):
    steps = V.steps(spark, sf, "run_id", "rank", "phase", "passes")
    counted = steps.filter((F.col("rank") == 0) & (F.col("phase") == "train")).select("run_id", "passes")
    marked = L.due_steps(counted, EVAL_EVERY, SAVE_EVERY, LOG_ACCUM)
    return marked.filter("eval_due or save_due")


# --- collation -------------------------------------------------------------------------------


def _stored_blocks(spark, sf, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    return store_blocks(spark, _packed(spark, sf, block, rows), scratch_dir(spark, "prepared"))


def _fed_view(df: DataFrame, *more: Column) -> DataFrame:
    ids, attention = _text("input_ids").alias("ids"), _text("attention_mask").alias("attention")
    return df.select("split", "rank", "batch_idx", "slot", "width", ids, attention, *more)


def collate_pad(spark, sf):
    """Padded batches per rank of both splits, from stored blocks."""
    fed = feed(_stored_blocks(spark, sf, SHORT_BLOCK, SHORT_ROWS), SEED, EPOCH, WORLD, MICRO)
    return _fed_view(fed, _text("special_tokens_mask").alias("special"))


def feed_clm(spark, sf):
    """Padded and labelled batches per rank of both splits, causal objective."""
    blocks = _stored_blocks(spark, sf, SHORT_BLOCK, SHORT_ROWS)
    return _fed_view(feed(blocks, SEED, EPOCH, WORLD, MICRO, "clm"), _text("labels").alias("labels"))


def feed_mlm(spark, sf):
    """The same with the masked objective."""
    size = VOCAB_SIZE + len(SPECIALS)
    fed = feed(_stored_blocks(spark, sf), SEED, EPOCH, WORLD, MICRO, "mlm", vocab_size=size, p=MASK_P)
    return _fed_view(fed, _text("labels").alias("labels"))


def labels_clm(spark, sf):
    """Causal labels of blocks filled up to the block size."""
    blocks = _packed(spark, sf, SHORT_BLOCK, SHORT_ROWS).withColumn("width", F.lit(SHORT_BLOCK))
    labelled = C.objective(C.pad(blocks, ("input_ids",)), "clm")
    return labelled.select("split", "shard", "batch", "blk", _text("labels").alias("labels"))


def _masked(spark, sf):
    size = VOCAB_SIZE + len(SPECIALS)
    return C.objective(_packed(spark, sf), "mlm", vocab_size=size, p=MASK_P, seed=SEED, epoch=EPOCH)


def labels_mlm(spark, sf):
    return _masked(spark, sf).select(
        "split", "shard", "batch", "blk", _text("input_ids").alias("ids"), _text("labels").alias("labels")
    )


def mask_stats(spark, sf):
    counts = C.mask_stats(_masked(spark, sf))
    return counts.select(
        "split", F.col("action").cast("long").alias("action"), F.col("special").cast("long").alias("special"), "positions"
    )


# --- run metrics -----------------------------------------------------------------------------


def progress(spark, sf):
    return M.progress(V.steps(spark, sf, *COUNTED)).select("run_id", "session", "batch_idx", "samples", "tokens")


def progress_at_val(spark, sf):
    return M.progress_at_val(V.steps(spark, sf, *COUNTED)).select("run_id", "session", "batch_idx", "samples", "tokens")


def train_loss(spark, sf):
    return M.train_loss(V.steps(spark, sf, "run_id", "session", "rank", "phase", "batch_idx", "step", "loss"))


def val_loss(spark, sf):
    return M.val_loss(V.steps(spark, sf, *LOSSES)).withColumn("val_loss", F.round("val_loss", 10))


def system_metrics(spark, sf):
    spans = M.validation_spans(
        V.steps(spark, sf, "run_id", "session", "rank", "phase", "step", "start_us", "end_us", "peak_bytes")
    )
    return M.system_metrics(spans).withColumn("avg_seconds", F.round("avg_seconds", 9))


def _saves(steps: DataFrame) -> DataFrame:
    train = steps.filter((F.col("rank") == 0) & (F.col("phase") == "train"))
    return train.filter(L.due(F.col("step"), SAVE_EVERY)).select("run_id", "step").distinct()


def _candidates(steps: DataFrame) -> DataFrame:
    return M.loss_at_saves(_saves(steps), M.val_loss(steps))


def best_checkpoint(spark, sf):
    best = M.best_checkpoint(_candidates(V.steps(spark, sf, *LOSSES)))
    return best.withColumn("loss", F.round("loss", 10))


def checkpoint_name(spark, sf):
    steps = V.steps(spark, sf, *dict.fromkeys((*COUNTED, *LOSSES)))
    counters = (
        M.progress(steps)
        .groupBy("run_id", "step")
        .agg(F.max_by(F.struct("samples", "tokens"), "batch_idx").alias("p"))
        .select("run_id", "step", "p.samples", "p.tokens")
    )
    named = _candidates(steps).filter("loss is not null").join(counters, ["run_id", "step"])
    # Rounded first, so that the last digits of a mean do not depend on the order of addition.
    name = A.checkpoint_name(F.col("step"), F.col("samples"), F.col("tokens"), F.round("loss", 8))
    return named.select("run_id", "step", name.alias("name"))


def prune_old(spark, sf):
    return A.latest_only(V.artifacts(spark, sf)).select("run_id", "artifact_id", "iter", "delete")


def retention(spark, sf):
    return A.retention(V.artifacts(spark, sf)).select("run_id", "artifact_id", F.array_join("aliases", ",").alias("aliases"))


def cache_trim(spark, sf):
    trimmed = A.cache_trim(V.artifacts(spark, sf), CACHE_LIMIT)
    return trimmed.select("cache_id", "artifact_id", "kept_bytes", "keep")


def backoff_events(spark, sf):
    steps = V.steps(spark, sf, "run_id", "session", "phase", "step")
    validations = steps.filter(F.col("phase") == "val").select("run_id", "session", "step").distinct()
    return M.every_nth(validations).select("run_id", "session", "step", "event_no")


def resolve_refs(spark, sf):
    return A.resolve_refs(V.refs(spark, sf), V.artifacts(spark, sf))


def final_aliases(spark, sf):
    done = A.final_aliases(V.artifacts(spark, sf))
    return done.select("run_id", "artifact_id", F.array_join("aliases", ",").alias("aliases"))


def format_elapsed_query(spark, sf):
    """Event values stretched over every range of durations."""
    scale = F.when(F.col("event_id") % 5 == 0, 1e-6).when(F.col("event_id") % 5 == 1, 0.1)
    scale = scale.when(F.col("event_id") % 5 == 2, 10.0).when(F.col("event_id") % 5 == 3, 100.0).otherwise(5000.0)
    seconds = F.col("value") * scale
    return V.table(spark, sf, "events").select("event_id", format_elapsed(seconds).alias("elapsed"))


def metric_line(spark, sf):
    """Loss, counters and time of every training batch as one line."""
    rows = M.progress(V.steps(spark, sf, *COUNTED, "loss", "start_us", "end_us")).select(
        "run_id",
        F.col("batch_idx").alias("step"),
        F.inline(
            F.array(
                _metric(0, "train/loss", F.col("loss"), True),
                _metric(1, "progress/samples", F.col("samples"), True),
                _metric(2, "progress/tokens", F.col("tokens"), True),
                _metric(3, "perf/batch_time", (F.col("end_us") - F.col("start_us")) / F.lit(1e6), True),
            )
        ),
    )
    return R.metric_line(rows, prefix="train")


def _metric(order: int, name: str, value: Column, is_float: bool) -> Column:
    return F.struct(
        F.lit(order).alias("ord"),
        F.lit(name).alias("name"),
        value.cast("double").alias("value"),
        F.lit(is_float).alias("is_float"),
    )


# --- budget ----------------------------------------------------------------------------------


def run_plan(spark, sf):
    plan = G.run_plan(V.runs(spark, sf))
    return plan.select(
        "run_id",
        "micro_batch",
        "accumulation",
        "units_per_step",
        "goal_steps",
        "eval_steps",
        "save_steps",
        "warmup_steps",
        "decay_steps",
        "valid",
    )


PLAN = ("micro_batch", "accumulation", "units_per_step", "goal_steps", "eval_steps", "save_steps", "warmup_steps")


def run_plan_layered(spark, sf):
    """Options set in layers, completed by the defaults, turned into a plan."""
    chosen = G.layered_overrides(V.option_overrides(spark, sf))
    return G.run_plan(G.with_defaults(chosen)).select("run_id", *PLAN, "decay_steps", "valid")


def run_coverage(spark, sf):
    plan = G.run_plan(V.runs(spark, sf))
    stats = R.corpus_stats(_totals(spark, sf), BLOCK_SIZES)
    return G.run_coverage(plan, stats).select(
        "run_id", "valid", "corpus_blocks", "steps_per_epoch", "epochs", "goal_steps", "tokens_seen"
    )


def layered_overrides(spark, sf):
    return G.layered_overrides(V.overrides(spark, sf))


# --- streaming -------------------------------------------------------------------------------


def stream_pack(spark, sf):
    """``documents`` as a stream; the one file is one micro-batch, so blocks equal the batch job's."""
    raw = live.stream_table(spark, sf, V.table(spark, sf, "documents").schema, "documents.parquet")
    docs = raw.select("doc_id", "text", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))
    out, checkpoint = scratch_dir(spark, "stream-blocks"), scratch_dir(spark, "stream-state")
    query = live.stream_pack(docs, _vocab(spark, sf), out, checkpoint, BLOCK, SHARDS, ROWS, key="doc_id")
    query.awaitTermination()
    return _block_view(spark.read.parquet(out))


def stream_totals(spark, sf):
    raw = live.stream_table(spark, sf, V.table(spark, sf, "events").schema, "events.parquet")
    out, checkpoint = scratch_dir(spark, "stream-totals"), scratch_dir(spark, "stream-state")
    live.stream_totals(V.events_as_steps(raw), out, checkpoint).awaitTermination()
    return live.read_totals(spark, out)


def _arrivals(spark, rows: DataFrame, key: str, parts: int, path: str):
    """Write ``rows`` in ``parts`` rounds of ascending keys into one folder, one after the other."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        rows.write.parquet(path)
        return
    width = (high - low) // parts + 1
    for i in range(parts):
        some = rows.filter((F.col(key) >= low + i * width) & (F.col(key) < low + (i + 1) * width))
        some.write.mode("append").parquet(path)
        yield i


def stream_pack_carry(spark, sf):
    """``documents`` in four rounds, the stream stopped and started again after each."""
    docs, vocab = V.docs(spark, sf), _vocab(spark, sf)
    source, out, checkpoint = (scratch_dir(spark, f"carry-{x}") for x in ("in", "out", "state"))
    for _ in _arrivals(spark, docs, "doc_id", 4, source):
        raw = live.stream_table(spark, source, docs.schema)
        carry.stream_pack_carry(raw, vocab, out, checkpoint, BLOCK, SHARDS).awaitTermination()
    blocks = carry.finished_blocks(spark, out, checkpoint)
    return _block_view(blocks.withColumn("batch", F.lit(0).cast("long")))


def stream_totals_once(spark, sf):
    """``events`` in four rounds, every one sent again with the round after it."""
    events = V.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    source, again, out, checkpoint = (scratch_dir(spark, f"once-{x}") for x in ("in", "again", "out", "state"))
    for i in _arrivals(spark, events, "event_id", 4, source):
        # All that came so far but the newest round is there a second time.
        raw = live.stream_table(spark, source, events.schema)
        if i:
            spark.read.parquet(again).write.mode("append").parquet(source)
        spark.read.parquet(source).write.mode("overwrite").parquet(again)
        steps = V.events_as_steps(live.events_once(raw, "at", "60 days"))
        live.stream_totals(steps, out, checkpoint).awaitTermination()
    return live.read_totals(spark, out)


def queries() -> dict[str, Query]:
    """All registered queries by name."""
    return {
        "src_lines": src_lines,
        "src_text_files": src_text_files,
        "src_dispatch": src_dispatch,
        "named_splits": named_splits,
        "split_counts": split_counts,
        "prepared_roundtrip": prepared_roundtrip,
        "force_rebuild": force_rebuild,
        "prepare_only": prepare_only,
        "prepared_incremental": prepared_incremental,
        "cache_lookup": cache_lookup,
        "corpus_preview": corpus_preview,
        "corpus_stats": corpus_stats,
        "tokenize_native": tokenize_native,
        "tokenize_file": tokenize_file,
        "tokenize_truncated": tokenize_truncated,
        "special_mask": special_mask,
        "vocab_topk": vocab_topk,
        "vocab_check": vocab_check,
        "round_up": round_up_query,
        "row_index": row_index,
        "shard_ranges": shard_ranges,
        "pack_blocks": pack_blocks,
        "pack_blocks_short": pack_blocks_short,
        "pack_dropped": pack_dropped,
        "block_lengths": block_lengths,
        "shuffle_epoch": shuffle_epoch,
        "micro_batches": micro_batches,
        "eval_limit": eval_limit,
        "rank_shards": rank_shards,
        "optimizer_steps": optimizer_steps,
        "resume_epoch": resume_epoch,
        "due_steps": due_steps,
        "collate_pad": collate_pad,
        "feed_clm": feed_clm,
        "feed_mlm": feed_mlm,
        "labels_clm": labels_clm,
        "labels_mlm": labels_mlm,
        "mask_stats": mask_stats,
        "progress": progress,
        "progress_at_val": progress_at_val,
        "train_loss": train_loss,
        "val_loss": val_loss,
        "system_metrics": system_metrics,
        "best_checkpoint": best_checkpoint,
        "checkpoint_name": checkpoint_name,
        "prune_old": prune_old,
        "retention": retention,
        "cache_trim": cache_trim,
        "backoff_events": backoff_events,
        "resolve_refs": resolve_refs,
        "final_aliases": final_aliases,
        "format_elapsed": format_elapsed_query,
        "metric_line": metric_line,
        "run_plan": run_plan,
        "run_plan_layered": run_plan_layered,
        "run_coverage": run_coverage,
        "layered_overrides": layered_overrides,
        "stream_pack": stream_pack,
        "stream_totals": stream_totals,
        "stream_pack_carry": stream_pack_carry,
        "stream_totals_once": stream_totals_once,
    }
