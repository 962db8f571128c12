"""Text to token ids.

Two back ends give the same columns ``input_ids, attention_mask, special_tokens_mask``:

* *native*: words and marks are split, and looked up in a vocabulary table, by Arrow kernels
  over whole batches of rows (four times the speed of the same split by the JVM's regular
  expressions, and no Python code per row);
* *file*: a serialized tokenizer, loaded once per Python worker stream, that encodes whole
  Arrow batches.

Both are scalar column expressions, so they run where the texts are scanned, before anything is
shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SPECIALS, VOCAB

# Kernels travel inside the task: executors need this package neither installed nor on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: words and single marks; no \w or \b, so every regex engine agrees on it.
WORD_PATTERN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"

# The same split for kernels, as marks to set apart and white space to cut at.
MARK_PATTERN = r"([^A-Za-z0-9 \t\n\x0b\f\r])"

# Bytes of text that one kernel call takes; larger batches of rows go through in parts. Kernels need about ten
# times as much for words, offsets and ids, and a serialized tokenizer a hundred times, so it gets fewer.
PART_BYTES, ENCODE_BYTES = 2 << 20, 512 << 10

# A vocabulary is a model parameter, not corpus data; this is far above any in use.
MAX_VOCAB = 4_000_000


def word_tokens(text: Column) -> Column:
    """Words and punctuation marks of a text, in order, as a built-in expression."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def _parts(texts: pa.Array, limit: int | None = None) -> Iterator[pa.Array]:
    # Cut where the running byte count passes a multiple of the limit.
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    group = (np.cumsum(size) - size) // (limit or PART_BYTES)
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for lo, hi in zip(bounds, bounds[1:]):
        yield texts.slice(lo, hi - lo)


def _split_words(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """All words of a batch in one array, and how many each row has."""
    apart = pc.ascii_trim_whitespace(pc.replace_substring_regex(texts, MARK_PATTERN, r" \1 "))
    words = pc.ascii_split_whitespace(apart)
    # An empty text is split into one empty word.
    blank = pc.equal(pc.fill_null(pc.binary_length(apart), 0), 0)
    counts = pc.if_else(blank, 0, pc.list_value_length(words)).cast(pa.int32())
    flat = words.flatten()
    return flat.filter(pc.not_equal(pc.binary_length(flat), 0)), counts


def count_tokens(text: Column) -> Column:
    """Number of word tokens, without keeping them."""

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return (_split_words(part)[1] for texts in batches for part in _parts(texts))

    return count(F.coalesce(text, F.lit("")))


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """``(token, freq)`` of every word.

    Each batch of rows is counted before its words leave the worker, and each task again before
    the shuffle: a very frequent word costs one row per task.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch.column(0)):
                counted = pc.value_counts(_split_words(part)[0])
                yield pa.RecordBatch.from_arrays(counted.flatten(), ["token", "n"])

    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInArrow(per_batch, "token string, n long").groupBy("token").agg(F.sum("n").alias("freq"))


def build_vocab(df: DataFrame, size: int, text: str = "text", specials: dict[str, int] = SPECIALS) -> DataFrame:
    """The ``size`` most frequent words as ``(token, id, freq)``; ids follow the specials.

    The final ranking sees ``size`` rows only.
    """
    if not 0 < size <= MAX_VOCAB:
        raise ValueError(f"vocabulary size must be in 1..{MAX_VOCAB}")
    first_id = max(specials.values()) + 1
    top = count_words(df, text).orderBy(F.desc("freq"), "token").limit(size)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("freq"), "token"))
    return top.select("token", (rank - 1 + first_id).cast("int").alias("id"), "freq")


def load_vocab(vocab: DataFrame) -> pa.Table:
    """Bring a vocabulary table to the driver, refusing anything above ``MAX_VOCAB`` rows."""
    table = vocab.select(*[F.col(f.name).cast(f.dataType) for f in VOCAB]).limit(MAX_VOCAB + 1).toArrow()
    if table.num_rows > MAX_VOCAB:
        raise ValueError(f"vocabulary has more than {MAX_VOCAB} entries")
    return table


def _known_ids(batches: Iterator[pa.Array], known: pa.Array, ids: pa.Array, unk: int) -> Iterator[pa.Array]:
    """Ids of the words of every text, a part of a batch at a time."""
    for texts in batches:
        # Every call hashes the vocabulary, so a part is no smaller than that.
        for part in _parts(texts, max(PART_BYTES, known.nbytes)):
            words, counts = _split_words(part)
            place = pc.index_in(words, value_set=known.cast(words.type))
            found = pc.fill_null(pc.take(ids, place), unk).cast(pa.int32())
            offsets = np.concatenate([[0], np.cumsum(np.asarray(counts), dtype=np.int64)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), found)


def word_ids(text: Column, vocab: pa.Table, unk: int) -> Column:
    """Ids of the words of a text; words outside the vocabulary give ``unk``."""
    known = vocab["token"].combine_chunks()
    ids = vocab["id"].combine_chunks()

    @F.arrow_udf("array<int>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _known_ids(batches, known, ids, unk)

    return lookup(F.coalesce(text, F.lit("")))


def add_specials(ids: Column, bos: int | None, eos: int | None) -> Column:
    """Put the document start and end ids around the token ids; either may be left out."""
    parts = [ids]
    if bos is not None:
        parts.insert(0, F.array(F.lit(bos)))
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return F.concat(*parts) if len(parts) > 1 else ids


def special_tokens_mask(n_text: Column, bos: int | None, eos: int | None) -> Column:
    """1 on the added start and end positions, 0 on text; positional, so text cannot fake it."""
    return add_specials(
        F.array_repeat(F.lit(0), n_text),
        None if bos is None else 1,
        None if eos is None else 1,
    )


def attention_mask(ids: Column) -> Column:
    """1 for every token before padding."""
    return F.array_repeat(F.lit(1), F.size(ids))


def tokenize(
    df: DataFrame,
    vocab: pa.Table,
    text: str = "text",
    bos: int | None = SPECIALS["bos"],
    eos: int | None = SPECIALS["eos"],
    unk: int = SPECIALS["unk"],
    truncate: bool = False,
    max_len: int | None = None,
) -> DataFrame:
    """Replace the text by ``input_ids``, ``attention_mask``, ``special_tokens_mask``.

    With ``truncate`` a row has at most ``max_len`` ids, start and end included.
    """
    words = word_ids(F.col(text), vocab, unk)
    if truncate:
        if max_len is None:
            raise ValueError("truncation needs max_len")
        room = max_len - (bos is not None) - (eos is not None)
        if room < 0:
            raise ValueError("max_len leaves no room for the special tokens")
        words = F.slice(words, 1, room)
    ids = df.withColumn("__ids", words).drop(text)
    return (
        ids.withColumn("input_ids", add_specials(F.col("__ids"), bos, eos))
        .withColumn("attention_mask", attention_mask(F.col("input_ids")))
        .withColumn("special_tokens_mask", special_tokens_mask(F.size("__ids"), bos, eos))
        .drop("__ids")
    )


def _encoded(batches: Iterator[pa.Array], tokenizer_json: str) -> Iterator[pa.Array]:
    """Ids and masks of every text. What the library returns for a text is far larger than its ids: it is let
    go after a part of a batch."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    kind, names = pa.list_(pa.int32()), ["input_ids", "attention_mask", "special_tokens_mask"]
    for batch in batches:
        for part in _parts(batch, ENCODE_BYTES):
            rows = tokenizer.encode_batch([t or "" for t in part.to_pylist()])
            columns = [[getattr(r, c) for r in rows] for c in ("ids", "attention_mask", "special_tokens_mask")]
            yield pa.StructArray.from_arrays([pa.array(c, kind) for c in columns], names)


def tokenize_with_file(df: DataFrame, tokenizer_json: str, text: str = "text") -> DataFrame:
    """Tokenize with a serialized tokenizer (its JSON text), special tokens as it defines them."""

    @F.arrow_udf("struct<input_ids:array<int>,attention_mask:array<int>,special_tokens_mask:array<int>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _encoded(batches, tokenizer_json)

    encoded = df.withColumn("__enc", encode(F.col(text))).drop(text)
    return encoded.select(
        *[c for c in encoded.columns if c != "__enc"],
        "__enc.input_ids",
        "__enc.attention_mask",
        "__enc.special_tokens_mask",
    )


def vocab_check(
    df: DataFrame, vocab_size: int, unk: int = SPECIALS["unk"], by: Sequence[str] = ("split",)
) -> DataFrame:
    """Compare token ids with a model's vocabulary: largest id, ids out of range, unknown rate."""
    ids = F.col("input_ids")
    per_row = df.select(
        *by,
        F.size(ids).cast("long").alias("n"),
        F.array_max(ids).alias("hi"),
        F.size(F.filter(ids, lambda x: x >= vocab_size)).cast("long").alias("out"),
        F.size(F.filter(ids, lambda x: x == unk)).cast("long").alias("unk"),
    )
    return per_row.groupBy(*by).agg(
        F.sum("n").alias("tokens"),
        F.max("hi").alias("max_id"),
        F.sum("out").alias("out_of_range"),
        F.sum("unk").alias("unknown"),
        F.round(F.sum("unk") / F.sum("n"), 6).alias("unknown_rate"),
    )
