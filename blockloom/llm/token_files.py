"""Token ids as Arrow files of fixed-size lists.

Documents are put in order of their ids by range, tokenized, ended and cut into sequences of equal
length. A task writes its range as two Arrow files: ``ids-*.arrow`` with the columns ``ids`` and ``mask``
(fixed-size lists; the mask is 0 on the padding after the last token of a file) in record batches of
a fixed number of sequences, and ``docs-*.arrow`` with the place of every document. Buffers are not
compressed, so a mapped file gives any sequence without a copy, by arithmetic alone.

File names carry the attempt that wrote them, and a manifest, written by Spark once all tasks are
done, names the files that count: a lost or repeated task leaves nothing that a reader sees.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rows import parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE = 2048
# Sequences in a record batch: the memory of a writer, and the unit of random access.
BATCH = 128
# Words, and letters of words, that a worker remembers the ids of: about 200 bytes each.
MEMO_WORDS = 600_000
# Letters that were not met since so many others came are forgotten; at most twice as many are held.
MEMO_LETTERS = 300_000
MANIFEST = "part int, ids_file string, docs_file string, n_docs long, n_tokens long"


def open_fs(path: str):
    """File system and path of a location as Spark writes it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class FastTokenizer:
    """Ids of texts by a byte-level BPE of the tokenizers library, each word encoded once.

    Its pattern starts a new piece at every space that a letter, digit or ASCII mark follows, so a
    text is the sequence of such words, and words repeat. Other tokenizers encode whole texts.
    """

    def __init__(self, content: str, dtype):
        from tokenizers import Tokenizer

        # Tasks are the parallelism.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        self.dtype = dtype
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
        )
        # Tokens that were added to the model are found before words are cut.
        self.lines = not any("\n" in t["content"] for t in spec.get("added_tokens") or ())
        self.model = self.tokenizer.model
        # The byte alphabet of the library: printable bytes stand for themselves.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
        self.odd = re.compile(" (?![!-~À-ɏ])")
        self.cut = re.compile("(?= [!-~À-ɏ])")
        self.space, self.line = chr(self.alphabet[32]), chr(self.alphabet[10])
        self.code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _piece(self, letters: str) -> bytes:
        """Ids of a space and letters; many words are the same letters with other marks behind them."""
        found = self.pieces.get(letters)
        if found is None:
            found = self.before.get(letters)
            if found is None:
                found = self._ids(self.space, letters)
            self._remember(letters, found)
        return found

    def _ids(self, before: str, letters: str) -> bytes:
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(before + shown)]).tobytes()

    def _lines(self, word: str) -> bytes | None:
        """Ids of a space and a word with line breaks, if each is a single one before letters: it is a piece of its own."""
        out = b""
        for i, line in enumerate(word.split("\n")):
            found = self.plain.fullmatch(line)
            if found is None:
                return None
            letters, marks = found.groups()
            if i:
                key = "\n" + letters
                known = self.pieces.get(key)
                if known is None:
                    known = self.before.get(key) or self._ids(self.line, "") + self._ids("", letters)
                    self._remember(key, known)
                out += known
            else:
                out = self._piece(letters)
            if marks:
                out += self._mark(marks)
        return out

    def _remember(self, letters: str, ids: bytes) -> None:
        if len(self.pieces) >= MEMO_LETTERS:
            self.before, self.pieces = self.pieces, {}
        self.pieces[letters] = ids

    def _mark(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self.marks[marks] = self._whole([marks])[0]
        return found

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _learn(self, words: set[str]) -> None:
        """Put the ids of words, each with a space before it, into the memo."""
        rest, memo, piece, plain = [], self.memo, self._piece, self.plain.fullmatch
        for w in words:
            if w.isascii() and w.isalpha():
                memo[w] = piece(w)
                continue
            found = plain(w)
            if found is None:
                ids = self._lines(w) if self.lines and "\n" in w else None
                if ids is None:
                    rest.append(w)
                else:
                    memo[w] = ids
                continue
            letters, marks = found.groups()
            memo[w] = piece(letters) + self._mark(marks) if marks else piece(letters)
        memo.update(zip(rest, self._whole([" " + w for w in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as the bytes of an array."""
        if not self.by_word:
            return self._whole(texts)
        first, rest = [], []
        for t in texts:
            if self.odd.search(t):
                head, *words = self.cut.split(t)
                words = [w[1:] for w in words]
            else:
                head, *words = t.split(" ")
            first.append(head)
            rest.append(words)
        words = set().union(*rest)
        if len(self.memo) + len(words) > MEMO_WORDS:
            # Letters outlive their words: they make learning the words again cheap.
            self.memo.clear()
            if len(self.marks) + len(words) > MEMO_WORDS:
                self.marks.clear()
        self._learn(words.difference(self.memo))
        get = self.memo.__getitem__
        return [head + b"".join(map(get, words)) for head, words in zip(self._whole(first), rest)]


class SharedTokenizer:
    """A serialized tokenizer that goes to the executors once. A worker loads it at its first task and keeps it,
    with the words that it has learned, for the later ones."""

    def __init__(self, content: str, dtype):
        self.content, self.dtype, self.loaded = content, dtype, None

    def __getstate__(self):
        return self.__dict__ | {"loaded": None}

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.loaded is None:
            self.loaded = FastTokenizer(self.content, self.dtype)
        return self.loaded.encode(texts)


class _Writer:
    """One file of sequences: ids come in, whole record batches go out."""

    def __init__(self, sink, dtype, sequence: int, batch: int):
        self.sink, self.sequence, self.room = sink, sequence, sequence * batch
        self.dtype, self.held, self.n_held, self.total = np.dtype(dtype), [], 0, 0
        value = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema(
            [("ids", pa.list_(value, sequence)), ("mask", pa.list_(pa.bool_(), sequence))],
            metadata={"sequence": str(sequence), "batch": str(batch)},
        )
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        part = np.frombuffer(ids, self.dtype)
        self.held.append(part)
        self.n_held += len(part)
        self.total += len(part)
        if self.n_held >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.room * self.room
            for at in range(0, whole, self.room):
                self._write(flat[at : at + self.room], self.room)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.sequence) * self.sequence, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.out.close()
        self.sink.close()


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    partitions: int | None = None,
) -> DataFrame:
    """Write the files under ``path`` and return the manifest ``(part, ids_file, docs_file, n_docs, n_tokens)``.

    ``tokenizer`` is the JSON text of a serialized tokenizer. Ids are stored in 16 bits where its
    vocabulary allows it. Documents follow one another in ascending order of ``key`` over all
    parts, each ended by ``end_id``.

    Nulls: a null text is one end id; null keys come first. Repeated rows are written each. Other
    columns are ignored. An empty table gives an empty manifest. A text may be longer than a
    sequence, a batch or a file of its neighbours: it is cut at sequence boundaries only.
    """
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(tokenizer).get_vocab_size(), end_id + 1)
    dtype = "uint16" if size <= 1 << 16 else "uint32"
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    ordered = src.repartitionByRange(n, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first())
    numbered = ordered.select(F.spark_partition_id().alias("part"), "k", "t")
    root = path.rstrip("/")
    # A tokenizer file has a fixed size; it is sent once per executor.
    shared = spark.sparkContext.broadcast(SharedTokenizer(tokenizer, dtype))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, n_docs = None, None, 0
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            for some in parts(batch, 2):
                if writer is None:
                    part, attempt = some.column(0)[0].as_py(), uuid.uuid4().hex
                    fs, base = open_fs(root)
                    fs.create_dir(base)
                    names = [f"{kind}-{part:05d}-{attempt}.arrow" for kind in ("ids", "docs")]
                    writer = _Writer(fs.open_output_stream(f"{base}/{names[0]}"), dtype, sequence, BATCH)
                    places = fs.open_output_stream(f"{base}/{names[1]}")
                    kind = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
                    index = pa.ipc.new_file(places, kind)
                encoded = shared.value.encode([t or "" for t in some.column(2).to_pylist()])
                lengths = np.array([len(x) for x in encoded], np.int64) // np.dtype(dtype).itemsize + 1
                first = writer.total + np.cumsum(lengths) - lengths
                for ids in encoded:
                    writer.add(ids)
                    writer.add(end)
                index.write_batch(
                    pa.RecordBatch.from_arrays([some.column(1), pa.array(first), pa.array(lengths)], schema=kind)
                )
                n_docs += some.num_rows
        if writer is not None:
            writer.close()
            index.close()
            places.close()
            row = [[part], [names[0]], [names[1]], [n_docs], [writer.total]]
            types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)], [c.split()[0] for c in MANIFEST.split(", ")]
            )

    numbered.mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


class TokenFile:
    """Random access to the sequences of one file; a local file is mapped and nothing is copied."""

    def __init__(self, source):
        self.reader = pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else source)
        meta = self.reader.schema.metadata
        self.sequence, self.batch = int(meta[b"sequence"]), int(meta[b"batch"])
        self._last = (-1, None)

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def _batch(self, number: int) -> pa.RecordBatch:
        if self._last[0] != number:
            self._last = (number, self.reader.get_batch(number))
        return self._last[1]

    def ids(self, i: int) -> np.ndarray:
        """Sequence ``i``, padding included."""
        batch, at = self._batch(i // self.batch), i % self.batch * self.sequence
        return batch.column(0).values.to_numpy()[at : at + self.sequence]

    def mask(self, i: int) -> np.ndarray:
        batch, at = self._batch(i // self.batch), i % self.batch * self.sequence
        return batch.column(1).values.slice(at, self.sequence).to_numpy(zero_copy_only=False)

    def tokens(self, first: int, n: int) -> Iterator[np.ndarray]:
        """The ids of ``n`` tokens from position ``first`` of the file, batch by batch."""
        room = self.sequence * self.batch
        while n > 0:
            flat = self._batch(first // room).column(0).values.to_numpy()
            part = flat[first % room : first % room + n]
            yield part
            first, n = first + len(part), n - len(part)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read back from the files.

    ``start`` counts the tokens of all documents before it. Parts are few (one row each), so
    their first positions are summed up in one task.
    """
    root = path.rstrip("/")
    manifest = spark.read.parquet(f"{root}/manifest")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = placed.select("part", "ids_file", "docs_file", "base").repartition(n, "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, base = open_fs(root)
                with fs.open_input_file(f"{base}/{row['ids_file']}") as ids, fs.open_input_file(f"{base}/{row['docs_file']}") as docs:
                    tokens, places = TokenFile(ids), pa.ipc.open_file(docs)
                    for i in range(places.num_record_batches):
                        place = places.get_batch(i)
                        sums = []
                        for first, count in zip(place.column(1).to_pylist(), place.column(2).to_pylist()):
                            crc = 0
                            for part in tokens.tokens(first, count):
                                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        start = pa.compute.add(place.column(1), pa.scalar(row["base"], pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [place.column(0), start, place.column(2), pa.array(sums, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
