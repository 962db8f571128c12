"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives one Viterbi pass.

The automaton over all pieces reports, at every position of a text, each piece that ends there;
these are the entries that its output links lead to. Each of them relaxes the best score of the
position. One pass over the text gives the best segmentation under the piece scores of the model.

Pieces never hold a space mark after another character (checked when the model is read), so the
best segmentation of a text is that of its words, one after another. Words repeat: each task remembers the
segmentations of the frequent ones. All words that are new in a batch go through the automaton as one
string, and the relaxation of their positions runs over all of them at once, position by position.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import add_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
# Score of a character outside the pieces: below the worst piece by this much.
UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 180_000
# Characters of texts that are cut into words at a time, bytes of text that columns are added to at a time, and ids
# that are looked up at a time: looking up takes 24 bytes for each that is found.
GROUP_CHARS, PART_BYTES, CHUNK_IDS = 1 << 18, 1 << 19, 1 << 16
# Words segmented together, and the longest one that is, or that is remembered.
CHUNK_WORDS, LONG_WORD = 4_000, 64
# Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: numbers, bytes or four-byte floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if tag & 7 == 5 else 8
            yield tag >> 3, np.frombuffer(data[at : at + size], "<f4" if size == 4 else "<f8")[0]
            at += size


@dataclass
class PieceModel:
    """Pieces, scores and types of a model, and whether it puts a space before a text."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    unknown: int = 0
    bytes_: list[int] = field(default_factory=list)

    def __post_init__(self):
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER)):
            raise ValueError("a piece goes on after a space; words could not be segmented on their own")
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        found = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.bytes_ = [found[b] for b in range(256)] if len(found) == 256 else []

    @staticmethod
    def parse(data: bytes) -> PieceModel:
        """From the bytes of a model file; only models without text normalisation are taken."""
        pieces, scores, kinds, prefix = [], [], [], True
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                pieces.append(entry.get(1, b"").decode())
                scores.append(float(entry.get(2, 0.0)))
                kinds.append(entry.get(3, NORMAL))
            elif number == 3:
                norm = dict(_fields(value))
                prefix = bool(norm.get(3, 1))
                if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("the model normalises texts; its decoding would not give them back")
        return PieceModel(pieces, scores, kinds, prefix)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PieceModel:
        """Read by Spark, so the file may be wherever Spark reads."""
        location = path if "://" in path else f"file://{path}"
        return PieceModel.parse(bytes(spark.read.format("binaryFile").load(location).first()["content"]))


class Encoder:
    """Encoding of texts by one automaton; made once per task."""

    def __init__(self, model: PieceModel):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        usable = [i for i, k in enumerate(model.kinds) if k in (NORMAL, USER) and model.pieces[i]]
        for i in usable:
            self.automaton.add_word(model.pieces[i], i)
        if usable:
            self.automaton.make_automaton()
        self.usable = bool(usable)
        self.size = np.array([len(p) for p in model.pieces], np.int64)
        self.score = np.array(model.scores, np.float64)
        self.floor = min((model.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        held = {c for i in usable for c in model.pieces[i]}
        # Between words: a character of no piece, where the automaton falls back to its root.
        self.between = next(c for c in map(chr, range(0xFFFF, 0xE000, -1)) if c not in held)
        # A character of no piece ends every piece before it.
        self.lines = "\n" not in held
        self.memo: dict[str, int] = {}
        self._keep(np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _keep(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        # Segmentation ``code`` is flat[offsets[code]:offsets[code + 1]]; ``used`` counts its occurrences.
        self.flat, self.offsets, self.used = flat, offsets, np.zeros(len(offsets) - 1, np.int64)

    def segment(self, word: str) -> list[int]:
        """Ids of the best segmentation; of equal scores the one whose last piece is longest.

        A character without a piece scores ``floor`` and is spelled in bytes, or is unknown.
        """
        n = len(word)
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        done = 0  # positions up to here are final

        def skip_to(end: int) -> None:
            # A position that no piece of one character reaches takes the unknown character.
            nonlocal done
            while done < end:
                done += 1
                score = best[done - 1] + self.floor
                if piece_of_one[done] < 0 and score > best[done]:
                    best[done], back[done], piece[done] = score, done - 1, -1

        piece_of_one = [-1] * (n + 1)
        for last, ident in self.automaton.iter(word) if self.usable else ():
            end, size = last + 1, len(self.model.pieces[ident])
            skip_to(end - 1)
            if size == 1:
                piece_of_one[end] = ident
            score = self.model.scores[ident] + best[end - size]
            # Output links go from longer pieces to shorter ones.
            if score > best[end]:
                best[end], back[end], piece[end] = score, end - size, ident
        skip_to(n)
        ids, end = [], n
        while end:
            start = back[end]
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids.extend(reversed(self._spell(word[start:end])))
            end = start
        return ids[::-1]

    def segment_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``segment`` of words of at most ``LONG_WORD`` characters: all ids, and how many each word has.

        The relaxation of one position runs over all words at once.
        """
        length = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(length + 1)])
        text = self.between.join(words) + self.between
        pairs = np.dtype([("last", "i4"), ("id", "i4")])
        found = np.fromiter(self.automaton.iter(text) if self.usable else (), pairs)
        word = np.searchsorted(first, found["last"], side="right") - 1
        end, ident = found["last"] - first[word] + 1, found["id"]
        size = self.size[ident]
        # Positions that no piece of one character reaches may take the unknown character.
        open_ = np.arange(1, LONG_WORD + 1) <= length[:, None]
        open_[word[size == 1], end[size == 1] - 1] = False
        best = np.full((len(words), LONG_WORD + 1), -np.inf)
        best[:, 0] = 0.0
        piece = np.full((len(words), LONG_WORD + 1), -1, np.int32)
        # Matches come by word and place, the longest piece first; the sort by place leaves the rest as it is.
        order = np.argsort(end.astype(np.uint8), kind="stable")
        word, end, ident, size = word[order], end[order], ident[order], size[order]
        gain = self.score[ident]
        border = np.searchsorted(end, np.arange(1, LONG_WORD + 2))
        for p in range(1, int(length.max(initial=0)) + 1):
            at = slice(border[p - 1], border[p])
            if at.start < at.stop:
                w = word[at]
                total = gain[at] + best[w, p - size[at]]
                starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                counts = np.diff(np.concatenate([starts, [len(w)]]))
                hit = np.flatnonzero(total == np.repeat(np.maximum.reduceat(total, starts), counts))
                # Of equal scores the first, that is the longest piece.
                hit = hit[np.concatenate([[True], w[hit[1:]] != w[hit[:-1]]])]
                best[w[hit], p], piece[w[hit], p] = total[hit], ident[at][hit]
            w = np.flatnonzero(open_[:, p - 1])
            total = best[w, p - 1] + self.floor
            w, total = w[total > best[w, p]], total[total > best[w, p]]
            best[w, p], piece[w, p] = total, -1
        left, place, turns = np.flatnonzero(length > 0), length.copy(), []
        while len(left):
            ids = piece[left, place[left]]
            place[left] -= np.where(ids < 0, 1, self.size[ids])
            turns.append((left, ids, place[left]))
            left = left[place[left] > 0]
        if not turns:
            return np.zeros(0, np.int64), length
        # From the last piece to the first.
        w, ids, begin = (np.concatenate(x[::-1]) for x in zip(*turns))
        order = np.argsort(w, kind="stable")
        w, ids, begin = w[order], ids[order], begin[order]
        spelled = {i: self._spell(words[w[i]][begin[i]]) for i in np.flatnonzero(ids < 0).tolist()}
        many = np.ones(len(ids), np.int64)
        many[list(spelled)] = [len(x) for x in spelled.values()]
        out, at = np.repeat(ids, many), np.cumsum(many) - many
        for i, x in spelled.items():
            out[at[i] : at[i] + len(x)] = x
        return out, np.bincount(w, weights=many, minlength=len(words)).astype(np.int64)

    def _spell(self, character: str) -> list[int]:
        if not self.model.bytes_:
            return [self.model.unknown]
        return [self.model.bytes_[b] for b in character.encode("utf-8", "surrogatepass")]

    def _learn(self, words: list[str]) -> None:
        """Remember the segmentations of new words."""
        words.sort(key=len)
        # Long words, and those that hold the character between words, are rare: one by one.
        alone = [w for w in words if len(w) > LONG_WORD or self.between in w]
        if alone:
            several = set(alone)
            words = [w for w in words if w not in several]
        learned, counts = [], []
        for begin in range(0, len(words), CHUNK_WORDS):
            ids, n = self.segment_all(words[begin : begin + CHUNK_WORDS])
            learned.append(ids)
            counts.append(n)
        for w in alone:
            learned.append(np.array(self.segment(w), np.int64))
            counts.append(np.array([len(learned[-1])]))
        words += alone
        self.memo.update(zip(words, range(len(self.used), len(self.used) + len(words))))
        self.flat = np.concatenate([self.flat, *learned]).astype(np.int32)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(counts))])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])

    def _forget(self) -> None:
        """Drop the rarer half of what is remembered, and all long words."""
        codes = np.fromiter(self.memo.values(), np.int64, len(self.memo))
        rare = np.median(self.used[codes]) if len(codes) > MEMO_WORDS else -1
        kept = [(w, c) for w, c in self.memo.items() if self.used[c] > rare and len(w) <= LONG_WORD]
        codes = np.array([c for _, c in kept], np.int64)
        self.memo = {w: i for i, (w, _) in enumerate(kept)}
        size = np.diff(self.offsets)[codes]
        flat, used = self.flat[_spans(self.offsets[codes], size)], self.used[codes]
        self._keep(flat, np.concatenate([[0], np.cumsum(size)]))
        self.used = used // 2

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the places where each text's begin; one more for the end."""
        found, sizes, begin = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and (end == begin or held + len(texts[end]) <= GROUP_CHARS):
                held += len(texts[end])
                end += 1
            ids, size = self._encode_group(texts[begin:end])
            found.append(ids)
            sizes.append(size)
            begin = end
        return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _encode_group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, and how many each has."""
        per_text, words = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            if text:
                marked = text.replace(" ", SPACE)
                # Cut before each mark; a run of marks is cut only before its first, and the last of the
                # run goes with the word behind it or not, as the scores say.
                some = _words(SPACE + marked if self.model.dummy_prefix else marked, self.lines)
                per_text[i] = len(some)
                words += some
        new = list(set(words).difference(self.memo))
        if new:
            self._learn(new)
        code = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        self.used += np.bincount(code, minlength=len(self.used))
        size = np.diff(self.offsets)[code]
        ids = _gather(self.flat, self.offsets[code], size)
        ends = np.concatenate([[0], np.cumsum(size)])
        offsets = ends[np.concatenate([[0], np.cumsum(per_text)])]
        if len(self.memo) > MEMO_WORDS or any(len(w) > LONG_WORD for w in new):
            self._forget()
        return ids, np.diff(offsets)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start[i] … start[i] + size[i] - 1`` one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What ``flat`` holds at ``_spans(start, size)``, found for some spans at a time."""
    some = [slice(at, at + CHUNK_IDS) for at in range(0, len(start), CHUNK_IDS)]
    return np.concatenate([flat[:0], *[flat[_spans(start[x], size[x])] for x in some]])


class Decoder:
    """The bytes of every piece in one array."""

    def __init__(self, model: PieceModel):
        spelled = [_spelled(p, k) for p, k in zip(model.pieces, model.kinds)]
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.prefix = model.dummy_prefix

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of ids that ``encode_all`` gave: whole characters, one space before each text."""
        size = self.size[ids]
        data = _gather(self.data, self.start[ids], size)
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        if self.prefix and len(data):
            spaced = ends[:-1] < ends[1:]
            spaced[spaced] = data[ends[:-1][spaced]] == ord(" ")
            data = np.delete(data, ends[:-1][spaced])
            ends = ends - np.concatenate([[0], np.cumsum(spaced)])
        wide = ends[-1] >= 2**31
        kind, width = (pa.large_string(), np.int64) if wide else (pa.string(), np.int32)
        parts = [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(np.ascontiguousarray(data))]
        return pa.Array.from_buffers(kind, len(ends) - 1, parts)


def _spelled(piece: str, kind: int) -> bytes:
    if kind == BYTE:
        return bytes([int(piece[3:5], 16)])
    if kind == UNKNOWN:
        return " ⁇ ".encode()
    return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()


def _words(marked: str, lines: bool = False) -> list[str]:
    """Words that are segmented on their own: cut at space marks and, with ``lines``, at line breaks too."""
    if lines and "\n" in marked:
        return [w for i, part in enumerate(marked.split("\n")) for w in (["\n"] if i else []) + (_words(part) if part else [])]
    pieces = marked.split(SPACE)
    if "" not in pieces[1:-1] and pieces[-1]:
        words = [SPACE + p for p in pieces[1:]]
        return [pieces[0], *words] if pieces[0] else words
    import re

    return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", marked)


def decode_ids(model: PieceModel, ids: list[int]) -> str:
    """The text of a list of ids; bytes that are not UTF-8 become replacement characters."""
    out = bytearray()
    for i in ids:
        kind = model.kinds[i]
        if kind == BYTE:
            out.append(int(model.pieces[i][3:5], 16))
        elif kind == UNKNOWN:
            out += " ⁇ ".encode()
        elif kind != CONTROL:
            out += model.pieces[i].encode()
    text = out.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def _shared(spark: SparkSession, model: PieceModel):
    # A model has a fixed number of pieces; it does not grow with the data.
    return spark.sparkContext.broadcast(model)


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: PieceModel, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of every text, as ``array<int>``; null and empty texts have none.

    Repeated rows are encoded each, texts may be of any length, and an empty table gives an empty one. Other
    columns stay; one with the name of the new column is replaced.
    """
    shared = _shared(docs.sparkSession, model)

    def kernel():
        encoder = Encoder(shared.value)
        return lambda texts: [_lists(*encoder.encode_all(texts))]

    return add_columns(docs, text, f"{out} array<int>", kernel, PART_BYTES)


def round_trip(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``decoded``, the text that they give back.

    A null text counts as empty: no ids, and an empty text. Otherwise as ``encode``.
    """
    shared = _shared(docs.sparkSession, model)

    def kernel():
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)

        def run(texts: list[str]) -> list[pa.Array]:
            found = encoder.encode_all(texts)
            return [_lists(*found), decoder.decode_all(*found)]

        return run

    return add_columns(docs, text, "ids array<int>, decoded string", kernel, PART_BYTES)
