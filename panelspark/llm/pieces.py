"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A vocabulary of scored pieces cuts a text into the pieces with the greatest sum of
scores. Spaces become ``▁`` and one is put before the text, as the model file says.
Since no piece goes on past a ``▁`` that follows another character, the text falls into
words that are cut one by one: different words of one length advance together. The hashes of
all their substrings of 1, 2, ... characters probe the sorted keys of all pieces (a table
of bits rules most out first), and one character a step the maxima over the pieces that
end there give scores and backpointers;
of equal sums the longest last piece wins. A character that no piece covers becomes its
UTF-8 bytes, and so does a ``▁`` of the text itself. Decoding joins pieces and bytes, and gives back every text of valid
characters exactly; ids outside the vocabulary and control pieces decode to nothing.

Nulls: a null text encodes like an empty one, to no pieces; null ids decode to an empty text.
Rows may repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BASE

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a ``▁`` of the text itself: no text of valid characters holds it, no piece covers it, so it becomes bytes.
OWN = "\udfff"
PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Score of a character without a piece, below any sum of pieces of a word.
UNKNOWN = -1e7
#: Words of one length that advance together at most.
TOGETHER = 20_000
#: Cut words that a worker keeps at most between its batches.
KEPT = 500_000
#: Bits of the table that rules out most substrings before the search, and the factor that spreads keys over it.
MAY_BITS = 20
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]``, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Pieces:
    """The vocabulary of a model file, and the words cut so far."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.names = names = [sp.id_to_piece(i) for i in range(n)]
        self.byte = byte = {i: int(names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = np.zeros(256, np.int64)
        for i, b in byte.items():
            self.byte_id[b] = i
        plain = [i for i in range(n) if i not in byte and not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i)]
        shown = set(plain)
        parts = [bytes([byte[i]]) if i in byte else names[i].replace(SPACE, " ").encode() if i in shown else b"" for i in range(n)]
        self.part_sizes = np.array([len(p) for p in parts], np.int64)
        self.part_starts = np.cumsum(self.part_sizes) - self.part_sizes
        self.parts = np.frombuffer(b"".join(parts), np.uint8)
        self.is_byte = np.array([i in byte for i in range(n)])
        self.longest = max(len(names[i]) for i in plain)
        keys = np.array([self.hash_of(names[i]) for i in plain], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], np.array(plain, np.int64)[order]
        self.scores = np.array([max(sp.get_score(i), UNKNOWN / 10) for i in plain])[order]
        self.may = np.zeros(1 << MAY_BITS, bool)
        self.may[self._spot(keys)] = True
        self.prefix = sp.encode("a", out_type=str)[0].startswith(SPACE)
        self._forget()

    @staticmethod
    def hash_of(piece: str) -> int:
        """The hash that ``cut`` computes for these characters."""
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    @staticmethod
    def _spot(keys: np.ndarray) -> np.ndarray:
        """Places in the table of keys that may be there."""
        with np.errstate(over="ignore"):
            return (keys * SPREAD) >> np.uint64(64 - MAY_BITS)

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of words that all have one length, word after word, and how many each has."""
        length, n = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).T.astype(np.uint64) + np.uint64(1)
        found, h = [], np.zeros((length + 1, n), np.uint64)
        for size in range(1, min(self.longest, length) + 1):
            # row j: the hash of the ``size`` characters from j on
            with np.errstate(over="ignore"):
                h = h[: length - size + 1] * BASE + codes[size - 1 :]
            hit = np.flatnonzero(self.may[self._spot(h)])
            key = h.reshape(-1)[hit]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            true = self.keys[at] == key
            hit, at = hit[true], at[true]
            found.append((hit % n, at, np.searchsorted(hit, np.arange(length - size + 2) * n).tolist()))
        best = np.zeros((length + 1, n))
        back, took = np.ones((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int64)
        for end in range(1, length + 1):
            np.add(best[end - 1], UNKNOWN, out=best[end])
            for size in range(1, min(self.longest, end) + 1):
                row, at, starts = found[size - 1]
                a, z = starts[end - size], starts[end - size + 1]
                if a == z:
                    continue
                row, at = row[a:z], at[a:z]
                total = best[end - size, row] + self.scores[at]
                win = total >= best[end, row]
                row = row[win]
                best[end, row] = total[win]
                back[end, row] = size
                took[end, row] = self.ids[at[win]]
        # back from the words' ends; a step of a word that is done is -2
        end, rows, steps = np.full(n, length), np.arange(n), []
        while (left := end > 0).any():
            steps.append(np.where(left, took[end, rows], -2))
            end = end - np.where(left, back[end, rows], 0)
        path = np.stack(steps[::-1], 1)
        if (odd := np.flatnonzero((path == -1).any(1))).size:
            return self._with_bytes(words, path, set(odd.tolist()))
        return path[path >= 0], (path >= 0).sum(1)

    def _with_bytes(self, words: list[str], path: np.ndarray, odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """As ``cut`` returns, with bytes for the characters of the words ``odd`` that no piece covers."""
        flat, sizes = [], []
        for i, (word, row) in enumerate(zip(words, path.tolist(), strict=True)):
            ids = [x for x in row if x != -2]
            if i in odd:
                out, at = [], 0
                for x in ids:
                    out += [x] if x >= 0 else self.byte_id[list((SPACE if word[at] == OWN else word[at]).encode("utf-8", "replace"))].tolist()
                    at += len(self.names[x]) if x >= 0 else 1
                ids = out
            flat += ids
            sizes.append(len(ids))
        return np.array(flat, np.int64), np.array(sizes, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [PART.findall((SPACE if self.prefix else "") + t.replace(SPACE, OWN).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.seen) > KEPT:
            self._forget()
        by: dict[int, list[str]] = {}
        for w in set().union(*parts).difference(self.seen):
            by.setdefault(len(w), []).append(w)
        flat, sizes = [self.flat], [self.sizes]
        for length, words in by.items():
            step = max(1, min(TOGETHER, 2_000_000 // length))
            for k in range(0, len(words), step):
                ids, count = self.cut(words[k : k + step])
                flat.append(ids.astype(np.int32))
                sizes.append(count)
            self.seen.update(zip(words, range(len(self.seen), len(self.seen) + len(words)), strict=True))
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        out = []
        for p in parts:
            which = np.fromiter(map(self.seen.__getitem__, p), np.int64, len(p))
            out.append(gather(self.flat, starts[which], self.sizes[which]))
        return out

    def decode(self, ids: list[int] | np.ndarray | None) -> str:
        ids = np.asarray([] if ids is None else ids, np.int64)
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.is_byte)):
            ids = ids[(ids >= 0) & (ids < len(self.is_byte))]
        text = gather(self.parts, self.part_starts[ids], self.part_sizes[ids]).tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)
def pieces_of(model: str) -> Pieces:
    """The vocabulary, read once by each worker."""
    return Pieces(model)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pieces.encode(part.column(1).to_pylist()), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, n_pieces, n_byte_pieces, ids_sha256, same)``: the pieces of every text, and whether decoding them gives it back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = part.column(1).to_pylist()
                ids = pieces.encode(texts)
                rows = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(pieces.is_byte[x].sum()) for x in ids], pa.int64())]
                rows += [pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]), pa.array([pieces.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)])]
                yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "same"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, same boolean")
