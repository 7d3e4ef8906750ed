"""Power-of-two packing: each document is cut into pieces of binary lengths, one piece per sequence.

A document of n ids becomes its full sequences of ``max_len`` and then one piece for each binary digit of the rest,
longest first. A piece is a whole sequence of its own bucket (``length``), so no sequence crosses documents, nothing
is padded, and a training step draws sequences of one bucket. Tokenising and cutting are one narrow pass over the
input: no shuffle, and a sequence's number is its input partition and place there, the same when a task is rerun.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from cashlens.llm.common import memo, per_batch

#: Fixed value: how the tokenizer file splits normalised text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
APART = b"\xff" * 4            # ids are below 2^24, so four of their bytes in a row hold a zero
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


class WordEncoder:
    """Ids of a text as packed little-endian 32-bit integers, by memo of its blank-separated chunks.

    White space only separates in this vocabulary, so the ids of a text are those of its chunks in order. Chunks of
    Latin letters are split here and only unseen pieces go to the tokenizer, many in one call; any other chunk goes
    to the tokenizer whole. The memos are emptied when they reach ``room`` entries (some 100 MB each).
    """

    def __init__(self, path: str, room: int = 600_000):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.split, self.room = regex.compile(PIECES + r"|\n").findall, room
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.odd = regex.compile(r"[\x1c-\x1f]").search

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, texts: list[list[str]]) -> None:
        """Fill the memo with every chunk of ``texts``, which are lists of chunks.

        Chunks are split side by side: a line break keeps them apart, and so do four bytes that no id or part of two ids has."""
        if len(self.chunks) > self.room:
            self.chunks.clear()
        if len(self.pieces) > self.room:
            self.pieces.clear()
        known, words, plain, latin = self.chunks, [], [], []
        for c in set().union(*texts).difference(known):
            if c.isascii():
                (words if c.isalpha() else plain).append(c)            # letters alone are one piece
            elif max(c) <= "ɏ":
                latin.append(c)
            else:
                known[c] = self.whole(c)
        lowered = [c.lower() for c in words]
        flat = self.split("\n".join(plain).lower() + "\n" + "".join(map(str.lower, unicodedata.normalize("NFC", "\n".join(latin)))))
        self.learn_pieces([*set(lowered).union(flat).difference(self.pieces, "\n")])
        get = self.pieces.__getitem__
        known.update(zip(words, map(get, lowered)))
        ids = b"".join([APART if p == "\n" else get(p) for p in flat]).split(APART)
        known.update(zip(plain, ids))
        known.update(zip(latin, ids[len(plain) or 1:]))

    def learn_pieces(self, pieces: list[str]) -> None:
        """Pieces side by side in long lines; a blank keeps them apart, and the word numbers say whose the ids are."""
        lines = [pieces[i:i + 400] for i in range(0, len(pieces), 400)]
        for start in range(0, len(lines), 64):
            some = lines[start:start + 64]
            for line, enc in zip(some, self.tok.encode_batch([" ".join(x) for x in some], add_special_tokens=False)):
                ids = np.asarray(enc.ids, dtype="<u4")
                word = np.asarray(enc.word_ids, dtype=np.int64)
                at = np.flatnonzero(np.diff(word, prepend=-1))
                if len(at) == len(line):
                    raw, cut = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
                    self.pieces.update((p, raw[cut[i]:cut[i + 1]]) for i, p in enumerate(line))
                else:  # a piece that the tokenizer splits otherwise beside others
                    self.pieces.update((p, self.whole(p)) for p in line)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not t or not self.odd(t) for t in texts]
        chunks = [t.split() if ok else [] for t, ok in zip(texts, plain)]
        self.learn(chunks)
        get = self.chunks.__getitem__
        return [b"".join(map(get, c)) if ok else self.whole(t) for t, c, ok in zip(texts, chunks, plain)]


def binary_cuts(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of n ids: full sequences first, then the binary digits of the rest, longest first."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << k for k in range(max_len.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids (packed little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``max_len`` must be a power of two. Null and empty texts hold the end id alone; a null doc_id stays null; repeated
    rows are packed each for itself; an empty table gives no piece. Other columns are ignored.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch):
        keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        enc = memo(tokenizer, lambda: WordEncoder(tokenizer), whole_stage=True)
        for lo in range(0, len(texts), 500):
            rows = []
            for key, ids in zip(keys[lo:lo + 500], enc.encode(texts[lo:lo + 500])):
                ids += tail
                n, at = len(ids) // 4, 0
                for size in binary_cuts(n, max_len):
                    rows.append((key, at, size, ids[4 * at:4 * (at + size)], n))
                    at += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return (per_batch(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")], cut, SCHEMA)
            .withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))
