"""Token counts: batch encoding in Arrow functions that return lengths only.

A task cuts long texts at safe boundaries, fills batches of about equal bytes with the parts of many texts, hands each
batch to the tokenizer in one call and adds the lengths up by row; ids never leave the function. One narrow pass.

A boundary is safe where no token can lie across it. For a SentencePiece vocabulary that is read off the vocabulary:
merging only ever makes pieces, so two neighbouring characters that no piece holds side by side are never joined. For
a tokenizer file it is the blank between two ASCII letters or digits, at which its splitting into words always parts.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BATCH_BYTES, PART_CHARS = 1 << 20, 1 << 15


class PieceCounter:
    """Lengths by a SentencePiece model (identity normalisation, a blank put in front, runs of blanks kept)."""

    #: stands before a later part; a byte token of its own, so that the blank put in front is never joined to the part
    GUARD = "\n"

    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())
                  if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.joined = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        size = lambda x: len(self.sp.encode(x))                        # noqa: E731
        self.guard = size(self.GUARD)
        # without these properties a text is encoded in one piece
        self.splits = (not any(self.GUARD in p for p in pieces) and size(self.GUARD * 2) == self.guard + 1
                       and self.sp.encode("   a") != self.sp.encode("a"))

    def cut(self, text: str, size: int) -> list[tuple[str, int]]:
        """Parts of ``text`` and the tokens to take off each."""
        parts, at, off = [], 0, 0
        while len(text) - at > size and self.splits:
            to = at + size
            while to < len(text) and self._join(text[to - 1:to + 1]):
                to += 1
            if to == len(text):
                break
            parts.append(((self.GUARD if at else "") + text[at:to], off))
            at, off = to, self.guard
        return [*parts, ((self.GUARD if at else "") + text[at:], off)]

    def _join(self, two: str) -> bool:
        return two.replace(" ", "▁") in self.joined

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(ids) for ids in self.sp.encode(parts, num_threads=1)]


class FileCounter:
    """Lengths by a tokenizer file; special strings inside texts are handled as the library's default does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.blank = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

    def cut(self, text: str, size: int) -> list[tuple[str, int]]:
        parts, at = [], 0
        while len(text) - at > size and (m := self.blank.search(text, at + size)):
            parts.append((text[at:m.start()], 0))
            at = m.start()
        return [*parts, (text[at:], 0)]

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]


def counter(path: str) -> PieceCounter | FileCounter:
    return (PieceCounter if path.endswith(".model") else FileCounter)(path)


def count_all(c, texts: list[str], batch_bytes: int, part_chars: int) -> np.ndarray:
    """Tokens of each text. Parts of all texts are dealt, in order, to batches of about ``batch_bytes``."""
    total = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    rows: list[int] = []
    held = 0

    def send():
        np.add.at(total, rows, c.lengths(parts))
        parts.clear(), rows.clear()

    for row, text in enumerate(texts):
        for part, off in c.cut(text, part_chars) if text else ():
            total[row] -= off
            parts.append(part)
            rows.append(row)
            held += len(part) if part.isascii() else len(part.encode())
            if held >= batch_bytes:
                send()
                held = 0
    if parts:
        send()
    return total


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, batch_bytes: int = BATCH_BYTES,
                 part_chars: int = PART_CHARS, make: Callable = counter) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) of every text.

    A null or empty text has no byte and no token. Very long texts are cut at safe boundaries and counted whole; a run
    without one is encoded in one piece. A null doc_id stays null; repeated rows are counted each for itself; an empty
    table gives no row. Other columns are ignored, whatever their names.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None                                                       # one tokenizer a task, gone with it
        for b in batches:
            if b.num_rows:
                c = c or make(tokenizer)
                n = count_all(c, [t or "" for t in b.column(2).to_pylist()], batch_bytes, part_chars)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
            .mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
            .withColumn("over_limit", F.col("n_tokens") > limit))
