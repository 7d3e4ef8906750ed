"""Fill-in-middle by in-place block rotation.

A text becomes a bytearray ``<P>prefix<M>middle<S>suffix``; exchanging two neighbouring blocks, by reversing each and
then both together, gives the wanted order. Restoring finds the sentinels, makes the same exchange backwards and deletes
them. One narrow pass each way: no shuffle, and a task holds one slice of a few MB (or one text) at a time.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

SENTINELS = (b"<P>", b"<S>", b"<M>")
SLICE_BYTES = 4 << 20

# what a byte of UTF-8 is: 0 a letter A-Z or a-z, 1 the start of any other code point, 2 a later byte of one
_KIND = np.ones(256, np.uint8)
_KIND[0x80:0xC0] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 0


def unit_starts(raw: bytes | bytearray) -> np.ndarray:
    """Byte offsets at which the units ``[A-Za-z]+|[^A-Za-z]`` of the text begin."""
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    letter = kind == 0
    begins = kind == 1
    begins[1:] |= letter[1:] & ~letter[:-1]
    begins[:1] |= letter[:1]
    return np.flatnonzero(begins)


def code_points(raw: bytes | bytearray) -> int:
    return int(np.count_nonzero(_KIND[np.frombuffer(raw, np.uint8)] != 2))


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the blocks [lo, mid) and [mid, hi) by three reversals."""
    for a, b in ((lo, mid), (mid, hi), (lo, hi)):
        buf[a:b] = buf[a:b][::-1]


def assemble(buf: bytearray, cut1: int, cut2: int, form: str, sentinels=SENTINELS) -> None:
    """Turn the text in ``buf`` into its fill-in-middle form, in place; cuts are byte offsets."""
    p, s, m = sentinels
    buf[cut2:cut2] = s
    buf[cut1:cut1] = m
    buf[0:0] = p
    suffix = cut2 + len(p) + len(m)
    rotate(buf, 0 if form == "spm" else cut1 + len(p), suffix, len(buf))


def disassemble(buf: bytearray, form: str, sentinels=SENTINELS) -> None:
    """Undo ``assemble``, in place."""
    p, s, m = sentinels
    if form == "spm":
        lo, mid = 0, buf.index(p)
    else:
        lo, mid = buf.index(s), buf.index(m)
    rotate(buf, lo, mid, len(buf))
    for x in (s, m):
        at = buf.index(x)
        del buf[at:at + len(x)]
    del buf[:len(p)]


def draws(seed: str, key: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from the key: the same whatever the partitioning, and in every retry."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12))


def _checked(sentinels) -> None:
    heads = {s[:1] for s in sentinels}
    if len(set(sentinels)) != 3 or len(heads) != 1 or any(s.count(next(iter(heads))) != 1 for s in sentinels):
        raise ValueError("sentinels must differ, begin with one byte, and hold it nowhere else: "
                         "otherwise text beside a sentinel could be taken for one")


def _sliced(batches: Iterator[pa.RecordBatch], fn, column: str) -> Iterator[pa.RecordBatch]:
    """``fn`` on runs of rows that hold about ``SLICE_BYTES`` in the text ``column``; a longer text goes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        number = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield fn(b.slice(lo, hi - lo))


def _strings(rows: list) -> pa.Array:
    return pa.array(rows, pa.binary()).cast(pa.string())


def fill_in_middle(docs: DataFrame, rate: int = 90, suffix_first: int = 20, seed: str = "1", sentinels=SENTINELS) -> DataFrame:
    """Every text in its form: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Of 100 documents ``rate`` are cut, of these ``suffix_first`` in 100 to spm. A null text is empty; empty texts and
    texts that hold a sentinel stay plain, with null lengths. A null doc_id stays null and draws as an empty key;
    repeated rows come out alike, each on its own; very long texts are cut whole; an empty table gives no row. Columns
    besides doc_id and text are ignored, whatever their names.
    """
    _checked(sentinels)

    def build(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, raw in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            buf = bytearray(raw or b"")
            starts = unit_starts(buf)
            n = len(starts)
            h1, h2, h3, h4 = draws(seed, key)
            if not n or h3 % 100 >= rate or any(s in buf for s in sentinels):
                rows.append((n, "plain", None, None, bytes(buf)))
                continue
            first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
            ends = [int(starts[u]) if u < n else len(buf) for u in (first, last)]
            form, chars = "spm" if h4 % 100 < suffix_first else "psm", [code_points(buf[:ends[0]]), code_points(buf[ends[0]:ends[1]])]
            assemble(buf, *ends, form, sentinels)
            rows.append((n, form, *chars, bytes(buf)))
        n, form, prefix, middle, out = zip(*rows)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                                           pa.array(middle, pa.int64()), _strings(out)],
                                          names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _sliced(batches, build, "text"),
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rows: DataFrame, out: str = "restored", sentinels=SENTINELS) -> DataFrame:
    """``rows`` (with output and form) and the text that each was made from, as column ``out``.

    ``out`` must be no column's name; all columns go along. A null output or form gives null, an empty table no row.
    """
    if out.lower() in [c.lower() for c in rows.columns]:
        raise ValueError(f"column {out} exists already")
    _checked(sentinels)
    names = rows.columns

    def undo(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for raw, form in zip(b.column("output").cast(pa.binary()).to_pylist(), b.column("form").to_pylist()):
            if raw is None or form is None:
                texts.append(None)
                continue
            buf = bytearray(raw)
            if form != "plain":
                disassemble(buf, form, sentinels)
            texts.append(bytes(buf))
        return pa.RecordBatch.from_arrays([*b.columns, _strings(texts)], names=[*names, out])

    return rows.mapInArrow(lambda batches: _sliced(batches, undo, "output"), T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
