"""Sorted hash arrays in the shared folder, one file per range of hashes, memory-mapped by the tasks that read them.

Spark deals rows to files by the top bits of a 64-bit hash, so files are of even size whatever the keys; their number
follows the row count. A file is written under a name of its own attempt and then renamed, so a repeated or
speculative task leaves one whole file. Readers map a file when they first need it; on a store that can't be mapped
the file is copied into an unnamed temporary file first.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, functions as F

ROWS_PER_FILE = 400_000


def files_for(rows: int) -> int:
    """A power of two, so that the top bits of a hash name the file."""
    return 1 << max(0, (max(rows, 1) - 1) // ROWS_PER_FILE).bit_length()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def hash_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word, as the 64 that order a file and 64 that confirm a match."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def file_number(hashes: np.ndarray, files: int) -> np.ndarray:
    bits = files.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def file_column(h: Column, files: int) -> Column:
    """The same number from a signed long column."""
    bits = files.bit_length() - 1
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _filesystem(folder: str):
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> int:
    """Write named arrays to one file; returns its bytes."""
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}-{uuid.uuid4().hex}"
    head, at, blocks = [], 0, []
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append(f"{k} {a.dtype.str} {len(a)} {at}")
        blocks.append(a)
        at += -(-a.nbytes // 64) * 64
    text = "\n".join(head).encode()
    with fs.open_output_stream(tmp) as out:
        out.write(len(text).to_bytes(8, "little") + text + b" " * (-(8 + len(text)) % 64))
        for a in blocks:
            if a.nbytes:
                out.write(pa.py_buffer(a))
            out.write(bytes(-a.nbytes % 64))
    fs.move(tmp, f"{base}/{name}")
    return at


def load(folder: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, mapped rather than read; None where no task wrote one (no row fell into it)."""
    fs, base = _filesystem(folder)
    path = f"{base}/{name}"
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
    else:
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as src:
            while chunk := src.read(1 << 22):
                copy.write(chunk)
            copy.flush()
            raw = np.memmap(copy, dtype=np.uint8, mode="r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    start, out = -(-(8 + n) // 64) * 64, {}
    for line in raw[8:8 + n].tobytes().decode().splitlines():
        k, kind, count, at = line.split(" ")
        kind = np.dtype(kind)
        out[k] = raw[start + int(at):start + int(at) + int(count) * kind.itemsize].view(kind)
    return out


_OPEN: OrderedDict[tuple[str, str], dict] = OrderedDict()


def opened(folder: str, name: str, keep: int = 4096) -> dict[str, np.ndarray] | None:
    """``load`` with the maps kept open in this worker; the oldest are closed beyond ``keep``."""
    key = (folder, name)
    if key not in _OPEN:
        _OPEN[key] = load(folder, name)
        while len(_OPEN) > keep:
            _OPEN.popitem(last=False)
    return _OPEN[key]


def find(folder: str, files: int, hashes: np.ndarray):
    """For every file that ``hashes`` touch: (places in ``hashes``, rows in the file, its arrays), found ones only."""
    order = np.argsort(hashes, kind="stable")
    number = file_number(hashes[order], files)
    cuts = np.flatnonzero(np.diff(number)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        arrays = opened(folder, f"part-{int(file_number(hashes[part[:1]], files)[0]):06d}")
        if arrays is None:
            continue
        keys = arrays["hash"]
        row = np.searchsorted(keys, hashes[part])
        hit = row < len(keys)
        hit[hit] = keys[row[hit]] == hashes[part][hit]
        yield part[hit], row[hit], arrays
