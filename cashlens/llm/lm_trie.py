"""Bigram language model in an Elias-Fano trie of memory-mapped files.

Levels. *Words*: 64-bit hashes of the training words in order, Elias-Fano coded, with exact counts; a word's id is its
rank. *Successors*: for every context word the ids of the words that follow it, as one monotone sequence
``context * words + successor``, Elias-Fano coded; monotone Elias-Fano pointers give each context's part of it, and a
successor is searched relative to its context between two pointers. Each successor has one byte: the number of a
smoothed log-probability in its file's codebook, 256 even steps from the least to the greatest (off by 1/510 of that at most).

Smoothing: p(w | u) = (c(u w) + k p(w)) / (c(u) + k), with p(w) = (c(w) + 1) / (N + V + 1); a pair not met needs its two
words' counts only. k maximises the leave-one-out likelihood of all training pairs over a grid.

Work on Spark: tasks count words, then pairs, of their documents; word counts are aggregated rows, pair counts travel
as compressed sorted runs, dealt to a grid of (context range, successor range) files that grows with the input, so
that a context with a third of all pairs is spread over a row of the grid. Ids are ranks of hashes, so ranges are even.
Files are written by tasks to the shared folder and mapped by the tasks that score; a scoring task asks only for the
distinct pairs of its documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cashlens.llm.common import held_out, per_batch, shared_folder, stage
from cashlens.llm.eliasfano import EliasFano
from cashlens.llm.hashfile import ROWS_PER_FILE, file_column, file_number, files_for, hash_words, opened, save

END = b" "                                                              # no word holds a blank
GRID_K = tuple(2.0 ** i for i in range(-2, 21))
LOT = 3000                                                              # documents handled at once in a task


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


class Lot:
    """Token numbers of some documents: ``ids`` into ``words``, documents side by side."""

    def __init__(self, texts: list):
        number: dict[bytes, int] = {}
        size, ids = [], []
        for t in texts:
            w = tokens(t)
            for x in w:
                if x not in number:
                    number[x] = len(number)
            ids.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
            size.append(len(w))
        self.words, self.ids, self.size = list(number), np.concatenate(ids), np.array(size)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Context and successor of every token; the context of a first token is -1."""
        u = np.empty_like(self.ids)
        u[1:] = self.ids[:-1]
        u[self.start] = -1
        return u, self.ids


class Words:
    """First level: ids and counts of hashes over the files of a folder."""

    def __init__(self, folder: str, files: int, first: list[int], total: int, size: int, documents: int):
        self.folder, self.files, self.first = folder, files, np.array(first, np.int64)   # id of each file's first word
        self.total, self.size, self.documents = total, size, documents

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of words."""
        h = hash_words(words)
        out, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        number = file_number(h, self.files)
        order = np.argsort(number, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
            f = self.file(int(number[part[0]]))
            if f is None:
                continue
            at = f["ef"].place(h[part] & np.uint64((1 << self.bits) - 1))
            hit = at >= 0
            out[part[hit]] = at[hit] + self.first[number[part[0]]]
            count[part[hit]] = f["count"][at[hit]]
        return out, count

    @property
    def bits(self) -> int:
        return 64 - (self.files.bit_length() - 1)

    def file(self, n: int):
        f = opened(self.folder, f"part-{n:06d}")
        if f is not None and "ef" not in f:
            f["ef"] = EliasFano(f, "hash")
        return f

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of known ids; id ``size`` is the start of a document."""
        out = np.full(len(ids), self.documents, np.int64)
        number = np.searchsorted(self.first, ids, side="right") - 1
        number[ids == self.size] = -1
        for n in np.unique(number[number >= 0]):
            at = np.flatnonzero(number == n)
            out[at] = self.file(int(n))["count"][ids[at] - self.first[n]]
        return out


def learn_words(train: DataFrame) -> Words:
    def count(batch: pa.RecordBatch):
        texts = batch.column(0).to_pylist()
        for lo in range(0, len(texts), LOT):
            lot = Lot(texts[lo:lo + LOT])
            n = np.bincount(lot.ids, minlength=len(lot.words))
            yield pa.RecordBatch.from_arrays([pa.array(hash_words(lot.words).view(np.int64)), pa.array(n)], names=["h", "c"])

    table = stage(per_batch(train, ["text"], count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "lm-words")
    folder = shared_folder(train.sparkSession, "lm-words")
    files = files_for(table.count())
    bits = 64 - (files.bit_length() - 1)

    def write(key, rows):
        h = rows["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        c = rows["c"].to_numpy()[order]
        low = h[order] & np.uint64((1 << bits) - 1)
        # 2^64 itself is no universe for one file: hashes are coded without the bits that name the file
        save(folder, f"part-{key[0].as_py():06d}", {**EliasFano.build(low, (1 << bits) - 1, "hash"), "count": c.astype(np.int64 if c.max() > 2**32 - 1 else np.uint32)})
        end = int(c[h[order] == hash_words([END])[0]].sum())
        return pa.table({"part": [key[0].as_py()], "n": [len(c)], "total": [int(c.sum())], "end": [end]})

    parts = {r["part"]: r for r in table.withColumn("part", file_column(F.col("h"), files).cast("long")).groupBy("part")
             .applyInArrow(write, "part bigint, n bigint, total bigint, end bigint").collect()}     # a row a file
    sizes = [parts[i]["n"] if i in parts else 0 for i in range(files)]
    return Words(folder, files, np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist(), sum(p["total"] for p in parts.values()),
                 sum(sizes), sum(p["end"] for p in parts.values()))


class Grid:
    """Files by (context range, successor range): ``side`` squared of them over ids 0 .. size."""

    def __init__(self, size: int, pairs: int):
        self.side = max(1, math.isqrt(max(1, pairs) // ROWS_PER_FILE) + 1)
        self.size, self.step = size, size // self.side + 1

    def number(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return u // self.step * self.side + w // self.step


def squeeze(key: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as gaps, byte planes apart, and counts; both compressed."""
    gaps = np.diff(key, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return (pa.compress(np.ascontiguousarray(gaps).tobytes(), codec="zstd", asbytes=True),
            pa.compress(count.astype("<u4").tobytes(), codec="zstd", asbytes=True))


def spread(n: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(keys, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    gaps = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(pa.decompress(counts, 4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64)


RUN = "part bigint, n bigint, keys binary, counts binary"


def count_pairs(train: DataFrame, words: Words, grid: Grid) -> DataFrame:
    """One merged run of pairs (context << 32 | successor) for every file of the grid, with its leave-one-out sums."""
    def count(batch: pa.RecordBatch):
        texts = batch.column(0).to_pylist()
        for lo in range(0, len(texts), LOT):
            lot = Lot(texts[lo:lo + LOT])
            ids = words.ids(lot.words)[0]
            u, w = lot.pairs()
            key, n = np.unique(np.where(u < 0, words.size, ids[u]).astype(np.uint64) << np.uint64(32) | ids[w].astype(np.uint64), return_counts=True)
            part = grid.number((key >> np.uint64(32)).astype(np.int64), (key & np.uint64(2**32 - 1)).astype(np.int64))
            order = np.argsort(part, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]])
            rows = [(int(part[order[a]]), int(b - a), *squeeze(key[order[a:b]], n[order[a:b]])) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                             names=["part", "n", "keys", "counts"])

    def merge(key, rows):
        runs = [spread(n, a, b) for n, a, b in zip(*(rows[c].to_pylist() for c in ("n", "keys", "counts")))]
        k, c = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        order = np.argsort(k)
        k, c = k[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, c = k[at], np.add.reduceat(c, at)
        cu = words.counts((k >> np.uint64(32)).astype(np.int64)).astype(np.float64)
        pw = (words.counts((k & np.uint64(2**32 - 1)).astype(np.int64)) + 1.0) / (words.total + words.size + 1.0)
        fit = [float((c * np.log((c - 1 + g * pw) / (cu - 1 + g))).sum()) for g in GRID_K]
        keys, counts = squeeze(k, c)
        return pa.table({"part": [key[0].as_py()], "n": [len(k)], "keys": pa.array([keys], pa.binary()), "counts": pa.array([counts], pa.binary()), "fit": [fit]})

    return stage(per_batch(train, ["text"], count, RUN).groupBy("part").applyInArrow(merge, RUN + ", fit array<double>"), "lm-pairs")


def write_successors(pairs: DataFrame, words: Words, grid: Grid, k: float, folder: str) -> None:
    def write(batch: pa.RecordBatch):
        for part, n, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            key, c = spread(n, keys, counts)
            u, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(2**32 - 1)).astype(np.int64)
            pw = (words.counts(w) + 1.0) / (words.total + words.size + 1.0)
            logp = np.log10((c + k * pw) / (words.counts(u) + k))
            book = np.linspace(logp.min(), logp.max(), 256).astype(np.float32)
            middle = (book[1:].astype(np.float64) + book[:-1]) / 2
            first = part // grid.side * grid.step
            rel = (u - first).astype(np.uint64) * np.uint64(words.size) + w.astype(np.uint64)
            contexts = min(grid.step, words.size + 1 - first)
            pointer = np.searchsorted(u, np.arange(first, first + contexts + 1))
            save(folder, f"part-{part:06d}", {**EliasFano.build(rel, contexts * words.size, "next"), **EliasFano.build(pointer, n, "pointer"),
                                              "book": book, "code": np.searchsorted(middle, logp).astype(np.uint8)})
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    per_batch(pairs, ["part", "n", "keys", "counts"], write, "n bigint").agg(F.sum("n")).first()


def successor_logs(folder: str, words: Words, grid: Grid, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-probabilities of stored pairs of known ids; NaN for pairs not met."""
    out = np.full(len(u), np.nan)
    part = grid.number(u, w)
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        p = int(part[at[0]])
        f = opened(folder, f"part-{p:06d}")
        if f is None:
            continue
        if "ef" not in f:
            f["ef"], f["ptr"] = EliasFano(f, "next"), EliasFano(f, "pointer")
        rel = u[at] - p // grid.side * grid.step
        some, back = np.unique(rel, return_inverse=True)                # each context's two pointers once
        lo, hi = f["ptr"].get(some).astype(np.int64)[back], f["ptr"].get(some + 1).astype(np.int64)[back]
        row = f["ef"].place(rel.astype(np.uint64) * np.uint64(words.size) + w[at].astype(np.uint64), lo, hi)
        hit = row >= 0
        out[at[hit]] = f["book"][f["code"][row[hit]]]
    return out


def score(docs: DataFrame, folds: int = 7) -> DataFrame:
    """Every document's log10 probability: doc_id, n_tokens, n_known, train_tokens, base_score, score, oov_share.

    Learns from the rows that are not held out. A null or empty text is its end token alone; null keys are learnt from
    and kept; repeated rows count each time; an empty table gives no row; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = docs.where(~held_out(F.col("doc_id"), folds))
    words = learn_words(train)
    grid = Grid(words.size, 0)
    folder, k = shared_folder(docs.sparkSession, "lm-next"), GRID_K[-1]
    if words.size:
        if words.size >= 2**32 - 1:
            raise ValueError("more than 2^32 distinct words")
        grid = Grid(words.size, words.total // 3)                       # about a third of the pairs are distinct
        pairs = count_pairs(train, words, grid)
        fit = pairs.agg(*[F.sum(F.get("fit", F.lit(i))).alias(f"k{i}") for i in range(len(GRID_K))]).first()
        k = max(GRID_K, key=lambda g: fit[f"k{GRID_K.index(g)}"])
        write_successors(pairs, words, grid, k, folder)
    log_all = math.log10(words.total + words.size + 1)

    def run(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        for lo in range(0, len(texts), LOT):
            lot = Lot(texts[lo:lo + LOT])
            ids, count = words.ids(lot.words) if words.size else (np.full(len(lot.words), -1), np.zeros(len(lot.words), np.int64))
            low = np.log10(count + 1.0) - log_all                       # log p(w)
            base, known = low[lot.ids], (count > 0)[lot.ids]
            u, w = lot.pairs()
            key, back = np.unique((u + 1) << 32 | w, return_inverse=True)
            a, b = (key >> 32) - 1, key & (2**32 - 1)
            gu = np.where(a < 0, words.size, ids[a])
            cu = np.where(a < 0, words.documents, count[a]).astype(np.float64)
            logs = math.log10(k) + low[b] - np.log10(cu + k)
            ask = np.flatnonzero((gu >= 0) & (ids[b] >= 0)) if words.size else np.zeros(0, np.int64)
            got = successor_logs(folder, words, grid, gu[ask], ids[b][ask])
            logs[ask] = np.where(np.isnan(got), logs[ask], got)
            n = len(lot.size)
            known = np.add.reduceat(known.astype(np.int64), lot.start)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(lot.size.astype(np.int64)), pa.array(known), pa.array(np.full(n, words.total, np.int64)),
                 pa.array(np.add.reduceat(base, lot.start)), pa.array(np.add.reduceat(logs[back], lot.start)), pa.array(1 - known / lot.size)],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "oov_share"])

    return per_batch(docs, ["doc_id", "text"], run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                                    "base_score double, score double, oov_share double")
