"""N-gram Jaccard join by signature trees.

Texts of equal shingle sets are one class and are compared once. Two classes can reach the threshold only if they
share one of the first ``n - ceil(t n) + 1`` shingles of each in any common order (prefix principle). Shingles are
ordered by their rarest word, as a fixed-size counting sketch of all words of the corpus has it, rarest first: a shingle
with a rare word is hardly shared by chance however large the corpus, and passages that many documents share come late,
as all their words are met often. Every class sharing a prefix shingle meets the smallest class that has
it (its *centre*); all classes that meet at one centre are one group, which so holds every pair that can link there.

A group is searched by a signature tree: leaves are classes in order of size, a node holds the OR of the token bitmaps
below it, their size range and the greatest surplus of tokens over bits. The tree is traversed against itself from the
root, and a pair of nodes is dropped when no pair of sets below can overlap enough. This happens twice: first with the
bitmaps alone, to find the members that have some possible partner (a node pair is also dropped when all below have
one); then over these members' sets, where node pairs whose leaves are all linked are dropped and what remains is compared
exactly. Only links that join two parts of a group come out, fewer than its members.

A group above ``block`` members (or shingles) is split by hash into blocks, and every pair of blocks is a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cashlens.llm.common import components, forgetting, grouped, id_filter, memo, per_batch, stage

SKETCH_BITS, SLICES = 22, 32                                            # counts; rows they travel in
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHash(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 300_000:                                        # 40 MB
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX1
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words; bytes lower-case A-Z only and part at ASCII white space only."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(memo("word hashes", WordHash).__getitem__, w), np.uint64, len(w))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, a text without words has none."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < size:
        h = np.array([len(w)], np.uint64)
        for x in w:
            h = mix(h * MIX2 + x)
        return h
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = mix(h * MIX2 + w[k:len(w) - size + 1 + k])
    return np.unique(h)


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def ordered_shingles(text: str, size: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of ``shingles`` and the sketch's count of each one's rarest word."""
    w = word_hashes(text)
    s = shingles(text, size)
    if len(w) < size:
        return s, np.zeros(len(s), np.int64)
    c = counts[slots(w)].astype(np.int64)
    rarest = np.min([c[k:len(c) - size + 1 + k] for k in range(size)], axis=0)
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = mix(h * MIX2 + w[k:len(w) - size + 1 + k])
    out = np.zeros(len(s), np.int64)
    out[np.searchsorted(s, h)] = rarest                                # equal shingles have equal words
    return s, out


def sketch(docs: DataFrame) -> np.ndarray:
    """How often words fall into each of 2^22 slots, whatever the corpus; as powers of 1.002, so that 16 bits hold any count."""
    def squeeze(counts: np.ndarray) -> bytes:
        return pa.compress(np.asarray(counts, np.int64).tobytes(), codec="zstd", asbytes=True)

    def spread(raw: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(raw, (8 << SKETCH_BITS) // SLICES, codec="zstd", asbytes=True), np.int64)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), 500):
                w = np.concatenate([word_hashes(t or "") for t in texts[lo:lo + 500]])
                at, n = np.unique(slots(w), return_counts=True)
                total[at] += n
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array([task // 64] * SLICES, pa.int64()),
                                          pa.array([squeeze(p) for p in np.split(total, SLICES)], pa.binary())],
                                         names=["slice", "part", "counts"])

    def add(key, rows):
        total = sum(spread(x) for x in rows["counts"].to_pylist())
        return pa.table({"slice": [key[0].as_py()], "part": pa.array([0], pa.int64()), "counts": pa.array([squeeze(total)], pa.binary())})

    form = "slice bigint, part bigint, counts binary"
    got = docs.select("text").mapInArrow(lambda batches: forgetting(count(batches)), form).groupBy("slice", "part").applyInArrow(add, form).groupBy("slice", "part").applyInArrow(add, form)
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint16)
    for r in got.collect():                                            # SLICES rows of fixed size
        out[r["slice"]] = np.log1p(spread(r["counts"])) / np.log(1.002)
    return out.ravel()


def size_class(n):
    """Number of the power of two that holds a set of n: J >= 1/2 only within a class or between neighbours."""
    return np.ceil(np.log2(np.maximum(n, 16))).astype(np.int64)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).view(np.uint64)


def own_bitmap(s: np.ndarray) -> bytes:
    """Four to eight bits for each member."""
    return bitmap(s, 4 << int(size_class(len(s)))).tobytes()


def halved(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the bits, as the hashes' lower bits would have made them."""
    n = maps.shape[1] // 2
    return maps[:, :n] | maps[:, n:]


def members_with_partner(ids: np.ndarray, size: np.ndarray, maps: list[bytes], percent: int, centre: int) -> np.ndarray:
    """Ids for which the bitmaps leave some partner possible, looking at each class of sizes and the next together."""
    if percent < 50:
        raise ValueError("percent must be 50 at least")
    order = np.lexsort((ids, size))
    kind, found = size_class(size[order]), [np.zeros(0, np.int64)]
    for c in np.unique(kind):
        low, high = order[kind == c], order[kind == c + 1]
        m = np.frombuffer(b"".join([maps[i] for i in low]), np.uint64).reshape(len(low), -1)
        if len(high):
            m = np.concatenate([m, halved(np.frombuffer(b"".join([maps[i] for i in high]), np.uint64).reshape(len(high), -1))])
        at = np.concatenate([low, high])
        found.append(Tree(ids[at], size[at], m, percent).with_partner(centre))
    return np.unique(np.concatenate(found))


class Tree:
    """Signature tree over members given by number, set size and bitmap, in order of size."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, maps: np.ndarray, percent: int, fan: int = 8):
        self.ids, self.size, self.percent, self.fan = ids, size, percent, fan
        self.levels = [(maps, size, size, size - np.bitwise_count(maps).sum(1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, over = self.levels[-1]
            at = np.arange(0, len(m), fan)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(over, at)))

    def may(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Node pairs below which some sets may overlap enough."""
        m, lo, hi, over = self.levels[level]
        need, best = self.percent * (lo[a] + lo[b]), np.minimum(hi[a], hi[b])
        ok = (100 + self.percent) * best >= need
        at = np.flatnonzero(ok)
        for cut in np.array_split(at, max(1, len(at) // 4096)):
            shared = np.bitwise_count(m[a[cut]] & m[b[cut]]).sum(1, dtype=np.int64) + np.minimum(over[a[cut]], over[b[cut]])
            ok[cut] = (100 + self.percent) * np.minimum(best[cut], shared) >= need[cut]
        return ok

    def traverse(self, skip):
        """Leaf pairs that may be similar, in bounded lots, depth first. ``skip(level, a, b)``: pairs not to enter."""
        todo = [(len(self.levels) - 1, np.array([0]), np.array([0]))]
        while todo:
            level, a, b = todo.pop()
            keep = ~skip(level, a, b)
            a, b = a[keep], b[keep]
            keep = self.may(level, a, b)
            a, b = a[keep], b[keep]
            if not level:
                yield a[a != b], b[a != b]
                continue
            width, f = len(self.levels[level - 1][0]), self.fan
            for lo in range(0, len(a), 2048):
                p, q = a[lo:lo + 2048], b[lo:lo + 2048]
                x = (p[:, None] * f + np.arange(f)).repeat(f, 1).ravel()
                y = np.tile(q[:, None] * f + np.arange(f), (1, f)).ravel()
                ok = (x < width) & (y < width) & ((x <= y) | (p != q).repeat(f * f))
                todo.append((level - 1, x[ok], y[ok]))

    def upwards(self, leaf: np.ndarray, merge) -> list[np.ndarray]:
        out = [leaf]
        for _ in self.levels[1:]:
            out.append(merge(out[-1], np.arange(0, len(out[-1]), self.fan)))
        return out

    def with_partner(self, centre: int) -> np.ndarray:
        """Members for which the bitmaps leave some partner possible."""
        n = len(self.ids)
        done = np.zeros(n, bool)
        hit = np.flatnonzero(self.ids == centre)
        if len(hit):
            others = np.delete(np.arange(n), hit)
            done[others[self.may(0, others, np.full(len(others), hit[0]))]] = True
            done[hit] = done.any()
        state = {"at": -1, "all": []}

        def skip(level, a, b):
            if state["at"] != (now := int(done.sum())):                # new marks: look again
                state.update(at=now, all=self.upwards(done, np.logical_and.reduceat))
            return state["all"][level][a] & state["all"][level][b]
        for a, b in self.traverse(skip):
            done[a] = done[b] = True
        return self.ids[done]


class Group(Tree):
    """A tree over whole sets, joined into parts."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: int):
        size = np.array([len(s) for s in sets])
        order = np.lexsort((ids, size))
        self.sets = [sets[i] for i in order]
        bits = 4 << int(size_class(size.max()))
        while bits > 1024 and bits * len(sets) > 1 << 29:               # 64 MB of bitmaps at most
            bits //= 2
        super().__init__(ids[order], size[order], np.stack([bitmap(s, bits) for s in self.sets]), percent)
        self.parent = np.arange(len(ids))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def similar(self, i: int, j: int) -> bool:
        both = self.size[i] + self.size[j]
        a, b = (self.sets[i], self.sets[j]) if self.size[i] <= self.size[j] else (self.sets[j], self.sets[i])
        at = np.searchsorted(b, a)
        common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return (100 + self.percent) * common >= self.percent * both

    def link(self, i: int, j: int, out: list) -> None:
        a, b = self.root(i), self.root(j)
        if a != b and self.similar(i, j):
            self.parent[max(a, b)] = min(a, b)
            out.append((int(self.ids[i]), int(self.ids[j])))

    def links(self, centre: int) -> list[tuple[int, int]]:
        """Pairs of similar members that join two parts."""
        out: list[tuple[int, int]] = []
        n = len(self.ids)
        if len(hit := np.flatnonzero(self.ids == centre)):             # most members of a group of copies link here
            others = np.delete(np.arange(n), hit)
            for i in others[self.may(0, others, np.full(len(others), hit[0]))]:
                self.link(int(i), int(hit[0]), out)

        def merge(v, at):
            lo, hi = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
            return np.where(lo == hi, lo, -1)
        state = {"at": -1, "part": []}

        def skip(level, a, b):
            if state["at"] != len(out):
                state.update(at=len(out), part=self.upwards(np.array([self.root(i) for i in range(n)]), merge))
            v = state["part"][level]
            return (v[a] >= 0) & (v[a] == v[b]) if level else (a != b) & (v[a] == v[b])
        for a, b in self.traverse(skip):
            for i, j in zip(a.tolist(), b.tolist()):
                self.link(i, j, out)
        return out


def dealt_in_blocks(members: DataFrame, weight, block: int) -> DataFrame:
    """Members (centre, doc_id, n) of every group of two or more, with the blocks b1, b2 whose task compares them."""
    big = (members.groupBy("centre").agg(F.ceil(F.sum(weight) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m"))
           .where("m > 1").drop("m"))
    return (members.join(big, "centre").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .where("blocks = 1 or own != other")                       # a block meets itself where it meets another
            .select("centre", "doc_id", "n", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2")))


def jaccard_join(docs: DataFrame, size: int = 3, percent: int = 90, block: int = 8192, block_shingles: int = 1_000_000) -> DataFrame:
    """Every document's class: doc_id, n_shingles (set size), class_id (smallest doc_id of equal set), component_id.

    Documents link when 100 |a & b| >= percent |a | b|. A null or empty text has the empty set and links with nothing,
    a document of a null doc_id is left out of comparison (n_shingles given, component null). Rows of one doc_id
    must be one document; repeated rows stay repeated. Empty tables give no row; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = spark.sparkContext.broadcast(sketch(docs))

    def profile(batch: pa.RecordBatch):
        n, digest, heads, maps = [], [], [], []
        for t in batch.column(1).to_pylist():
            s, f = ordered_shingles(t or "", size, counts.value)
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            maps.append(own_bitmap(s) if len(s) else None)
            k = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
            if k:
                if k < len(s):
                    cut = np.partition(f, k - 1)[k - 1]
                    sure = np.flatnonzero(f < cut)
                    s = np.concatenate([s[sure], s[f == cut][:k - len(sure)]])     # s is sorted: ties by hash
            heads.append(s.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                          pa.array(heads, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                                         names=["doc_id", "n_shingles", "digest", "heads", "map"])

    prof = stage(per_batch(docs, ["doc_id", "text"], profile, "doc_id bigint, n_shingles bigint, digest binary, heads array<bigint>, map binary", 500), "join-profile")
    known = prof.where("doc_id is not null and digest is not null")
    classes = stage(known.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "join-classes")
    # one member of each class goes on: a bitmap of these ids stands in for a join that would move all profiles; a copy
    # that slips through is only a further member of its groups
    _, first = id_filter(classes.select("class_id"), "class_id", 1 << 27)
    ids = known.select("doc_id", F.col("n_shingles").alias("n"), "heads", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 27)).alias("p"),
                       F.transform("heads", lambda x: F.pmod(F.xxhash64(x), F.lit(1 << 27))).alias("hp"))

    def prefixes(shared=None):
        """doc_id, n, h of the classes' prefix shingles, of those that ``shared`` lets pass."""
        def run(batch: pa.RecordBatch):
            batch = batch.take(pa.array(np.flatnonzero(first(batch.column(3).to_numpy()))))
            h = batch.column(2)
            row, keep = np.repeat(np.arange(batch.num_rows), np.diff(h.offsets.to_numpy())), slice(None)
            if shared is not None:
                keep = np.flatnonzero(shared(batch.column(4).flatten().to_numpy()))
            row = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(h.flatten().to_numpy()[keep])],
                                             names=["doc_id", "n", "h"])
        return per_batch(ids, ids.columns, run, "doc_id bigint, n bigint, h bigint")

    met = stage(prefixes().groupBy("h").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where("last > centre").select("h", "centre"), "join-met")
    # most prefix shingles have one holder and needn't travel again
    again = prefixes(id_filter(met, "h", 1 << 27)[1])
    pairs = stage(again.join(met, "h").groupBy("centre", "doc_id").agg(F.first("n").alias("n")), "join-pairs")

    def partners(group: pa.Table):
        found = members_with_partner(group["doc_id"].to_numpy(), group["n"].to_numpy(), group["map"].to_pylist(), percent, group["centre"][0].as_py())
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), group["centre"][0].as_py())), pa.array(found)], names=["centre", "doc_id"])

    possible = (grouped(dealt_in_blocks(pairs, F.lit(1), block).join(prof.select("doc_id", "map").where("map is not null"), "doc_id")
                        .select("centre", "b1", "b2", "doc_id", "n", "map"), ["centre", "b1", "b2"], ["doc_id"], partners, "centre bigint, doc_id bigint"))
    members = stage(possible.distinct().join(pairs, ["centre", "doc_id"]), "join-members")
    dealt = dealt_in_blocks(members, F.greatest("n", F.lit(128)), block_shingles)
    place, wanted = id_filter(members.select("doc_id"), "doc_id")

    def sets(batch: pa.RecordBatch):
        keep = np.flatnonzero(wanted(batch.column(2).to_numpy()))
        texts = batch.column(1).take(pa.array(keep)).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([shingles(t or "", size).tobytes() for t in texts], pa.binary())],
                                         names=["doc_id", "s"])

    needed = per_batch(docs.where("doc_id is not null").withColumn("p", place), ["doc_id", "text", "p"], sets, "doc_id bigint, s binary", 500)

    def search(group: pa.Table):
        ids, at = np.unique(group["doc_id"].to_numpy(), return_index=True)
        raw = group["s"].take(pa.array(at)).to_pylist()
        found = Group(ids, [np.frombuffer(x, np.uint64) for x in raw], percent).links(group["centre"][0].as_py())
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = grouped(dealt.join(needed, "doc_id").select("centre", "b1", "b2", "doc_id", "s"), ["centre", "b1", "b2"], ["doc_id"],
                    search, "a bigint, b bigint")
    comp = components(spark, links, "join-links")
    named = (classes.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left")
             .select("digest", "class_id", F.coalesce("component", "class_id").alias("component_id")))
    return (prof.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
