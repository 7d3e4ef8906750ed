"""Byte-level BPE: Spark's higher-order functions fold the ranked merges of distinct words; decoding joins byte pieces.

1. One pass over the texts finds the distinct words (matches of the split pattern); Spark aggregates them, so that
   only distinct words of a task are shuffled.
2. Each distinct word becomes an array of the ids of its bytes, and ``aggregate`` merges the adjacent pair of lowest rank,
   the leftmost first, until no pair has a rank. Ranks come from a literal table of pairs, dealt into buckets because a
   map lookup in Spark is a linear search. The pair ranks are carried along; a step looks up the two new pairs only.
3. The encoded words are written as sorted hash files to the shared folder. A second pass over the texts joins the
   ids of the words of each text by looking them up there: no text is shuffled, and a task's memory is a bounded memo.

Words beyond ``long_word`` bytes (runs without a break) would need as many fold steps as bytes, so these are merged
with a heap in the second pass: the same result in n log n steps.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from cashlens.llm.common import per_batch, shared_folder, stage
from cashlens.llm.hashfile import file_column, files_for, find, hash_pairs, save

BUCKETS, PAIR, NO_RANK = 40009, 1 << 20, 2**31 - 1
SLICE = 8 << 20                  # bytes of texts, about, whose chunks are told apart at once
#: White space as Unicode's property has it, which is what ``\s`` means to the tokenizer.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def splitter(pattern: str):
    """The split pattern with white space spelled out."""
    p = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(p).findall


BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: ASCII marks that no alternative of the pattern treats in a way of its own (an apostrophe begins a contraction).
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")


def chunker(pattern: str):
    """(whole, split): ``whole`` tells if a text can't be parted at its blanks, ``split`` gives the words of a chunk as the pattern finds them.

    A match never runs over a blank except in a run of white space, so a text with white space on both sides of a
    blank (or before a last one) stays whole. Chunks stand without the blank before them; the first chunk of a text,
    which has none, is marked by a NUL in front, so a text that holds a NUL itself stays whole too.
    """
    across, words = regex.compile(f"[{SPACE}] (?=[{SPACE}]|$)").search, splitter(pattern)
    doubtful = [[w + " " for w in BLANKS if ascii_ <= w.isascii()] for ascii_ in (False, True)]

    def whole(text: str) -> bool:
        return "\0" in text or any(w in text for w in doubtful[text.isascii()]) and across(text) is not None

    def split(chunk: str) -> list[str]:
        letters = chunk.rstrip(MARKS)
        if letters.isalpha() or not letters:                           # letters are one word, marks behind them another
            return [" " + letters, chunk[len(letters):]] if letters and len(letters) < len(chunk) else [" " + chunk]
        return words(chunk[1:]) if chunk[:1] == "\0" else words(" " + chunk)
    return whole, split


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """(place, rows) of parts of a column with about ``SLICE`` bytes each."""
    rows = max(1, len(texts) * SLICE // max(texts.nbytes, 1))
    return [(lo, min(rows, len(texts) - lo)) for lo in range(0, len(texts), rows)]


def chunked(texts: pa.Array, whole) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Chunks of a column of texts, as arrays: the order in which its rows follow (whole ones last), the distinct chunks,
    the place of every chunk among these, and where each row's chunks end."""
    texts = texts.cast(pa.string()).fill_null("")
    odd = np.fromiter(map(whole, texts.to_pylist()), bool, len(texts))
    marked = pc.binary_join_element_wise("\0", texts, "")
    parts = pc.split_pattern(marked.filter(pa.array(~odd)), " ")
    rest = marked.filter(pa.array(odd))
    found = pa.concat_arrays([parts.flatten(), rest]).dictionary_encode()
    counts = np.concatenate([pc.list_value_length(parts).to_numpy(zero_copy_only=False), np.ones(len(rest), np.int64)])
    distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()                # much faster than to_pylist
    return np.argsort(odd, kind="stable"), distinct, found.indices.to_numpy(zero_copy_only=False), np.cumsum(counts).astype(np.int64)


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def rank_map(ranks: dict[bytes, int]) -> Column:
    """Literal buckets of pairs of ids: no rank, then each pair as one number (above any rank) with the rank of the joined piece behind it."""
    buckets: list[list[int]] = [[NO_RANK] for _ in range(BUCKETS)]
    for piece, r in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                buckets[(a * 31 + b) % BUCKETS] += [(a + 1) * PAIR + b, r]
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")


def byte_ids(ranks: dict[bytes, int]) -> Column:
    """Literal array of the ids of the bytes, placed by ``hex_place`` of their two hex digits."""
    ids = [0] * (hex_place(*b"FF") + 1)
    for b in range(256):
        ids[hex_place(*b"%02X" % b)] = ranks[bytes([b])]
    return F.from_json(F.lit(json.dumps(ids)), "array<int>")


def hex_place(high, low):
    """A number for two hex digits' codes; the codes of 0 to F lie less than 32 apart."""
    return high * 32 + low


def unreachable(ranks: dict[bytes, int]) -> dict[str, int]:
    """Words of the vocabulary that merging wouldn't make (none, in vocabularies that come from merging)."""
    return {b.decode(): r for b, r in ranks.items() if heap_merges(b, ranks) != [r] and b.decode(errors="replace").encode() == b}


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids (array<int>) of a string column's words by ranked merges."""
    # the literal stands in the plan once, as a bound variable
    ids = let(rank_map(ranks), lambda table: _fold(word, table, byte_ids(ranks)))
    for w, r in unreachable(ranks).items():
        ids = F.when(word == w, F.array(F.lit(r))).otherwise(ids)
    return ids


def _fold(word: Column, table: Column, single: Column) -> Column:
    none = F.array().cast("array<int>")

    def rank(a: Column, b: Column) -> Column:
        return let(F.get(table, F.pmod(a * 31 + b, F.lit(BUCKETS))), lambda found: F.get(
            found, F.array_position(found, (a.cast("long") + 1) * PAIR + b).cast("int")).cast("int"))         # 0, if the pair isn't there

    def tail(a: Column, start: Column) -> Column:
        return F.slice(a, start, F.lit(1 << 30))

    def step(acc: Column, _: Column) -> Column:
        parts, pairs = acc["parts"], acc["pairs"]

        def merge(low: Column) -> Column:                              # a pair's rank is the joined piece's id
            def at(p: Column) -> Column:
                left = F.when(p > 1, F.array(rank(F.get(parts, p - 2), low))).otherwise(none)
                right = F.when(p + 1 < F.size(parts), F.array(rank(low, F.get(parts, p + 1)))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(parts, F.lit(1), p - 1), F.array(low), tail(parts, p + 2)).alias("parts"),
                    F.concat(F.slice(pairs, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, tail(pairs, p + 2)).alias("pairs"))
            return F.when(low == NO_RANK, acc).otherwise(let(F.array_position(pairs, low).cast("int"), at))
        return let(F.coalesce(F.array_min(pairs), F.lit(NO_RANK)), merge)

    def start(parts: Column) -> Column:
        pairs = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda b, i: rank(F.get(parts, i), b))
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.struct(parts.alias("parts"), pairs.alias("pairs")), step)["parts"]

    def folded(h: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(h) - 1, F.lit(2))
        return let(F.transform(places, lambda i: F.get(single, hex_place(F.ascii(F.substring(h, i, F.lit(1))), F.ascii(F.substring(h, i + 1, F.lit(1)))))), start)

    return let(F.hex(word), folded)


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: pairs in a heap by (rank, place), stale entries skipped."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or end[j] != stop:
            continue
        live[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i:end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i]:end[i]])) is not None:
            heapq.heappush(heap, (r, before[i], end[i]))
    return [ranks[word[i:end[i]]] for i in range(n) if live[i]]


def encoded_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, long_word: int) -> tuple[str, int]:
    """Folder and number of sorted hash files with the ids of every distinct word of the texts."""
    def distinct(batch: pa.RecordBatch):
        (whole, split), words, seen = chunker(pattern), set(), set()
        for t in batch.column(0).to_pylist():
            if t:
                seen.update(["\0" + t] if whole(t) else ("\0" + t).split(" "))
        for c in seen:
            words.update(split(c))
        words = [w for w in words if len(w) * 4 <= long_word or len(w.encode()) <= long_word]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    words = stage(per_batch(docs, ["text"], distinct, "word string").distinct()
                  .select("word", fold_merges(F.col("word"), ranks).alias("ids")), "bpe-words")
    folder, files = shared_folder(docs.sparkSession, "bpe"), files_for(words.count())

    def hashed(batch: pa.RecordBatch):
        h, check = hash_pairs(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(check.view(np.int64)), batch.column(1)],
                                         names=["h", "check", "ids"])

    def write(key, rows):
        h = rows["h"].to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        ids = rows["ids"].take(pa.array(order)).combine_chunks()
        save(folder, f"part-{key[0].as_py():06d}", {
            "hash": h[order], "check": rows["check"].to_numpy().view(np.uint64)[order],
            "ids_at": (ids.offsets.to_numpy() - ids.offsets[0].as_py()).astype(np.uint32),
            "ids": ids.flatten().to_numpy().astype("<u4")})
        return pa.table({"part": [key[0].as_py()], "rows": [len(h)]})

    (per_batch(words, ["word", "ids"], hashed, "h bigint, check bigint, ids array<int>")
     .withColumn("part", file_column(F.col("h"), files).cast("long")).groupBy("part")
     .applyInArrow(write, "part bigint, rows bigint").agg(F.sum("rows")).first())
    return folder, files


_MEMO: dict[str, dict[str, bytes]] = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, long_word: int = 64, room: int = 1_000_000) -> DataFrame:
    """Every text's ids: doc_id, ids (array<int>), ids_le (the same, packed little-endian 32-bit).

    A null or empty text has no id; a null doc_id stays null; repeated rows and ties are encoded alike; an empty table
    gives no row. Other columns are ignored. ``room`` bounds a worker's memo of chunks of text.
    """
    ranks = read_ranks(ranks_path)
    folder, files = encoded_words(docs, ranks, pattern, long_word)
    table = docs.sparkSession.sparkContext.broadcast(ranks)            # the fixed vocabulary, for long words

    def learn(memo: dict[str, bytes], new: list[str]) -> None:
        """Fill the empty ``memo`` with the ids of the words ``new``."""
        h, check = hash_pairs(new)
        for at, row, f in find(folder, files, h):
            same = f["check"][row] == check[at]
            at, row = at[same], row[same]
            ids = f["ids"].tobytes() if len(row) * 8 > len(f["hash"]) else memoryview(f["ids"].view(np.uint8))
            for i, a, b in zip(at.tolist(), (4 * f["ids_at"][row].astype(np.int64)).tolist(), (4 * f["ids_at"][row + 1].astype(np.int64)).tolist()):
                memo[new[i]] = bytes(ids[a:b])
        for w in new if len(memo) < len(new) else ():                  # long words, and two words of one hash
            if w not in memo:
                b = w.encode()
                memo[w] = np.asarray([table.value[b]] if b in table.value else heap_merges(b, table.value), "<u4").tobytes()

    def join(batch: pa.RecordBatch):
        (whole, split), memo = chunker(pattern), _MEMO.setdefault(folder, {})
        for lo, n in slices(batch.column(1)):
            order, chunks, place, ends = chunked(batch.column(1).slice(lo, n), whole)
            if len(memo) > room:
                memo.clear()
            if new := [(c, split(c)) for c in chunks if c not in memo]:
                words: dict[str, bytes] = {}
                learn(words, list({w for _, ws in new for w in ws}))
                memo.update((c, words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])) for c, ws in new)
            each = [memo[c] for c in chunks]
            sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
            pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                              pa.array(np.frombuffer(b"".join(each), "<u4").astype(np.int32)))
            out = pieces.take(pa.array(place)).flatten()
            at = np.concatenate([[0], np.concatenate([[0], np.cumsum(sizes[place])])[ends]]).astype(np.int32)
            packed = np.ascontiguousarray(out.to_numpy(zero_copy_only=False), "<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n).take(pa.array(order)), pa.ListArray.from_arrays(pa.array(at), out),
                 pa.Array.from_buffers(pa.binary(), len(order), [None, pa.py_buffer(at * 4), pa.py_buffer(packed)])],
                names=["doc_id", "ids", "ids_le"])

    return per_batch(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")], join,
                     "doc_id bigint, ids array<int>, ids_le binary")


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes of an array of ids: each id's literal piece, concatenated. Null for null."""
    pieces = [""] * (max((ranks := read_ranks(ranks_path)).values()) + 1)
    for piece, r in ranks.items():
        pieces[r] = piece.hex()
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""))
