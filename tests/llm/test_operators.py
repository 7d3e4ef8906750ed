"""Operators against brute force on small fixtures, and their defined results on odd rows and empty tables."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from cashlens.llm import byte_bpe, chaining, knn_quality, langid, lattice, lm_trie, outliers, packing, sigtree, toxicity
from cashlens.llm.common import components, held_out

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def learn_only(n, k):
    """Keys whose crc32 as text doesn't leave 2."""
    return [i for i in range(10 * n) if zlib.crc32(str(i).encode()) % k != 2][:n]


@pytest.fixture(scope="module")
def labelled(spark, frame):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        bad, toxic = i % 6 == 0, i % 5 == 0
        if toxic:
            w[3:3] = ["grobian" + rng.choice(["", "en", "s"]), "scum"]
        rows.append((i, " | ".join(w) + " ###$$$" if bad else " ".join(w) + ".", "en", f"s{i % 5}"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return frame(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


# ---- packing
def test_packing_round_trip(frame, odd):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    rows = packing.pack(frame(odd), P.path("word_bpe_49k.json"), max_len=64).collect()
    want = collections.Counter(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t, _, _ in odd)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and len(r.ids) == 4 * r.length for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows)
    got, held = collections.Counter(), {}
    for r in sorted(rows, key=lambda r: r.sequence_id):                # pieces of a row follow each other
        held[r.doc_id] = held.get(r.doc_id, b"") + r.ids
        if len(held[r.doc_id]) == 4 * r.doc_tokens:
            got[held.pop(r.doc_id)] += 1
    assert not held and got == want


def test_chunks_split_side_by_side():
    """Chunks of a batch are split in one call, and each gets the ids that the tokenizer gives its text."""
    texts = ["", "plain words Only", "don't I'LL 's 't' 12a3 _x-1 a", "Ünï Şé İstanbul Straße ÿ's", "中文 abc é! é", "\x00 a\x01b \xad \xad!", "\x1d q", "\n\n - \t"]
    enc = packing.WordEncoder(P.path("word_bpe_49k.json"))
    want, calls, split = [enc.whole(t) for t in texts], [], enc.split
    enc.split = lambda s: calls.append(s) or split(s)
    assert enc.encode(texts) == want and len(calls) == 1
    assert enc.encode(texts[::-1]) == want[::-1]
    assert [packing.WordEncoder(P.path("word_bpe_49k.json")).encode([t])[0] for t in texts] == want


def test_packing_empty(frame):
    assert packing.pack(frame([]), P.path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame([]), P.path("word_bpe_49k.json"), max_len=100)


# ---- byte BPE
def test_byte_bpe_equals_tiktoken(frame, odd):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = [(20, "a  b   c\n \n d \t\r\n  ", None, None), (21, "it's I'll   we've 12345 --!! ", None, None), (22, "end  ", None, None)]
    path = P.path("byte_bpe_50k.tiktoken")
    df = byte_bpe.encode(frame(odd + more), path, P.PATTERN)
    rows = df.select("ids", "ids_le", byte_bpe.decode(df.ids, path).alias("raw")).collect()
    got = collections.Counter((tuple(r.ids), bytes(r.raw)) for r in rows)
    assert got == collections.Counter((tuple(e.encode_ordinary(t or "")), (t or "").encode()) for _, t, _, _ in odd + more)
    assert all(np.array(r.ids, "<u4").tobytes() == bytes(r.ids_le) for r in rows)


def test_heap_merges_equal_fold(spark):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    words = ["hello", " therefore", "aaaaaaaaaaaaa", "ünïcödé", "zzqxj", "\U0001f600\U0001f600"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", byte_bpe.fold_merges(df.w, ranks).alias("ids")).collect():
        b = r.w.encode()
        assert r.ids == ([ranks[b]] if b in ranks else byte_bpe.heap_merges(b, ranks))


def test_chunks_are_told_apart_once_and_split_as_the_pattern(frame):
    import pyarrow as pa
    import tiktoken
    whole, split = byte_bpe.chunker(P.PATTERN)
    texts = ["one two one", None, "two  three ", "", "a \0b a", "one", "end ", "ab, cd. ab,", "x\n  y"]
    order, distinct, place, ends = byte_bpe.chunked(pa.array(texts), whole)
    assert len(distinct) == len(set(distinct)) and sorted(order) == list(range(len(texts))) and list(order[-2:]) == [4, 8]
    words = byte_bpe.splitter(P.PATTERN)
    for i, a, b in zip(order, [0, *ends], ends):
        assert [w for p in place[a:b] for w in split(distinct[p])] == words(texts[i] or "")
    for c in ["ab,", "ab.\"", "--", "a-b", "ab's", "ab'", "'s", "12", "12.", "é!", "ab.c", "ab²", "ab_", "(ab)", "\u0301x", "ab。", ""]:
        assert split(c) == words(" " + c), c
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = byte_bpe.encode(frame([(i, t, None, None) for i, t in enumerate(texts)]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {r.doc_id: list(r.ids) for r in df.collect()} == {i: e.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_every_byte_is_placed_without_a_search(spark):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    got = spark.range(1).select(byte_bpe.byte_ids(ranks).alias("ids")).first().ids
    assert isinstance(got, list) and all(got[byte_bpe.hex_place(*b"%02X" % b)] == ranks[bytes([b])] for b in range(256))
    table = spark.range(1).select(byte_bpe.rank_map(ranks).alias("t")).first().t
    for pair in (b"th", b" t", b"zq", b"\xff\xfe"):
        a, b = ranks[pair[:1]], ranks[pair[1:]]
        found = table[(a * 31 + b) % byte_bpe.BUCKETS]
        key = (a + 1) * byte_bpe.PAIR + b
        assert found[found.index(key) + 1 if key in found else 0] == ranks.get(pair, byte_bpe.NO_RANK)


# ---- language model
def test_language_model_brute_force(frame, odd):
    rng = random.Random(5)
    rows = odd + [(100 + i, " ".join(rng.choice("a b c d e f gg hh".split()) for _ in range(rng.randint(0, 30))), None, None) for i in range(60)]
    got = lm_trie.score(frame(rows)).collect()
    words = [TOKEN.findall((t or "").encode().lower()) + [b" "] for _, t, _, _ in rows]
    learn = [w for w, r in zip(words, rows) if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = collections.Counter(x for w in learn for x in w)
    pairs = collections.Counter(p for w in learn for p in zip([None, *w], w))
    ctx = collections.Counter()
    for (u, _), n in pairs.items():
        ctx[u] += n
    total, size = sum(c.values()), len(c)

    def p1(x):
        return (c[x] + 1) / (total + size + 1)
    k = max(lm_trie.GRID_K, key=lambda g: sum(n * math.log((n - 1 + g * p1(x)) / (ctx[u] - 1 + g)) for (u, x), n in pairs.items()))
    logs = [math.log10((n + k * p1(x)) / (ctx[u] + k)) for (u, x), n in pairs.items()]
    step = (max(logs) - min(logs)) / 510
    want = collections.defaultdict(list)
    for r, w in zip(rows, words):
        want[r[0]].append((len(w), sum(c[x] > 0 for x in w), sum(math.log10(p1(x)) for x in w),
                           sum(math.log10((pairs[p] + k * p1(p[1])) / (ctx[p[0]] + k)) for p in zip([None, *w], w))))
    assert len(got) == len(rows)
    for r in got:
        n, known, base, s = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - s) <= n * (step * 1.01 + 1e-5)


def test_language_model_empty(frame):
    assert lm_trie.score(frame([])).count() == 0


def test_elias_fano():
    from cashlens.llm.eliasfano import EliasFano
    rng = np.random.default_rng(1)
    for n, universe in ((1, 0), (5, 7), (3000, 2**40), (3000, 4000), (1000, 2**63)):
        v = np.unique(rng.integers(0, universe, n, dtype=np.uint64, endpoint=True))
        e = EliasFano(EliasFano.build(v, universe, "x"), "x")
        assert (e.get(np.arange(len(v))) == v).all() and (e.place(v) == np.arange(len(v))).all()
        other = np.setdiff1d(rng.integers(0, universe, 500, dtype=np.uint64, endpoint=True), v)
        assert (e.place(other) == -1).all()
    v = np.array([0, 0, 3, 3, 3, 9], np.uint64)                         # monotone pointers repeat
    e = EliasFano(EliasFano.build(v, 9, "x"), "x")
    assert e.get(np.arange(6)).tolist() == v.tolist()


# ---- language identification
def test_langid_held_out(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"), 4)).collect()
    assert len(r) > 30 and sum(x.lang == x.lang_pred for x in r) >= 0.97 * len(r) and all(0 <= x.score <= 1 for x in r)


def test_worker_memos_end_with_the_task(spark):
    """A reused worker starts empty: what one task remembered is gone in the next, and a stage's memo in the next stage."""
    from cashlens.llm.common import _MEMOS, _OF_STAGE, memo, per_batch
    import pyarrow as pa

    def run(batch):
        seen = len(_MEMOS), len(_OF_STAGE["memos"])
        memo("a", lambda: bytes(1000))
        memo("b", dict, whole_stage=True)
        yield pa.RecordBatch.from_arrays([pa.array([seen[0]]), pa.array([seen[1]])], names=["task", "stage"])
    for _ in range(2):
        rows = per_batch(spark.range(16).repartition(16), ["id"], run, "task bigint, stage bigint").collect()
        assert rows and all(r.task == 0 for r in rows) and any(r.stage == 0 for r in rows)


def test_langid_odd_rows(frame, odd):
    rows = odd + [(50, "12 345 !?", "en", None)]
    got = langid.identify(frame(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 50)) and by[6].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(frame([(1, "some text", None, None)])).collect()} == {"und"}
    assert langid.identify(frame([])).count() == 0


def test_langid_needs_a_letter(frame):
    rows = [(i, f"plain words of one language {i}", "en", "a") for i in range(12)] + [(100, "\u0301\u0302 12 \u0303", "en", "a"), (101, "\u0301a", None, "a")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame(rows)).collect()}
    assert got[100] == ("und", 0.0) and got[101][0] == "en"


def test_kneser_ney_sums_to_one(spark):
    """Over the seen characters after every context, probabilities leave just what unseen ones get."""
    words = spark.createDataFrame([("x", w, n) for w, n in (("abba", 3), ("abc", 1), ("cab", 2))], "lang string, word string, n bigint")
    top = langid.gram_counts(words, 3)
    e = {(r.k, r.kind, r.gram): r.v for r in langid.kneser_ney(top, 3).collect()}
    chars = {g for (k, kind, g) in e if k == 1 and kind == "p"}
    assert abs(sum(e[1, "p", c] for c in chars) + e[0, "p", ""] - 1) < 1e-9

    def p(ctx, c):
        k = len(ctx) + 1
        if (k, "p", ctx + c) in e:
            return e[k, "p", ctx + c]
        return e.get((k - 1, "b", ctx), 1.0) * p(ctx[1:], c) if ctx else e[0, "p", ""]
    for (k, kind, ctx) in e:
        if kind == "b":
            assert abs(sum(p(ctx, c) for c in chars) + p(ctx, "\0") - 1) < 1e-9


# ---- embeddings
def test_lattice_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + rng.standard_normal((30, 16)) * 0.2, base[:5]])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 1), (None, rows[0][1], 1), (204, [float(2 * v) for v in x[0]], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in lattice.near_vectors(df).collect()}
    ids = [i for i, v, _ in rows if i is not None and i not in (200, 201, 202, 203)]
    u = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i in set(ids)}
    u = {i: v / np.linalg.norm(v) for i, v in u.items()}
    links = {i: {j for j in ids if j != i and u[i] @ u[j] >= 0.9} for i in ids}
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.9 * sum(map(len, links.values())) and all(got[i].n_links <= len(links[i]) for i in ids)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (200, 201, 202, 203)) and got[204].component_id == 0
    assert got[None].n_links == 0 and got[None].component_id is None
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_e8_decoder_finds_the_nearest():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 8)) * 2
    p = lattice.decode_e8(x)
    twice = np.rint(p * 2).astype(int)
    assert ((twice % 2 == 0).all(1) | (twice % 2 != 0).all(1)).all() and (twice.sum(1) % 4 == 0).all()
    near = ((x[:, None] - (p[:, None] + lattice.ROOTS)) ** 2).sum(2).min(1)
    assert (((x - p) ** 2).sum(1) <= near + 1e-9).all() and len(np.unique(lattice.ROOTS, axis=0)) == 240


# ---- quality rules
def rule_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if win[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep)


def test_rule_counts(frame, odd):
    rows = odd + [(30, "a b c d e f a b c d e\nx\nx\n \n \nx", None, None), (31, "\U0001f600 # <b> | $5 a", "en", "a"), (32, "a b c d e " * 9, "en", "a")]
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                              for r in outliers.outliers(frame(rows)).collect())
    want = collections.Counter()
    for i, t, _, _ in rows:
        c = rule_counts(t)
        want[(i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == want
    assert outliers.outliers(frame([])).count() == 0


def test_outliers_found(labelled):
    docs, labels = labelled
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    got = {r.doc_id: r for r in outliers.outliers(docs, least_rows=30).collect()}
    assert sum(not got[i].kept for i in bad) >= 0.9 * len(bad) and sum(not r.kept for i, r in got.items() if i not in bad) <= 4


# ---- Jaccard join
def shingle_set(t, k):
    w = TOKEN.findall((t or "").encode().lower())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t, _, _ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size,percent,blocks", [(3, 90, (8192, 1_000_000)), (5, 80, (5, 600)), (3, 60, (3, 300))])
def test_jaccard_brute_force(frame, odd, size, percent, blocks):
    rng = random.Random(8)
    rows = list(odd)
    for g in range(12):
        base = [f"t{rng.randint(0, 300)}" for _ in range(rng.randint(2, 90))]
        for v in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 9999)}"
            rows.append((100 * g + v + 1000, " ".join(w).title() if v % 2 else "  ".join(w), None, None))
    got = sigtree.jaccard_join(frame(rows), size, percent, *blocks).collect()
    want = brute_components(rows, size, percent)
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_jaccard_empty(frame):
    assert sigtree.jaccard_join(frame([])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, i) for i in range(501, 900)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a bigint, b bigint"), "t").collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert all(got.get(i, i) == root(i) for i in list(parent))


# ---- repeated passages
def test_passages_planted(frame, odd):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows, spans = list(odd), {}
    for i in range(40):
        own = [word() for _ in range(rng.randint(30, 90))]
        if i % 4 == 0:
            p = list(passage)
            for at in rng.sample(range(60), i // 8):
                p[at] = word()
            at = rng.randint(0, len(own))
            own[at:at] = p
            spans[100 + i] = (at, 60)
        rows.append((100 + i, " ".join(own), None, None))
    got = collections.defaultdict(set)
    for r in chaining.passages(frame(rows)).collect():
        got[r.doc_id].update(range(r.start, r.start + r.length))
        assert r.first_doc < r.doc_id and r.matched <= min(r.length, r.first_length)
    first = min(spans)
    for d, (at, n) in spans.items():
        if d != first:
            assert len(got[d] & set(range(at, at + n))) >= 52 and len(got[d]) <= 66, (d, at, sorted(got[d]))
    assert not [d for d in got if d >= 100 and (d == first or d not in spans)]
    kept = {r.doc_id: r.text for r in chaining.remove_passages(frame(rows), chaining.passages(frame(rows))).collect()}
    assert kept[first] == dict((r[0], r[1]) for r in rows)[first] and len(kept) >= len(rows) - 4
    assert chaining.passages(frame([])).count() == 0 and chaining.remove_passages(frame([]), chaining.passages(frame([]))).count() == 0


@pytest.mark.parametrize("quote,step,edits", [(10, 5, 0), (30, 10, 0), (47, 1, 0), (10, 5, 1)])
def test_passage_whose_seeds_are_held_earlier_by_others(frame, quote, step, edits):
    """Two documents share a passage; each of its short runs also stands in some earlier document, none of which holds it."""
    rng = random.Random(quote)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for i, at in enumerate(range(0, 60 - quote + 1, step)):
        rows.append((i, " ".join([*(word() for _ in range(30)), *passage[at:at + quote], *(word() for _ in range(30))]), None, None))
    other = list(passage)
    for at in (26,)[:edits]:
        other[at] = word()
    for d, p in ((500, passage), (501, other)):
        rows.append((d, " ".join([*(word() for _ in range(20 + d % 2)), *p, *(word() for _ in range(20))]), None, None))
    found = [r for r in chaining.passages(frame(rows)).collect() if (r.doc_id, r.first_doc) == (501, 500)]
    assert [(r.start, r.first_start, r.length) for r in found] == [(21, 20, 60)], found


def test_changed_passage_whose_seeds_are_held_earlier_by_others(frame):
    """Two documents share a changed passage, no 20 words of it unchanged; every unchanged stretch also stands in some earlier document."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(112)]
    rows = [(i, " ".join([*(word() for _ in range(30)), *passage[at:at + 13], *(word() for _ in range(30))]), None, None)
            for i, at in enumerate(range(0, 112, 14))]
    other = [word() if i % 14 == 13 else w for i, w in enumerate(passage)]
    for d, p in ((500, passage), (501, other)):
        rows.append((d, " ".join([*(word() for _ in range(20 + d % 2)), *p, *(word() for _ in range(20))]), None, None))
    found = chaining.passages(frame(rows)).collect()
    assert {(r.doc_id, r.first_doc) for r in found} == {(501, 500)} and len(found) == 1, found
    assert abs(found[0].start - 21) <= 14 and found[0].length >= 112 - 28


def test_seed_pairs():
    rng = np.random.default_rng(3)
    at = np.sort(rng.choice(300, 60, replace=False))
    h = rng.integers(0, 5, 60).astype(np.uint64)
    b, x, y = chaining.seed_pairs(h, at, 13, 50)
    assert set(zip(x.tolist(), y.tolist())) == {(p, q) for p in at.tolist() for q in at.tolist() if 13 <= q - p <= 50}
    value = dict(zip(at.tolist(), h.tolist()))
    keys = collections.defaultdict(set)
    for key, p, q in zip(b.tolist(), x.tolist(), y.tolist()):
        keys[key].add((value[p], value[q]))
    assert all(len(v) == 1 for v in keys.values()) and len(keys) == len({(value[p], value[q]) for p, q in zip(x.tolist(), y.tolist())})
    assert [len(v) for v in chaining.seed_pairs(h[:0], at[:0], 13, 50)] == [0, 0, 0]


def test_run_hashes_and_exact_runs():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 3, 200).astype(np.uint64)
    h = chaining.run_hashes(w, np.arange(196), 5)
    for i, j in rng.integers(0, 196, (500, 2)):
        assert (h[i] == h[j]) == (w[i:i + 5] == w[j:j + 5]).all()
    assert len(chaining.run_hashes(w, np.zeros(0, int), 5)) == 0
    for _ in range(50):
        x, y = np.unique(rng.integers(0, 60, (int(rng.integers(1, 40)), 2)), axis=0).T
        got = chaining.exact_runs(x, y, 6)
        assert set().union(*(range(a, a + n) for a, _, n in got)) == set().union(*(range(a, a + 6) for a in x.tolist()))


def test_open_windows_lose_no_repeat():
    """Every window that two texts share is inside one first holder's span or open in both."""
    rng = np.random.default_rng(8)
    n, run, window, k = 48, 20, 10, 5
    for _ in range(30):
        base = rng.integers(1, 1 << 60, 160).astype(np.uint64)
        texts = []
        for _ in range(8):
            a = int(rng.integers(0, 100))
            new = lambda: rng.integers(1, 1 << 60, int(rng.integers(0, 40))).astype(np.uint64)
            texts.append(np.concatenate([new(), base[a:a + int(rng.integers(20, 100))], new()]))
        sampled = [[int(p) for p in chaining.minimisers(t, k, window)[1] if p + run <= len(t)] for t in texts]
        holders = collections.defaultdict(list)
        for d, t in enumerate(texts):
            for p in sampled[d]:
                holders[t[p:p + run].tobytes()].append((d, p))
        spans, opened = [], []
        for d, t in enumerate(texts):
            key = [t[p:p + run].tobytes() for p in sampled[d]]
            rep = [len({h[0] for h in holders[g]}) > 1 for g in key]
            at = np.array([p for p, r in zip(sampled[d], rep) if r], int)
            f = np.array([holders[g][0] for g, r in zip(key, rep) if r], int).reshape(-1, 2)
            alone = np.array([p for p, r in zip(sampled[d], rep) if not r], int)
            opened.append(set(chaining.open_windows(at, f[:, 0], f[:, 1], alone, len(t), n, run, window, k).tolist()))
            spans.append({s for e in set(f[:, 0].tolist()) for x0, _, m in zip(*chaining.merged_runs(at[f[:, 0] == e], f[f[:, 0] == e, 1], run))
                          if m >= n - 2 * window for s in range(x0 - window, x0 + m - n + window + 1)})
        where = collections.defaultdict(list)
        for d, t in enumerate(texts):
            for s in range(len(t) - n + 1):
                where[t[s:s + n].tobytes()].append((d, s))
        for held in where.values():
            if len({d for d, _ in held}) > 1:
                assert all(s in opened[d] or s in spans[d] for d, s in held)
                assert len({s in opened[d] for d, s in held}) == 1 or all(s in spans[d] for d, s in held)


def test_chains_brute_force():
    """Scores against an exhaustive search over all predecessors; chains are disjoint, in order, and worth their score."""
    rng = np.random.default_rng(6)
    for case in range(200):
        n, k, cost = int(rng.integers(1, 40)), 3, float(rng.choice([0.05, 0.1, 0.5]))
        x, y = rng.integers(0, 80, n), rng.integers(0, 80, n)
        if case % 2:                                                   # a planted diagonal with shifts
            y = x + rng.integers(-2, 3, n) + 10
        x, y, length = chaining.merged_runs(*np.unique(np.stack([x, y]), axis=1), k)
        order = np.lexsort((y, x))
        x, y, length = x[order], y[order], length[order]
        score, back = chaining.chain_scores(x, y, length, cost, block=7)
        best = []
        for j in range(len(x)):
            before = [best[p] - cost * (x[j] - x[p] - length[p] + y[j] - y[p] - length[p]) for p in range(len(x))
                      if x[p] + length[p] <= x[j] and y[p] + length[p] <= y[j]]
            best.append(length[j] + max([0, *before]))
        assert np.allclose(score, best)
        got = chaining.chains(x, y, length, cost, 0)
        rows = [tuple(r) for c in got for r in c.tolist()]
        assert len(rows) == len(set(rows)) == len(x)
        for c in got:
            assert (c[1:, 0] >= c[:-1, 0] + c[:-1, 2]).all() and (c[1:, 1] >= c[:-1, 1] + c[:-1, 2]).all()
        c = got[0]
        skipped = (c[1:, :2] - c[:-1, :2] - c[:-1, 2:]).sum()
        assert np.isclose(c[:, 2].sum() - cost * skipped, max(best))


def test_diagonal_runs_are_the_maximal_runs():
    """All matches of two periodic texts, made in blocks of a few, merge to the runs of a plain scan."""
    rng = np.random.default_rng(11)
    for _ in range(40):
        a, b, k = rng.integers(0, 3, 90), rng.integers(0, 3, 70), 4
        at = [collections.defaultdict(list), collections.defaultdict(list)]
        for side, t in enumerate((a, b)):
            for i in range(len(t) - k + 1):
                at[side][t[i:i + k].tobytes()].append(i)
        places = [(np.array(at[0][g]), np.array(at[1][g])) for g in at[0] if g in at[1]]
        want = set()
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= k and not (i and j and a[i - 1] == b[j - 1]):
                    want.add((i, j, n))
        for block in (1, 50, 1 << 17):
            got = list(zip(*(v.tolist() for v in chaining.diagonal_runs(places, k, k, block))))
            assert len(got) == len(want) and set(got) == want
            x, y = (np.array(v) for v in zip(*((i, j) for p, q in places for i in p for j in q)))
            assert set(zip(*(v.tolist() for v in chaining.diagonal_runs(places, k, 9, block)))) == set(zip(*(v.tolist() for v in chaining.merged_runs(x, y, k, 9))))
    assert [len(v) for v in chaining.diagonal_runs([], 4, 4)] == [0, 0, 0]


def test_aligned_parts_split_at_a_gap():
    """Two passages far apart on one chain are both found; a chain of good identity stays whole."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 31, 500), rng.integers(0, 1 << 31, 500)
    b[50:120], b[320:400] = a[50:120], a[320:400]
    b[80] = 1
    runs = np.array([[50, 50, 30], [81, 81, 39], [320, 320, 80]])
    assert sorted(chaining.aligned_parts(a, b, runs, 48, 0.8, 40)) == [(50, 70, 50, 70, 69), (320, 80, 320, 80, 80)]
    assert list(chaining.aligned_parts(a, b, runs[:2], 48, 0.8, 40)) == [(50, 70, 50, 70, 69)]
    assert list(chaining.aligned_parts(a, b, runs[:1], 48, 0.8, 0)) == []


def test_passage_of_a_stock_phrase_repeated_over_and_over(frame):
    """A seed with many places in both texts loses none: the changed copy is found at its only right place."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    stock = [word() for _ in range(6)]
    def noisy(n):
        return [w for _ in range(n) for w in [*stock, *(word() for _ in range(rng.randint(2, 5)))]]
    passage = [w for _ in range(8) for w in [*stock, *(word() for _ in range(3))]]
    other = [word() if i == 34 else w for i, w in enumerate(passage)]
    rows = [(1, " ".join(noisy(60) + passage + noisy(60)), None, None), (2, " ".join(noisy(50) + other + noisy(50)), None, None)]
    at, first = rows[1][1].split().index(passage[6]), rows[0][1].split().index(passage[6])
    found = [(r.start, r.start + r.length, r.start - r.first_start) for r in chaining.passages(frame(rows)).collect()]
    assert any(s <= at - 6 and e >= at - 6 + len(passage) and d == at - first for s, e, d in found), found


def test_chains_of_a_pair_are_one_row(frame, monkeypatch):
    """Periodic texts have a chain on every diagonal; they are joined with the words as one row a pair, a repeated doc_id included."""
    made = {}
    stage = chaining.stage
    monkeypatch.setattr(chaining, "stage", lambda df, name: made.setdefault(name, stage(df, name)))
    tail = lambda i, n: " ".join(f"t{i}x{j}" for j in range(n))         # noqa: E731
    rows = [(i, f"{tail(i, 60 + 10 * i)} {'tick tock ' * (150 + 10 * i)}{tail(-i, 70)}", None, None) for i in (1, 2, 3)]
    rows.append((3, "tick tock " * 30, None, None))                    # another row of this doc_id
    found = [tuple(r) for r in chaining.passages(frame(rows)).collect()]
    for i in (2, 3):                                                   # every place of what repeats
        assert {p for r in found if r[0] == i for p in range(r[1], r[1] + r[2])} >= set(range(60 + 10 * i, 60 + 10 * i + 2 * (150 + 10 * (i - 1))))
    assert made["chain-spans"].count() == len({(r[0], r[3]) for r in found}) == 2


def test_unions_and_outermost():
    rng = np.random.default_rng(6)
    for _ in range(200):
        lo = rng.integers(0, 60, rng.integers(0, 8))
        hi = lo + rng.integers(1, 12, len(lo))
        got = list(zip(*(v.tolist() for v in chaining.unions(lo, hi))))
        assert [p for a, b in got for p in range(a, b)] == sorted({p for a, b in zip(lo, hi) for p in range(a, b)})
        assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
        rows = [(1, int(a), int(b - a), 0, int(rng.integers(9)), 9, 9, float(rng.integers(3))) for a, b in zip(lo, hi)]
        kept = chaining.outermost(rows)
        assert {(r[1], r[1] + r[2]) for r in kept} == {(a, b) for a, b in zip(lo, hi) if not any((c, d) != (a, b) and c <= a and b <= d for c, d in zip(lo, hi))}
        assert len({(r[1], r[2]) for r in kept}) == len(kept)


def test_common_length_and_reach():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 90))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert chaining.common_length(np.array(a, int), np.array(b, int)) == t[-1][-1]
    assert chaining.reach(np.array([1, 2, 3, 9, 4, 5, 6, 7]), np.array([1, 2, 3, 8, 4, 5, 6, 7])) == 8
    assert chaining.reach(np.array([], int), np.array([1])) == 0


# ---- classifiers
def test_quality_held_out(labelled):
    docs, labels = labelled
    got = {r.doc_id: r.score for r in knn_quality.score(docs, labels, per_class=60, k=5).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((got[r.doc_id] >= 0.7) == (r.quality == 1) for r in held) >= 0.95 * len(held)


def test_quality_scores_ignore_held_out_and_repeated_labels(labelled, frame):
    from pyspark.sql import functions as F
    docs, labels = labelled
    docs = docs.unionByName(frame([(5000, "", None, None)]))
    scores = lambda y: {r.doc_id: r.score for r in knn_quality.score(docs, y, per_class=30, k=5).collect()}
    want = scores(labels)
    flip = labels.withColumn("quality", F.when(held_out(F.col("doc_id"), 4), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert scores(flip) == want and scores(labels.union(labels.where("quality = 0"))) == want


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].predicted == r.toxic for r in held)
    assert all(0 <= got[i].toxic <= 1 for i in got)


def test_chain_feeds_out_of_fold_probabilities():
    """A second category that only the first can tell is learnt through its out-of-fold probability."""
    rng = np.random.default_rng(0)
    first = rng.integers(0, 2, 300)
    rows = [[0] if v else [] for v in first]
    y = np.stack([first, first], 1).astype(float)
    models, oof = toxicity.fit_chain(rows, 1, y, np.arange(300) % 5, np.ones(300))
    assert abs(models[1][1]) > 0.05 and ((oof[:, 1] > .5) == (first == 1)).all()
    assert ((toxicity.predict_chain([[0], []], 1, models) > .5) == np.array([[True, True], [False, False]])).all()


def test_classifiers_odd_rows(spark, frame, odd, labelled):
    docs, labels = labelled
    empty = labels.limit(0)
    both = docs.unionByName(frame(odd[4:4] + [(1000 + i, *r[1:]) for i, r in enumerate(odd)]))
    assert {r.score for r in knn_quality.score(frame(odd), empty).collect()} == {0.5}
    assert {r.predicted for r in toxicity.score(frame(odd), empty).collect()} == {0}
    assert knn_quality.score(frame([]), labels).count() == 0 and toxicity.score(frame([]), labels).count() == 0
    q = {r.doc_id: r.score for r in knn_quality.score(both, labels, per_class=60).collect()}
    assert q[1000] == q[1001] and q[1004] == q[1005] and all(0 <= v <= 1 for v in q.values())
    carried = knn_quality.score(frame(odd), labels, name="_q", carry=True)
    assert carried.columns == [*frame(odd).columns, "_q"] and carried.count() == len(odd)
    with pytest.raises(ValueError):
        knn_quality.score(frame(odd), labels, carry=True)               # the table has a column of that name


def test_registered():
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_digests(spark):
    """The query's digests of a few texts, spelled out."""
    import __spark_entry__ as entry
    rows = {r.doc_id: r for r in entry.queries()["op5_byte_bpe"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect():
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
