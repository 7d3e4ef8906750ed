"""Fill-in-middle, spelling variants and token counts against brute force, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cashlens.llm import middle, spelling, token_counts

SF = "/root/testdata/sf0.001"


# ---- fill-in-middle
def plain_middle(key, text, seed="1"):
    """Code point by code point, as the definition reads."""
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(u)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_definition(frame, odd):
    rng = random.Random(5)
    more = [(100 + i, "".join(rng.choice("abZ é中😀\n<PSM>_0") for _ in range(rng.randint(0, 60))), None, None) for i in range(600)]
    more += [(5, "a <P> b", None, None), (7, "ends with <", None, None), (8, "<S", None, None), (9, "x" * 300_000 + " é" * 1000, None, None)]
    rows = odd + more
    df = middle.restore(middle.fill_in_middle(frame(rows)))
    got = df.collect()
    want = collections.Counter(plain_middle(k, t) for k, t, _, _ in rows)
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert collections.Counter((r.doc_id, r.restored) for r in got) == collections.Counter((k, t or "") for k, t, _, _ in rows)


def test_middle_other_columns_and_empty(spark, frame):
    assert middle.restore(middle.fill_in_middle(frame([]))).count() == 0
    docs = frame([(1, "one two three", "en", "a")]).withColumns({"output": F.lit("x"), "form": F.lit(3), "n": F.lit(None), "restored": F.lit(1)})
    assert tuple(middle.fill_in_middle(docs).first()) == plain_middle(1, "one two three")
    rows = spark.createDataFrame([(None, "psm", 1), ("x", None, 2)], "output string, form string, extra int")
    assert [tuple(r) for r in middle.restore(rows).collect()] == [(None, "psm", 1, None), ("x", None, 2, None)]
    with pytest.raises(ValueError):
        middle.restore(rows.withColumn("restored", F.lit(1)))
    with pytest.raises(ValueError):
        middle.fill_in_middle(docs, sentinels=(b"<a", b"a<", b"<b"))


def test_rotation_exchanges_blocks():
    for n in range(8):
        for lo in range(n + 1):
            for mid in range(lo, n + 1):
                for hi in range(mid, n + 1):
                    base = bytearray(range(n))
                    buf = bytearray(base)
                    middle.rotate(buf, lo, mid, hi)
                    assert buf == base[:lo] + base[mid:hi] + base[lo:mid] + base[hi:]


def test_middle_rates(frame):
    rows = middle.fill_in_middle(frame([(i, f"some words here {i}", None, None) for i in range(4000)])).groupBy("form").count().collect()
    share = {r["form"]: r["count"] / 4000 for r in rows}
    assert abs(share["plain"] - .1) < .02 and abs(share["spm"] - .18) < .03


# ---- spelling variants
def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return 2
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return 1 if a[i + (len(a) == len(b)):] == b[i + 1:] else 2


def plain_groups(rows):
    n = collections.Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in words if edits(w, v) == 1] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), k, len(near[w]), words[form[w]] if form[w] else None) for w, k in words.items()}


def variants(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("abxyzéÿ")
    return rng.choice([word[:i] + word[i + 1:], word[:i] + c + word[i + 1:], word[:i] + c + word[i:]])


@pytest.fixture(scope="module")
def misspelt():
    """Words with variants of variants, much alike, few letters, repeated grams, capitals and accents."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    base += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéñ") for _ in range(rng.randint(6, 14))) for _ in range(60)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaab", "abababab", "bababab", "Überall", "überall"]
    pool = [(w, 125) for w in base[::4]] + [(w, 8) for w in base]
    for w, _ in list(pool):
        v = variants(rng, w)
        pool += [(v, 25), (variants(rng, v), 5), (variants(rng, w), rng.choice([1, 5, 26]))]
    bag = [rng.choice((w, w.upper(), w.capitalize())) if w.isascii() else w for w, k in pool for _ in range(k)]
    rng.shuffle(bag)
    return [(i if i else None, " ".join(bag[lo:lo + 90]) + ", 3xÀ", None, None) for i, lo in enumerate(range(0, len(bag), 90))]


@pytest.mark.parametrize("block", [20_000, 3])
def test_spelling_brute_force(spark, frame, misspelt, odd, block, monkeypatch):
    pairs = spelling.near_pairs
    monkeypatch.setattr(spelling, "near_pairs", lambda words: pairs(words, block))
    rows = misspelt + odd
    got = [tuple(r) for r in spelling.spelling_groups(frame(rows).withColumns({"word": F.lit(1), "n": F.lit("x")})).collect()]
    want = plain_groups(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(f and r != f for _, f, r, *_ in got), "no chain of forms in the fixture"


def test_spelling_empty(frame):
    assert spelling.spelling_groups(frame([])).count() == 0
    assert spelling.spelling_groups(frame([(1, None, "en", "a"), (2, "ab " * 9, None, None)])).count() == 0


def test_pivots_are_the_lightest_disjoint():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 7)))
        grams = [(p, rng.randrange(50), rng.randrange(1, 9)) for p in places]
        got = spelling.choose_pivots(grams)
        weight = {(r, p): w for p, r, w in grams}
        want = min(a[2] + b[2] for a in grams for b in grams if b[0] - a[0] >= 2)
        assert got[1][1] - got[0][1] >= 2 and sum(weight[g] for g in got) == want


def test_spelling_on_tables(spark):
    from cashlens.llm.queries import QUERIES
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in QUERIES["op12_pivotal_grams"](spark, SF).collect()} == plain_groups([tuple(r) for r in rows])


# ---- token counts
def library(path):
    if path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(sp.encode(t))
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    return lambda t: len(tok.encode(t, add_special_tokens=False))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("part", [1, 37, 1 << 15])
def test_counts_equal_library(frame, odd, name, part):
    rng = random.Random(7)
    more = [(50 + i, "".join(rng.choice(" \n\t\r▁aeéß😀中0<s></s><|endoftext|>") for _ in range(rng.randint(0, 900))), None, None) for i in range(60)]
    more += [(90, "a" * 5000, None, None), (91, " " * 5000, None, None), (92, " leading  " * 900, None, None), (93, "\n" * 900 + "end ", None, None)]
    rows, count = odd + more, library(P.path(name))
    got = token_counts.count_tokens(frame(rows).withColumn("n_tokens", F.lit(0)), P.path(name), limit=100, batch_bytes=700, part_chars=part).collect()
    want = collections.Counter((k, len((t or "").encode()), count(t or ""), count(t or "") > 100) for k, t, _, _ in rows)
    assert collections.Counter(tuple(r) for r in got) == want


def test_counts_empty(frame):
    assert token_counts.count_tokens(frame([]), P.path("piece_bpe_32k.model")).count() == 0


def test_batches_are_balanced_by_bytes():
    sent = []

    class Words:
        def cut(self, text, size):
            return [(text[i:i + size], 0) for i in range(0, len(text), size)]

        def lengths(self, parts):
            sent.append(sum(len(p.encode()) for p in parts))
            return [len(p) for p in parts]
    texts = ["x" * 10, "", "é" * 5000, *["y" * 30] * 200]
    assert token_counts.count_all(Words(), texts, 1000, 100).tolist() == [len(t) for t in texts]
    assert all(1000 <= s < 1200 for s in sent[:-1]) and sent[-1] < 1200
