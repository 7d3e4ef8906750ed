"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A text is its words in small letters; every word is predicted character by character inside its own boundaries, so
distinct words carry all counts. Spark aggregates words by language, then their character n-grams; discounts,
continuation counts and interpolated probabilities are joins and aggregates of n-gram tables, one order at a time. The
entries of all languages go to sorted hash files in the shared folder. A scoring task maps these and remembers the
log-probabilities of the chunks of text it has met, so each text costs one lookup for each of its words.

The language of the lowest cross-entropy per character wins. Its chance is a softmax of the entropies at the
temperature that gives the training rows' languages the highest likelihood; a text whose entropy lies beyond all but
``reject_share`` of the training rows of its language is marked rejected.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from cashlens.llm.common import held_out, per_batch, shared_folder, stage
from cashlens.llm.hashfile import file_column, files_for, find, save

START, END = "\x02", "\x03"
#: runs of letters and marks that hold a letter
WORDS = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*").findall
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


def salt(lang: str, kind: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(f"{kind}\0{lang}".encode()))


def gram_hash(columns: list, start: np.ndarray) -> np.ndarray:
    """64-bit hash of equally long runs of code points, a column for each place."""
    h = start.copy()
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over the rows with a language."""
    def count(batch: pa.RecordBatch):
        chunks: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chunks.setdefault(lang, Counter()).update((text or "").lower().split())
        for lang, seen in chunks.items():
            words: Counter = Counter()
            for c, n in seen.items():
                if c.isalpha():
                    words[c] += n
                else:
                    for w in WORDS(c):
                        words[w] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()),
                                              pa.array(words.values(), pa.int64())], names=["lang", "word", "n"])
    return per_batch(docs, ["lang", "text"], count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int) -> DataFrame:
    """lang, gram, c of the highest order."""
    def count(batch: pa.RecordBatch):
        grams: dict[str, Counter] = {}
        pad = START * (order - 1)
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            g, s = grams.setdefault(lang, Counter()), pad + word + END
            for i in range(len(word) + 1):
                g[s[i:i + order]] += n
        for lang, g in grams.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.keys(), pa.string()),
                                              pa.array(g.values(), pa.int64())], names=["lang", "gram", "c"])
    return (per_batch(words, ["lang", "word", "n"], count, "lang string, gram string, c bigint")
            .groupBy("lang", "gram").agg(F.sum("c").alias("c")))


def kneser_ney(top: DataFrame, order: int) -> DataFrame:
    """All orders' entries: lang, k, gram, kind ('p' a probability, 'b' a context's back-off weight), v."""
    levels = {order: top}
    for k in range(order - 1, 0, -1):                                  # continuation counts: distinct left neighbours
        levels[k] = stage(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram"))
                          .agg(F.count(F.lit(1)).alias("c")), "langid-grams")
    out, lower = None, None
    for k in range(1, order + 1):
        g = levels[k].withColumn("ctx", F.substring("gram", 1, k - 1))
        ones = [F.sum((F.col("c") == i).cast("double")) for i in (1, 2)]
        disc = g.groupBy("lang").agg(((ones[0] + 0.5) / (ones[0] + 2 * ones[1] + 1)).alias("d"))
        ctx = (g.groupBy("lang", "ctx").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("types"))
               .join(F.broadcast(disc), "lang").withColumn("b", F.col("d") * F.col("types") / F.col("t")))   # disc: one row a language
        own = g.join(ctx, ["lang", "ctx"]).withColumn("a", F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("t"))
        if k == 1:
            p = own.withColumn("v", F.col("a") + F.col("b") / (F.col("types") + 1))
            unseen = ctx.select("lang", F.lit(0).alias("k"), F.lit("").alias("gram"), F.lit("p").alias("kind"),
                                (F.col("b") / (F.col("types") + 1)).alias("v"))
            out = unseen
        else:
            p = (own.withColumn("rest", F.substring("gram", 2, k - 1))
                 .join(lower.select("lang", F.col("gram").alias("rest"), F.col("v").alias("low")), ["lang", "rest"])
                 .withColumn("v", F.col("a") + F.col("b") * F.col("low")))
            out = out.union(ctx.select("lang", F.lit(k - 1).alias("k"), F.col("ctx").alias("gram"), F.lit("b").alias("kind"), F.col("b").alias("v")))
        lower = stage(p.select("lang", "gram", "v"), "langid-order")
        out = out.union(lower.select("lang", F.lit(k).alias("k"), "gram", F.lit("p").alias("kind"), "v"))
    return out


def write_model(entries: DataFrame) -> tuple[str, int]:
    entries = stage(entries, "langid-entries")
    folder, files = shared_folder(entries.sparkSession, "langid"), files_for(entries.count())

    def hashed(batch: pa.RecordBatch):
        lang, grams, kind = (batch.column(i).to_pylist() for i in range(3))
        h = np.zeros(len(grams), np.uint64)
        for k in set(map(len, grams)):
            at = [i for i, g in enumerate(grams) if len(g) == k]
            cps = code_points("".join(grams[i] for i in at)).reshape(len(at), k)
            start = np.array([salt(lang[i], kind[i] + str(k)) for i in at], np.uint64)
            h[at] = gram_hash([cps[:, j] for j in range(k)], start)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(3)], names=["h", "v"])

    def write(key, rows):
        h = rows["h"].to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        save(folder, f"part-{key[0].as_py():06d}", {"hash": h[order], "v": np.log2(rows["v"].to_numpy()[order]).astype(np.float32)})
        return pa.table({"part": [key[0].as_py()], "rows": [len(h)]})

    (per_batch(entries, ["lang", "gram", "kind", "v"], hashed, "h bigint, v double")
     .withColumn("part", file_column(F.col("h"), files).cast("long")).groupBy("part")
     .applyInArrow(write, "part bigint, rows bigint").agg(F.sum("rows")).first())
    return folder, files


def lookup(folder: str, files: int, h: np.ndarray) -> np.ndarray:
    """Values of hashes; NaN where there is none."""
    keys, back = np.unique(h, return_inverse=True)
    out = np.full(len(keys), np.nan, np.float32)
    for at, row, f in find(folder, files, keys):
        out[at] = f["v"][row]
    return out[back]


def word_scores(words: list[str], langs: list[str], order: int, folder: str, files: int) -> np.ndarray:
    """A row for each word: log2 probability in every language, and the number of predicted characters."""
    if not words:
        return np.zeros((0, len(langs) + 1))
    pad = START * (order - 1)
    cps = code_points("".join(pad + w + END for w in words))
    size = np.array([len(w) + 1 for w in words])
    first = np.concatenate([[0], np.cumsum(size + order - 1)[:-1]])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.repeat(first - begin, size) + np.arange(size.sum())
    cols = [cps[at + j] for j in range(order)]
    out = np.zeros((len(words), len(langs) + 1))
    out[:, -1] = size
    for n, lang in enumerate(langs):
        total, todo = np.zeros(len(at)), np.arange(len(at))
        for k in range(order, -1, -1):
            run = [c[todo] for c in cols[order - k:]]
            v = lookup(folder, files, gram_hash(run, np.full(len(todo), salt(lang, f"p{k}"))))
            seen = ~np.isnan(v)
            total[todo[seen]] += v[seen]
            todo = todo[~seen]
            if not len(todo) or k == 0:
                break
            run = [c[todo] for c in cols[order - k:order - 1]]
            b = lookup(folder, files, gram_hash(run, np.full(len(todo), salt(lang, f"b{k - 1}")))) if k > 1 else np.zeros(len(todo))
            total[todo] += np.nan_to_num(b, nan=0.0)
        out[:, n] = np.add.reduceat(total, begin)
    return out


class Scorer:
    """Summed word scores of texts, with memos of words and of blank-separated chunks."""

    def __init__(self, langs, order, folder, files, room=800_000):
        self.args, self.room, self.width = (langs, order, folder, files), room, len(langs) + 1
        self.clear()

    def clear(self):
        self.chunks, self.words = {}, {}
        self.rows, self.used = np.zeros((1024, self.width), np.float32), 0

    def put(self, rows: np.ndarray) -> range:
        while self.used + len(rows) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used:self.used + len(rows)] = rows
        self.used += len(rows)
        return range(self.used - len(rows), self.used)

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self.chunks) > self.room or len(self.words) > self.room:
            self.clear()
        cut = [t.lower().split() for t in texts]
        new = [(c, WORDS(c)) for c in set().union(*cut).difference(self.chunks)]
        words = list({w for _, ws in new for w in ws}.difference(self.words))
        self.words.update(zip(words, self.put(word_scores(words, *self.args))))
        several = [(c, ws) for c, ws in new if len(ws) != 1]
        self.chunks.update((c, self.words[ws[0]]) for c, ws in new if len(ws) == 1)
        if several:
            sums = np.array([self.rows[[self.words[w] for w in ws]].sum(0) if ws else np.zeros(self.width) for _, ws in several])
            self.chunks.update(zip((c for c, _ in several), self.put(sums)))
        get = self.chunks.__getitem__
        return np.array([self.rows[np.fromiter(map(get, c), np.int64, len(c))].sum(0, dtype=np.float64) if c else np.zeros(self.width) for c in cut])


_SCORERS: dict[str, Scorer] = {}


def identify(docs: DataFrame, order: int = 4, reject_share: float = 0.001, folds: int = 4) -> DataFrame:
    """Every document's language: doc_id, lang_pred, score, cross_entropy (bits a character), rejected.

    Learns from rows with a language that are not held out. ``und`` for a null text or one without a letter, with score
    0; if no row has a language, for all. Ties go to the first language in order of name. Null keys stay, repeated
    rows get the same answer, other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    train = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), folds))
    words = stage(word_counts(train), "langid-words")
    langs = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]     # one row a language
    if not langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected"))
    folder, files = write_model(kneser_ney(stage(gram_counts(words, order), "langid-grams"), order))

    def run(batch: pa.RecordBatch):
        if folder not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[folder] = Scorer(langs, order, folder, files)
        texts, parts = [t or "" for t in batch.column(1).to_pylist()], []
        for lo in range(0, len(texts), 400):
            parts.append(_SCORERS[folder].of(texts[lo:lo + 400]))
        s = np.concatenate(parts)
        h = -s[:, :-1] / np.maximum(s[:, -1:], 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(h), pa.list_(pa.float64())),
                                          pa.array(s[:, -1].astype(np.int64))], names=["doc_id", "lang", "h", "n"])

    scored = stage(per_batch(docs, ["doc_id", "text", "lang"], run, "doc_id bigint, lang string, h array<double>, n bigint"), "langid-scores")
    names = F.array(*map(F.lit, langs))
    best = F.array_min("h")
    scored = scored.withColumn("best", best).withColumn("at", F.array_position("h", best).cast("int")).withColumn("pred", F.get(names, F.col("at") - 1))
    known = scored.where((F.col("n") > 0) & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), folds))

    def chance(h, t):
        return 1 / F.aggregate("h", F.lit(0.0), lambda a, x: a + F.exp(F.greatest((h - x) * t, F.lit(-700.0))))
    own = F.get("h", F.array_position(names, F.col("lang")).cast("int") - 1)
    fits = known.agg(*[F.avg(F.log(F.greatest(chance(own, t), F.lit(1e-300)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    temperature = max(TEMPERATURES, key=lambda t: (fits[f"t{TEMPERATURES.index(t)}"] or -1e9, -t))
    limits = known.where("pred = lang").groupBy("pred").agg(F.percentile_approx("best", 1 - reject_share, 10000).alias("limit"))
    none = F.col("n") == 0
    return (scored.join(F.broadcast(limits), "pred", "left")           # one row a language
            .select("doc_id", F.when(none, "und").otherwise(F.col("pred")).alias("lang_pred"),
                    F.when(none, 0.0).otherwise(chance(F.col("best"), temperature)).alias("score"),
                    F.when(~none, F.col("best")).alias("cross_entropy"),
                    (~none & F.coalesce(F.col("best") > F.col("limit"), F.lit(False))).alias("rejected")))
