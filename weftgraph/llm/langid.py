"""Language of each word and document by a linear-chain conditional random field.

A word's features are its prefixes and suffixes, character n-grams, and the lexicons that hold
it (the frequent words of each language in the training sample); transitions between the words'
labels are learned with them, on word sequences spliced from texts in different languages.
Forward-backward gives every word's label probabilities; a document takes the language of the
largest mean over its words with letters.

Probabilities of the learned labels always sum to one, so they cannot tell that a text is in none of
these languages. `known` can, whatever their number: it is the mean over the words of the share
of character trigrams that the training sample has.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftgraph.llm.quality import held_out
from weftgraph.llm.tasks import tidy
from weftgraph.llm.words import chunks
from weftgraph.runtime import ship_package

UNKNOWN = "und"
#: Training documents of one language and of all (each language has one at least), words in a lexicon, hashed features.
PER_LANGUAGE, SAMPLE_ROWS, LEXICON, BITS = 256, 20_000, 500, 17
#: What one training document gives at most: runs of words, spread evenly over the whole text, and bytes of a word.
RUNS, RUN_WORDS, WORD_BYTES = 8, 64, 1024
SEQUENCES, LENGTH, EPOCHS, RATE, L2 = 400, 96, 3, 0.5, 1e-4
#: Words labelled together, and words whose scores a task keeps.
WORDS_AT_ONCE, MEMO_WORDS = 100_000, 200_000
#: Bytes of new words whose features are listed at once, and of words in the memo; a longer word is handled alone.
LEARN_BYTES, MEMO_BYTES = 1 << 17, 1 << 24
SALTS = 32
#: Words of a text that messages pass in one go.
PIECE = 64
_STRIP = "«»„“”’‘…–—¿¡\u00a0"
#: ASCII characters other than letters part words.
_PARTS = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words in UTF-8, parted by whatever ASCII character is no letter."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS).split()


def bare(word: bytes) -> str:
    """The word without quotes and dashes around it; empty if it has no letter."""
    w = word.decode("utf-8", "surrogatepass").strip(_STRIP)
    return w if w.isalpha() or any(map(str.isalpha, w)) else ""


def features(words: list[str], lexicons: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed features, which of them are trigrams, features by word) of bare words, one word after another; an empty word has none.

    Bigrams and trigrams of the word between marks, characters beyond ASCII, prefixes and suffixes of up to three
    characters, and one feature for each set of lexicons that may hold a word. A gram counts as often as it occurs.
    """
    marked = [f"^{w}$" if w else "" for w in words]
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    a = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(a)) - first[owner]
    left = size[owner] - place  # characters from here on, with the mark
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(salt: int, at: np.ndarray, n: int) -> None:
        h = np.full(len(at), salt, dtype=np.uint64)
        for k in range(n):
            h = (h ^ a[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        found.append((owner[at], (h >> np.uint64(3)) & np.uint64((1 << BITS) - 1)))

    add(3, np.flatnonzero(left >= 3), 3)
    trigrams = len(found[0][0])
    add(2, np.flatnonzero(left >= 2), 2)
    add(1, np.flatnonzero(a > 127), 1)
    some = np.flatnonzero(size)
    for k in (1, 2, 3):
        at = some[size[some] >= k + 2]
        add(10 + k, first[at] + 1, k)
        add(20 + k, first[at] + size[at] - 1 - k, k)
    listed = [(i, bits) for i, bits in enumerate(map(lexicons.get, words)) if bits is not None]
    if listed:
        at, bits = (np.array(v) for v in zip(*listed, strict=True))
        codes = np.array([zlib.crc32(b"lexicons %d" % b) for b in bits.tolist()], dtype=np.uint64)
        found.append((at, codes & np.uint64((1 << BITS) - 1)))
    of, flat = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.argsort(of, kind="stable")
    return flat[order].astype(np.int64), order < trigrams, np.bincount(of, minlength=len(words))


def forward_backward(e: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; e: word factors by row, texts one after another with counts > 0 words each.

    Exact, in pieces of PIECE words, so that a long text needs few steps: the transfer matrix of each piece comes first, for
    all pieces together; messages then go from piece to piece within each text, and last through the words of all pieces together.
    """
    n, pieces = e.shape[1], -(-counts // PIECE)
    text = np.repeat(np.arange(len(counts)), pieces)
    at = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)  # place of a piece in its text
    length = np.minimum(PIECE, counts[text] - at * PIECE)
    start = (np.cumsum(counts) - counts)[text] + at * PIECE
    order = np.argsort(-length, kind="stable")  # so that step t touches a leading part
    start, first = start[order], (at == 0)[order][:, None]
    alive = np.searchsorted(-length[order], -np.arange(int(length.max())), side="left")
    carry = np.empty((len(text), n, n), dtype=e.dtype)
    for t, m in enumerate(alive):
        step = np.where(first[:m, :, None], 1, trans) if t == 0 else (carry[:m].reshape(-1, n) @ trans).reshape(m, n, n)
        step = step * e[start[:m] + t][:, None, :]
        carry[:m] = step / step.max(axis=(1, 2), keepdims=True)
    where = np.empty_like(order)
    where[order] = np.arange(len(order))
    heads = np.cumsum(pieces) - pieces
    long_first = np.argsort(-pieces, kind="stable")
    deep = np.searchsorted(-pieces[long_first], -np.arange(int(pieces.max())), side="left")
    into, out = np.full((len(text), n), 1 / n, dtype=e.dtype), np.full((len(text), n), 1 / n, dtype=e.dtype)
    for k in range(1, len(deep)):
        to = where[heads[long_first[: deep[k]]] + k]
        before = where[heads[long_first[: deep[k]]] + k - 1]
        v = (into[before][:, None, :] @ carry[before])[:, 0]
        into[to] = v / v.sum(axis=1, keepdims=True)
    for k in range(len(deep) - 2, -1, -1):
        to = where[heads[long_first[: deep[k + 1]]] + k]
        after = where[heads[long_first[: deep[k + 1]]] + k + 1]
        v = (carry[after] @ out[after][:, :, None])[:, :, 0]
        out[to] = v / v.sum(axis=1, keepdims=True)
    a = np.empty_like(e)
    for t, m in enumerate(alive):
        v = into[:m] @ trans
        if t == 0:
            v = np.where(first[:m], 1, v)
        v = v * e[start[:m] + t]
        v /= v.sum(axis=1, keepdims=True)
        a[start[:m] + t] = into[:m] = v
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        rows = start[:m] + t
        p = a[rows] * out[:m]
        v = (out[:m] * e[rows]) @ trans.T
        a[rows] = p / p.sum(axis=1, keepdims=True)
        out[:m] = v / v.sum(axis=1, keepdims=True)
    return a


class Tagger:
    """Weights of features [2**BITS, labels], transitions, and the trigrams of the training sample, with a memo of word factors."""

    def __init__(self, labels: list[str], lexicons: dict[str, int], weights: np.ndarray, trans: np.ndarray, seen: np.ndarray | None = None):
        self.labels, self.lexicons, self.weights, self.trans = labels, lexicons, weights.astype(np.float32), np.exp(trans).astype(np.float32)
        self.seen = np.zeros(len(weights), dtype=bool) if seen is None else seen
        self.forget()

    def forget(self) -> None:
        """Empty the memo."""
        self.memo: dict[bytes, int] = {}
        self.held = 0
        self.table = np.empty((1024, len(self.labels)), dtype=np.float32)
        self.letters = np.empty(1024, dtype=bool)
        self.known = np.empty(1024, dtype=np.float32)

    def _learn(self, words: list[bytes]) -> None:
        """Put the factors of new words into the memo."""
        flat, tri, n = features(list(map(bare, words)), self.lexicons)
        sums, known = np.zeros((len(words), len(self.labels))), np.zeros(len(words))
        some = np.flatnonzero(n)
        if len(some):
            first = (np.cumsum(n) - n)[some]
            sums[some] = np.add.reduceat(self.weights[flat], first, axis=0)
            known[some] = np.add.reduceat(self.seen[flat] & tri, first, dtype=np.float64) / np.add.reduceat(tri, first, dtype=np.float64)
        base, need = len(self.memo), len(self.memo) + len(words)
        if need > len(self.table):
            size = max(need, 2 * len(self.table))
            self.table = np.resize(self.table, (size, len(self.labels)))
            self.letters, self.known = np.resize(self.letters, size), np.resize(self.known, size)
        self.table[base:need] = np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -40, 0))
        self.letters[base:need], self.known[base:need] = n > 0, known
        self.memo.update(zip(words, range(base, need), strict=True))
        self.held += sum(map(len, words))

    def indices(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS or self.held > MEMO_BYTES:
            self.forget()
        memo = self.memo
        new = {w for w in set(words) if w not in memo}
        if new:
            for _, part in chunks(sorted(new), LEARN_BYTES):
                self._learn(part)
        return np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))

    def posteriors(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities by word, whether it has a letter, its share of known trigrams, words by text); texts must have words."""
        counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        at = self.indices([w for t in texts for w in t])
        return forward_backward(self.table[at], self.trans, counts), self.letters[at], self.known[at], counts

    def documents(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, mean probability, mean share of known trigrams) of each text."""
        out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        if not self.labels:
            return out
        group: list[tuple[int, list[bytes]]] = []
        size = 0
        for i, text in enumerate(texts):
            words = tokens(text)
            if words:
                group.append((i, words))
                size += max(len(words), len(text) // 16)  # scripts without spaces have few, long words
            if group and (size >= WORDS_AT_ONCE or i == len(texts) - 1):
                p, letters, known, counts = self.posteriors([w for _, w in group])
                starts = np.cumsum(counts) - counts
                sums = np.add.reduceat(p * letters[:, None], starts, axis=0, dtype=np.float64)
                n = np.add.reduceat(letters.astype(np.int64), starts)
                share = np.add.reduceat(known, starts, dtype=np.float64)
                for (k, _), s, c, t in zip(group, sums, n, share, strict=True):
                    if c:
                        best = int(s.argmax())
                        out[k] = (self.labels[best], float(min(1.0, s[best] / c)), float(min(1.0, t / c)))
                group, size = [], 0
        return out


def train(samples: list[tuple[list[bytes], str]], seed: int = 5) -> Tagger:
    """A tagger from (words, language) pairs."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[list[bytes]]] = {}
    for doc, lang in sorted(samples):
        if doc:
            by.setdefault(lang, []).append(doc)
    labels = sorted(by)
    n = len(labels)
    if not n:
        return Tagger([], {}, np.zeros((1 << BITS, 0)), np.zeros((0, 0)))
    lexicons: dict[str, int] = {}
    seen = np.zeros(1 << BITS, dtype=bool)
    for y, lang in enumerate(labels):
        counted: Counter = Counter()
        for w, c in Counter(w for t in by[lang] for w in t).items():
            counted[bare(w)] += c
        del counted[""]
        flat, tri, _ = features(list(counted), {})
        seen[flat[tri]] = True
        for w, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicons[w] = lexicons.get(w, 0) | 1 << y
    words: dict[bytes, int] = {}
    x, y = np.empty((SEQUENCES, LENGTH), dtype=np.int64), np.empty((SEQUENCES, LENGTH), dtype=np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < LENGTH:  # runs of one language after another
            k = int(rng.integers(n))
            doc = by[labels[k]][int(rng.integers(len(by[labels[k]])))]
            m = min(int(rng.integers(4, 48)), len(doc), LENGTH - at)
            start = int(rng.integers(len(doc) - m + 1))
            x[s, at : at + m] = [words.setdefault(w, len(words)) for w in doc[start : start + m]]
            y[s, at : at + m] = k
            at += m
    flat, _, sizes = features(list(map(bare, words)), lexicons)
    owner = np.repeat(np.arange(len(words)), sizes)
    some, first = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[np.flatnonzero(sizes)]
    w, trans = np.zeros((1 << BITS, n)), np.zeros((n, n))
    gw, gt = np.full_like(w, 1e-2), np.full_like(trans, 1e-2)
    batch = 40
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(SEQUENCES), max(1, SEQUENCES // batch)):
            scores = np.zeros((len(words), n))
            if len(some):
                scores[some] = np.add.reduceat(w[flat], first, axis=0)
            e, a = scores[x[rows]], np.exp(trans)
            e = np.exp(e - e.max(axis=2, keepdims=True))
            f, b = np.empty_like(e), np.empty_like(e)
            for t in range(LENGTH):
                v = e[:, t] if not t else (f[:, t - 1] @ a) * e[:, t]
                f[:, t] = v / v.sum(axis=1, keepdims=True)
            b[:, -1] = 1
            for t in range(LENGTH - 2, -1, -1):
                v = (b[:, t + 1] * e[:, t + 1]) @ a.T
                b[:, t] = v / v.sum(axis=1, keepdims=True)
            p = f * b
            p /= p.sum(axis=2, keepdims=True)
            pair = f[:, :-1, :, None] * a * (e[:, 1:] * b[:, 1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            true = np.eye(n)[y[rows]]
            grad = np.zeros((len(words), n))
            np.add.at(grad, x[rows].ravel(), (true - p).reshape(-1, n))
            step = np.stack([np.bincount(flat, grad[owner, k], 1 << BITS) for k in range(n)], axis=1) / len(rows) - L2 * w
            gw += step**2
            w += RATE * step / np.sqrt(gw)
            step = (np.einsum("sti,stj->ij", true[:, :-1], true[:, 1:]) - pair.sum(axis=(0, 1))) / len(rows)
            gt += step**2
            trans += RATE * step / np.sqrt(gt)
    return Tagger(labels, lexicons, w, trans, seen)


def word_runs(text: str | None) -> list[bytes]:
    """The words of a training text: all, or RUNS runs of RUN_WORDS spread evenly; longer words than WORD_BYTES teach nothing."""
    words = [w for w in tokens(text) if len(w) <= WORD_BYTES]
    if len(words) <= RUNS * RUN_WORDS:
        return words
    starts = [k * (len(words) - RUN_WORDS) // (RUNS - 1) for k in range(RUNS)]
    return [w for s in starts for w in words[s : s + RUN_WORDS]]


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most: int = SAMPLE_ROWS) -> Tagger:
    """Train on a bounded sample of the documents that are not held out; null languages and texts teach nothing.

    The sample has at most per_language documents of each language and about `most` in all (one of each language at least), those of the least
    hashes of ids, and of each RUNS * RUN_WORDS words at most. Executors cut the words, so no whole text reaches the driver.
    """
    ship_package(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("_i"), F.col(lang).alias("_g"), F.col(text).alias("_t")).filter(~held_out("_i") & F.col("_g").isNotNull() & F.col("_t").isNotNull())
    keys = known.select("_i", "_g", F.xxhash64(F.lit(1), "_i").alias("_h"))
    salted = Window.partitionBy("_g", F.pmod("_h", F.lit(SALTS))).orderBy("_h", "_i")
    keys = keys.withColumn("_n", F.row_number().over(salted)).filter(F.col("_n") <= -(-per_language // SALTS) * 2)
    whole = Window.partitionBy("_g").orderBy("_h", "_i")  # 2 * per_language + 2 * SALTS rows of a language at most
    keys = keys.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= per_language)
    chosen = keys.orderBy("_n", "_h", "_i").limit(most).select("_i").distinct()
    first = keys.filter("_n = 1").select("_i")
    ids = chosen.union(first).distinct().withColumnRenamed("_i", "_c").collect()
    kind = docs.schema[id_col].dataType.simpleString()
    picked = known.join(F.broadcast(docs.sparkSession.createDataFrame([(r[0],) for r in ids], f"_c {kind}")), F.col("_i") == F.col("_c")).select("_g", "_t")

    @tidy
    def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = word_runs(batch.column("_t")[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("_g").slice(i, 1), pa.array([b" ".join(words)], pa.binary())], names=["_g", "_w"])

    rows = picked.mapInArrow(cut_words, T.StructType([picked.schema["_g"], T.StructField("_w", T.BinaryType())])).collect()
    return train([(bytes(r["_w"]).split(b" ") if r["_w"] else [], r["_g"]) for r in rows])


def detect_languages(df: DataFrame, model: Tagger, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """Append the language, its mean probability and the mean share of known trigrams, under the names in `out`.

    A null text, or one without a letter, gets UNKNOWN, 0 and 0. Other columns stay; columns with these names are
    replaced.
    """
    spark = df.sparkSession
    ship_package(spark)
    model.forget()
    packed = spark.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in out]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.DoubleType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = packed.value
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = tool.documents(part.column(text).to_pylist())
                    cols = [*(part.column(c) for c in kept), pa.array([x[0] for x in found], pa.string()), *(pa.array([x[k] for x in found], pa.float64()) for k in (1, 2))]
                    yield pa.RecordBatch.from_arrays(cols, names=[*kept, *out])
        finally:
            tool.forget()

    return df.mapInArrow(run, schema)


def label_words(text: str, model: Tagger) -> list[tuple[str, str, float]]:
    """(word, language, probability) of every word of one text; UNKNOWN for words without letters."""
    words = tokens(text)
    names = [w.decode("utf-8", "surrogatepass") for w in words]
    if not words or not model.labels:
        return [(w, UNKNOWN, 0.0) for w in names]
    p, letters, _, _ = model.posteriors([words])
    return [(w, model.labels[int(v.argmax())], float(v.max())) if l else (w, UNKNOWN, 0.0) for w, v, l in zip(names, p, letters, strict=True)]


def op9_crf_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and known of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = detect_languages(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "known")
