"""Byte-pair encoding by a deterministic token automaton.

The automaton is compiled from the merge list by successive merge gadgets. It begins
with one state from which every base symbol loops. The gadget of a merge (a, b) -> c does,
for every path q -a-> r -b-> s: send the a arc to a copy of r that lacks the b arc,
and add q -c-> s. After the last merge the automaton accepts exactly the token sequences
that merging would give, so a word has one accepting path.

Two facts keep it small. The target of an arc depends on its label only, so a state is
"the last label read"; and the state of c is the state of b as it stood when c was made.
A gadget hence stores only the arc that it removes (b, at time m, from the state of a).
An arc v leaves a state unless some b on v's chain of left parts was removed from
it before v branched off b. With labels numbered by depth-first order of that left-part tree,
younger branches first, each removal is one interval of labels.

Rows of the transition table are filled when they are first needed (a dense table would
have the square of the vocabulary's size). Encoding reads a word once from left to right;
each prefix has one state. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.tasks import tidy
from weftgraph.runtime import ship_package

SPACE = "\t-\r \x85\xa0  -     　"
#: Words whose ids a task keeps; beyond that the memo starts anew.
MEMO_WORDS = 200_000
#: Rows and text bytes of one output batch; a longer text is handled alone.
ROWS_OUT, BYTES_OUT = 256, 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class MergeAutomaton:
    """Deterministic automaton over tokens for one vocabulary and merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.labels = [""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.labels[i] = token
        n, self.suffix = len(self.labels), suffix
        self.made = [-1] * n  # when a token was made; base symbols: -1
        self.left, self.right = [-1] * n, [-1] * n
        self.removed: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # own removals of a state: (time, label)
        gone: list[dict[int, int]] = [{} for _ in range(n)]  # the same by label
        branches: list[list[int]] = [[] for _ in range(n)]
        for m, (a, b) in enumerate(merges):
            ia, ib, ic = vocab[a], vocab[b], vocab[(a + b)]
            if self.made[ic] >= 0 or ic in (ia, ib):
                raise ValueError(f"merge {m} makes {a + b!r} again; the automaton would not be deterministic")
            if not self._met(ia, ib, gone):
                continue  # no path reads a and then b, so the gadget adds nothing
            self.removed[ia].append((m, ib))
            gone[ia][ib] = m
            self.made[ic], self.left[ic], self.right[ic] = m, ia, ib
            branches[ia].append(ic)
        self.first, ends = [0] * n, [0] * n
        self.branch_ends: list[tuple[list[int], list[int]]] = [([], [])] * n
        clock = 0
        for root in range(n):
            if self.left[root] >= 0:
                continue
            stack = [(root, False)]
            while stack:
                x, done = stack.pop()
                if done:
                    ends[x] = clock
                    continue
                self.first[x] = clock
                clock += 1
                stack.append((x, True))
                stack += [(c, False) for c in branches[x]]  # popped youngest first
        for x in range(n):
            self.branch_ends[x] = ([self.made[c] for c in branches[x]], [ends[c] for c in branches[x]])
        self.rows: list[tuple[array, array] | None] = [None] * n
        # trie over base symbols; the last one of a word carries the suffix
        symbols = byte_symbols()
        self.step: dict[int, int] = {}
        self.token_at = [-1]
        back = {c: b for b, c in enumerate(symbols)}
        for token, i in vocab.items():
            last = bool(suffix) and token.endswith(suffix)
            body = token[: len(token) - len(suffix)] if last else token
            if not body or any(c not in back for c in body) or (len(body) > 1 and self.made[i] < 0):
                continue
            node = 0
            for k, c in enumerate(body):
                key = node << 9 | back[c] | (256 if last and k == len(body) - 1 else 0)
                node = self.step.setdefault(key, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.final = 256 if suffix else 0

    def _met(self, a: int, b: int, gone: list[dict[int, int]]) -> bool:
        """Whether a and b are both made (or base symbols) and b leaves the state of a just now."""
        base = lambda t: len(self.labels[t].removesuffix(self.suffix) if self.suffix else self.labels[t]) == 1
        if any(self.made[t] < 0 and not base(t) for t in (a, b)):
            return False
        chain, x, since = [], b, 1 << 60
        while x >= 0:
            chain.append((x, since))
            x, since = self.left[x], self.made[x]
        x, limit = a, 1 << 60
        while x >= 0:
            if (own := gone[x]) and any(own.get(v, limit) < limit and own[v] <= t for v, t in chain):
                return False
            limit = min(limit, self.made[x]) if self.made[x] >= 0 else limit
            x = self.right[x]
        return True

    def row(self, u: int) -> tuple[array, array]:
        """Missing arcs of u's state, as disjoint sorted intervals of label numbers."""
        if (got := self.rows[u]) is not None:
            return got
        spans, x, limit = [], u, 1 << 60
        while x >= 0:
            for m, b in self.removed[x]:
                if m >= limit:
                    break
                times, ends = self.branch_ends[b]
                k = bisect_left(times, m)  # branches of b made at m or later stand first
                spans.append((self.first[b], ends[k] if k < len(ends) else self.first[b] + 1))
            limit = min(limit, self.made[x]) if self.made[x] >= 0 else limit
            x = self.right[x]
        spans.sort()
        starts, stops = array("i"), array("i")
        for s, e in spans:
            if stops and s <= stops[-1]:
                stops[-1] = max(stops[-1], e)
            else:
                starts.append(s)
                stops.append(e)
        self.rows[u] = (starts, stops)
        return starts, stops

    def encode(self, word: bytes) -> array:
        """Token ids of one pre-split word."""
        n = len(word)
        state, came = [-1] * (n + 1), [0] * (n + 1)
        step, token_at, first = self.step, self.token_at, self.first
        for i in range(n):
            u = state[i]
            if u < 0 and i:
                raise ValueError(f"a symbol before place {i} is not in the vocabulary")
            starts, stops = self.row(u) if i else ((), ())
            node = 0
            for j in range(i, n):
                node = step.get(node << 9 | word[j] | (self.final if j == n - 1 else 0), -1)
                if node < 0:
                    break
                t = token_at[node]
                if t >= 0 and state[j + 1] < 0:
                    if i:
                        k = bisect_right(starts, first[t]) - 1
                        if k >= 0 and first[t] < stops[k]:
                            continue
                    state[j + 1], came[j + 1] = t, i
        out, at = array("I"), n
        while at:
            if state[at] < 0:
                raise ValueError("a symbol of the word is not in the vocabulary")
            out.append(state[at])
            at = came[at]
        out.reverse()
        return out


class WordTokenizer:
    """The normaliser, splitter and automaton that a tokenizer file describes."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        added = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.added = added
        top = max(added.values(), default=-1)
        labels = self.automaton.labels
        labels += [""] * (top + 1 - len(labels))
        for content, i in added.items():
            labels[i] = content
        self.labels = labels
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        splits = [p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"].replace("\\s", SPACE)
        self.words = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def normalise(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # lower case letter by letter: no final sigma
        return text.lower()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = self.cut.split(text) if self.cut else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out += map(self._word, self.words.findall(self.normalise(part)))
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            got = self.automaton.encode(word.encode("utf-8", "surrogatepass")).tobytes()
            if len(word) <= 64:
                self.memo[word] = got
        return got

    def decode(self, ids: bytes) -> str:
        """The labels of the ids, joined as a file without a decoder asks for."""
        return spelled(self.labels, ids)

    def forget(self) -> None:
        """Empty the memo and the transition rows, as the tool was made."""
        self.memo.clear()
        self.automaton.rows = [None] * len(self.automaton.rows)


def spelled(labels: list[str], ids: bytes) -> str:
    """The text that packed ids spell."""
    return " ".join(map(labels.__getitem__, memoryview(ids).cast("I")))


def label_list(spec: str) -> list[str]:
    """The label of every id in a tokenizer file."""
    d = json.loads(spec)
    by_id = {i: token for token, i in d["model"]["vocab"].items()} | {t["id"]: t["content"] for t in d.get("added_tokens", [])}
    return [by_id.get(i, "") for i in range(max(by_id, default=-1) + 1)]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows within ROWS_OUT and BYTES_OUT."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at == ROWS_OUT or total + n > BYTES_OUT):
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _mapped(df: DataFrame, column: str, made: dict[str, str], tool, fn) -> DataFrame:
    """Append the columns that a function of one column and a broadcast tool gives; batches are cut to bound memory."""
    ship_package(df.sparkSession)
    fields = [c for c in df.columns if c not in made]
    schema = T.StructType([*(df.schema[c] for c in fields), *(T.StructField(c, T.StringType() if k == "string" else T.BinaryType()) for c, k in made.items())])
    shared = df.sparkSession.sparkContext.broadcast(tool)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        try:
            for batch in batches:
                sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
                for at, to in _slices(sizes):
                    part = batch.slice(at, to - at)
                    values = [fn(held, v.as_py()) for v in part.column(column)]
                    cols = [part.column(c) for c in fields]
                    cols += [pa.array([v[k] for v in values], pa.string() if kind == "string" else pa.binary()) for k, kind in enumerate(made.values())]
                    yield pa.RecordBatch.from_arrays(cols, names=[*fields, *made])
        finally:
            if hasattr(held, "forget"):
                held.forget()

    return df.mapInArrow(run, schema)


def _spec(tokenizer_path: str) -> str:
    """The tokenizer file, read on the driver (its size does not depend on the data)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append column `out`: the token ids of `text` as packed little-endian unsigned 32-bit integers.

    A null or empty text gives no ids (empty binary). All other columns stay; one named
    `out` is replaced. Text of any length is encoded whole. The automaton is compiled on the driver and broadcast.
    """
    return _mapped(df, text, {out: "binary"}, WordTokenizer(_spec(tokenizer_path)), lambda t, v: (t.encode(v or ""),))


def bpe_decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append column `out`: the text that the arc labels of `ids` spell; null ids give an empty text.

    Only the labels are broadcast. All other columns stay; one named `out` is replaced.
    """
    return _mapped(df, ids, {out: "string"}, label_list(_spec(tokenizer_path)), lambda t, v: (spelled(t, v or b""),))


def bpe_round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """bpe_encode and bpe_decode in one pass over the rows, under the same rules."""

    def both(t: WordTokenizer, v: str | None) -> tuple[bytes, str]:
        got = t.encode(v or "")
        return got, t.decode(got)

    return _mapped(df, text, {ids: "binary", decoded: "string"}, WordTokenizer(_spec(tokenizer_path)), both)


def op1_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; null text counts as empty."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = bpe_round_trip(docs, path)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
