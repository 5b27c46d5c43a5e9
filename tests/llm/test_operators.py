"""The training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

from __future__ import annotations

import gc
import hashlib
import random
import re
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pytest

from weftgraph.llm import bpe, gbdt, langid, minhash, mixing, mpeg, neighbours, permute, pii, quality, sharding, substrings, words
from weftgraph.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c", "en", "s1", 5), (1, "a b c", "en", "s1", 5), (None, None, None, None, None), (2, "", "de", None, 0), (3, "q " * 3000, "en", "s2", 6000), (4, "Ünï ☃ 12", None, "s2", 8), (None, "tail", "fr", "s1", 4)]
KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASH = ["ids", "decoded", "media", "payload", "stats", "score", "lang_pred", "spans", "base_spans", "kept", "shard", "slot", "row_no", "taken", "target", "class_id", "key", "sig"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASH})


# byte-pair encoding


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return bpe.WordTokenizer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_encoding_equals_the_library(tokenizer, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    letters = "abcdethein'sreÉΣß 1234.,!\n\t<|startoftext|>"
    texts = [r.text for r in docs.values()] + ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += ["", " ", "<|startoftext|>hi<|endoftext|>x", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, "ΑΣ ΑΣΣ", unicodedata.normalize("NFD", "épée")]
    for text, want in zip(texts, known.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = tokenizer.encode(text)
        assert list(memoryview(ids).cast("I")) == want.ids
        assert tokenizer.decode(ids) == known.decode(want.ids, skip_special_tokens=False)


def test_gadget_automaton_equals_merging():
    rng = random.Random(1)
    symbols = list("abc")
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate(symbols)}, []
        while len(merges) < 12:
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab and len(a + b) < 9:
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        machine = bpe.MergeAutomaton(vocab, merges)
        for _ in range(40):
            word = "".join(rng.choice(symbols) for _ in range(rng.randrange(1, 14)))
            parts = list(word)
            for a, b in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == a and parts[i + 1] == b:
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert [machine.labels[i] for i in machine.encode(word.encode())] == parts


def test_repeated_merge_is_refused():
    with pytest.raises(ValueError):
        bpe.MergeAutomaton({"a": 0, "b": 1, "ab": 2}, [("a", "b"), ("a", "b")])


def test_bpe_on_odd_rows(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    done = bpe.bpe_decode(bpe.bpe_encode(clashing(odd), path), path)
    rows = done.collect()
    assert len(rows) == len(ODD) and all(r.score == 7 for r in rows)
    assert all(bytes(r.ids) == b"" and r.decoded == "" for r in rows if not r.text)
    assert bpe.bpe_encode(odd.limit(0), path).collect() == []


def test_bpe_query_equals_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in QUERIES["op1_bpe_automaton"](spark, SF).collect():
        ids = known.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_one_long_text_of_several_batches(spark, tokenizer):
    import public_tokenizers

    rng = random.Random(6)
    text = " ".join(rng.choice(["the", "entebest", "thation", "99", "é"]) for _ in range(600_000))  # beyond 2 MB
    rows = [(0, "a b"), (1, text), (2, None), (3, "tail")]
    done = {r.doc_id: r for r in bpe.bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert bytes(done[1].ids) == tokenizer.encode(text) and done[1].decoded == tokenizer.decode(done[1].ids) and done[2].decoded == "" and done[3].decoded
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[1][0] == 600_000
    assert len(minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 4
    assert quality.statistics(text)[0] == pytest.approx(np.log1p(600_000))


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            n = len(digits)
            fine = kind == "email" or (all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 14 <= n <= 19 and luhn(digits) if kind == "card" else 10 <= n <= 15)
            if fine:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("0123456789012345ab.@-+ ()_%é😀") for _ in range(rng.randrange(100))) for _ in range(800)]
    texts += ["".join(rng.choice("ab.@-_+%") for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["a@b.c_d@e.f..g@h.i", "1.2.3.4.5.6.7.8", "4111111111111111 4785 3805 9239 1139", "+1 (706) 555-3138", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii_spans(df).collect():
        want = base_spans(r.text or "")
        assert [(s.kind, s.start, s.end) for s in r.base_spans] == want, r.text
        assert set(want) <= {(s.kind, s.start, s.end) for s in r.spans}


def all_spans(text):
    """Base spans and accepted candidates, by the same generators and features in Python."""
    import regex

    trees, least = pii.model()
    base = [(s, pii.KINDS.index(k), e) for k, s, e in base_spans(text)]
    items = [(s, r, e, False, 0.0) for s, r, e in base]
    for g, (kind, pattern) in enumerate(pii.GENERATORS.values()):
        for m in regex.finditer(pattern, text):
            f = pii.features_of(g, m[0], text[max(0, m.start() - pii.BEFORE) : m.start()])
            score = float(trees.margin(np.array([f]))[0])
            if score >= least[kind]:
                items.append((m.start(), pii.KINDS.index(kind), m.end(), True, score))
    out, reach, last = list(base), 0, None
    for s, r, e, extra, score in sorted(items):
        if not extra:
            last = last if last and last[2] <= s else None if last and last[2] > s else last
            if last:
                out.append(last[:3])
                last = None
            reach = max(reach, e)
        elif s >= reach:
            if last and last[2] > s:
                last = (s, r, e, score) if (score, e - s) > (last[3], last[2] - last[0]) else last
            else:
                out += [last[:3]] if last else []
                last = (s, r, e, score)
    out += [last[:3]] if last else []
    return sorted(out)


def test_personal_data_query_equals_brute_force(spark, docs, tmp_path):
    rng = random.Random(5)
    bits = ["ssn 123-45-6789 ", "order 123-45-6789 ", "tel (212) 555-0101 ", "555-0101 ", "0049 301 234 567 ", "anna (at) mail (dot) org ", "key = abcDEF123456 ", "token: ", "0123456789abcdef0123456789abcdef ", "DE44 5001 0517 5407 3249 31 ", "a@b.c ", "1.2.3.4 ", "4111111111111111 ", "x" * 30 + "1 ", "é😀 ", "12345678901 23 "]
    rows = [(r.doc_id, r.text) for r in docs.values()] + [(10**6 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(200)] + [(-1, None), (-2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_pii_boosting"](spark, str(tmp_path)).collect()}
    more = 0
    for i, text in rows:
        base, every = base_spans(text or ""), [(pii.KINDS[r], s, e) for s, r, e in all_spans(text or "")]
        show = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got[i].spans == show(every) and got[i].n_spans == len(every), text
        assert got[i].base_sha256 == hashlib.sha256(show(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(b[0] == k for b in base) for k in PATTERNS]
        more += len(every) - len(base)
    assert more > 100


def test_recall_on_phrases_apart():
    trees, least = pii.model()
    x, y = pii._phrases(random.Random(99), 4000, pii.CALIBRATING)
    kinds = [kind for kind, _ in pii.GENERATORS.values()]
    found = trees.margin(x) >= np.array([least[kinds[int(g)]] for g in x[:, 0]])
    assert found[y == 1].mean() > 0.75 and found[y == 0].mean() < 0.05
    planted = 'Thstorti token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thhantou'
    assert all_spans(planted) == [(18, pii.KINDS.index("secret"), 58)]


def test_personal_data_on_odd_rows(spark, odd):
    wide = clashing(odd)
    rows = pii.pii_redact(wide).collect()
    assert len(rows) == len(ODD) and all(r.spans == r.base_spans == 7 for r in rows)
    assert sorted(map(str, pii.pii_spans(odd).select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert pii.pii_redact(odd.limit(0)).collect() == pii.pii_spans(odd.limit(0)).collect() == []


def test_very_long_runs_end(spark):
    texts = ["a@" + "b." * 60000, "1 " * 50000, "+1" * 30000, "x" * 100000 + "@a.b"]
    rows = pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [len(r.base_spans) for r in rows] == [1, 0, 0, 1]


def test_added_spans_and_redaction(spark):
    text = "write to anna (at) mail (dot) org, phone (212) 555-0101 or ssn 123-45-6789; order 123-45-6789"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    done = {r.doc_id: r.text for r in pii.pii_redact(clashing(df)).collect()}
    assert done[1].startswith("write to [EMAIL], phone [PHONE] or ssn [ID]") and done[1].endswith("order 123-45-6789")
    assert done[2] is None and done[3] == ""


def test_trees_in_sql_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    trees = gbdt.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=12, depth=3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r[0] for r in df.coalesce(1).selectExpr(trees.sql_margin(["a", "b", "c"])).collect()]
    assert sorted(got) == sorted(trees.margin(x).tolist())
    assert ((trees.score(x) > 0.5) == (x[:, 0] + x[:, 1] > 0)).mean() > 0.95


# media


def test_mpeg_round_trip():
    rng = random.Random(3)
    for n in (0, 1, 64, 1417, 1418, 5000, 90000):
        payload = rng.randbytes(n)
        media = mpeg.write_mpeg(payload)
        got = mpeg.read_mpeg(media)
        assert got["payload"] == payload and got["crc_bad"] == got["skipped"] == 0
        assert got["frames"] == got["table_frames"] == len(got["offsets"]) and got["samples"] == 1152 * got["frames"]
        assert all(media[o] == 0xFF and mpeg.header(media, o) for o in got["offsets"])


def test_mpeg_resynchronises_and_checks():
    media = mpeg.write_mpeg(bytes(20000))
    first = mpeg.read_mpeg(media)
    at = first["offsets"][3]
    broken = media[:at] + b"\xff\xe0junk\xff" + media[at:]
    got = mpeg.read_mpeg(broken)
    assert got["frames"] == first["frames"] and got["skipped"] == 7 and got["offsets"][3] == at + 7
    spoiled = bytearray(media)
    spoiled[at + 10] ^= 1  # side information
    assert mpeg.read_mpeg(bytes(spoiled))["crc_bad"] == 1
    assert mpeg.read_mpeg(b"no audio here")["frames"] == 0 and mpeg.read_mpeg(b"")["payload"] == b""
    assert mpeg.read_mpeg(media + b"TAG" + bytes(125))["tags"] == "id3v2,id3v1"


def test_seek_tables():
    import struct

    payload = bytes(range(256)) * 400
    media = mpeg.write_mpeg(payload)
    got = mpeg.read_mpeg(media)
    assert got["table_kind"] == "Xing" and len(got["table_points"]) == 100
    start = got["offsets"][0] - mpeg.LENGTHS[1]  # points count from the table's own frame
    for k in (0, 25, 50, 99):  # each leads to its frame within the table's precision
        assert abs(got["offsets"][k * got["frames"] // 100] - start - got["table_points"][k]) <= got["table_bytes"] / 256 + 1
    frame = bytes((0xFF, 0xFB, 1 << 4 | 2 << 2, 0xC4))
    lame = frame + bytes(17) + b"Info" + struct.pack(">II", 1, 3) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    head = lame + bytes(mpeg.LENGTHS[1] - len(lame))
    plain = frame + bytes(mpeg.LENGTHS[1] - 4)
    got = mpeg.read_mpeg(head + plain * 3)
    assert (got["table_kind"], got["table_frames"], got["frames"], got["samples"], got["heard"]) == ("Info", 3, 3, 3456, 3456 - 1576) and got["table_points"] is None
    vbri = frame + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 529, 75, 4000, 3, 3, 2, 2, 1) + struct.pack(">HHH", 72, 72, 72)
    got = mpeg.read_mpeg(vbri + bytes(mpeg.LENGTHS[1] - len(vbri)) + plain * 3)
    assert (got["table_kind"], got["table_bytes"], got["table_points"], got["heard"]) == ("VBRI", 4000, [0, 144, 288], 3456 - 529)
    cut = frame + bytes(17) + b"Xing" + struct.pack(">I", 15) + bytes(mpeg.LENGTHS[1] - 29)
    assert mpeg.read_mpeg(cut + plain)["table_frames"] == 0


@pytest.mark.parametrize(("second", "third", "mode"), [(0xFE, 0x84, 0xC0), (0xFE, 0x84, 0x00), (0xFE, 0x84, 0x50), (0xFC, 0xA4, 0xC0), (0xFC, 0xA4, 0x00), (0xFC, 0xA4, 0x60), (0xFC, 0x18, 0xC0), (0xF4, 0x84, 0xC0)])
def test_checksums_of_layers_one_and_two(second, third, mode):
    """Layers I and II, one and two channels, joint stereo, low rates: a flip counts exactly where the checksum reaches."""
    rng = random.Random(second * 7 + mode)
    version, layer, size, _, hertz, checked, _, kbit = mpeg.header(bytes((0xFF, second, third, mode)), 0)
    assert checked and layer in (1, 2)
    body = bytes(rng.randrange(256) for _ in range(size - 6))
    bits = mpeg.protected_bits(body, 0, version, layer, kbit, hertz, mode >> 6, mode >> 4 & 3)
    crc = mpeg.crc16_bits(bytes((third, mode)) + body, 16 + bits)
    frame = bytes((0xFF, second, third, mode)) + crc.to_bytes(2, "big") + body
    assert mpeg.read_mpeg(frame * 3)["crc_good"] == 3

    def flipped(bit):
        b = bytearray(frame)
        b[6 + bit // 8] ^= 128 >> bit % 8
        return mpeg.read_mpeg(bytes(b) + frame)["crc_bad"]

    assert flipped(0) == flipped(bits - 1) == 1 and flipped(bits) == 0
    assert layer == 2 or bits == {0xC0: 128, 0x00: 256, 0x50: 160}[mode]


def test_bitwise_checksum():
    data = bytes(range(20))
    assert mpeg.crc16_bits(data, 160) == mpeg.crc16(data)
    for n in range(0, 160, 7):  # a bit at a time
        c = 0xFFFF
        for k in range(n):
            top = c >> 15 ^ data[k // 8] >> (7 - k % 8) & 1
            c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        assert mpeg.crc16_bits(data, n) == c


def test_media_on_odd_rows(spark, odd):
    wide = clashing(odd).withColumn("payload", odd["text"].cast("binary"))
    rows = mpeg.index_mpeg(mpeg.payload_to_mpeg(wide)).collect()
    assert len(rows) == len(ODD) and all(r.score == 7 and bytes(r.payload) == (r.text or "").encode() for r in rows)
    broken = mpeg.index_mpeg(odd.selectExpr("*", "cast(text AS binary) AS media")).collect()
    assert all(r.frames == 0 and r.offsets == [] and r.table_kind is None for r in broken)
    assert mpeg.index_mpeg(mpeg.payload_to_mpeg(wide.limit(0))).collect() == []
    long = mpeg.write_mpeg(bytes(5_000_000))
    assert mpeg.read_mpeg(long)["payload"] == bytes(5_000_000)


def test_media_query_equals_the_contract(spark, docs):
    for r in QUERIES["op3_mpeg_audio"](spark, SF).collect():
        raw = (docs[r.doc_id].text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = mpeg.write_mpeg(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


# repeated passages


def test_repeats_equal_brute_force(spark, docs):
    want = substrings.brute_force([(i, r.text) for i, r in docs.items()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op4_fingerprint_index"](spark, SF).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_repeats_within_and_across(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    other = lambda n: " ".join(word() for _ in range(n))
    line = " ".join(word() for _ in range(22))
    rows = [(9, f"{other(30)} {passage}"), (2, f"{other(10)} {passage} {other(10)}"), (5, passage), (7, "\n".join([line] * 6)), (8, f"{line} {line} {other(3)}"), (10, " ".join(passage.split()[15:50])), (11, "x " * 19), (12, "x " * 19)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(df).collect()}
    assert got == substrings.brute_force(rows)


def test_index_that_outlives_its_session(spark, tmp_path):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage, other = [" ".join(word() for _ in range(50)) for _ in range(3)], lambda: " ".join(word() for _ in range(15))
    rows = [(i, " ".join([other(), rng.choice(passage), other(), *([other()] if i % 2 else [rng.choice(passage)])])) for i in range(24)] + [(24, passage[0]), (25, passage[0]), (26, None)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    got = {}
    for k in range(0, 27, 6):
        index = substrings.FingerprintIndex(spark, str(tmp_path / "index"))  # opened anew for each batch
        for name in (r for level in index.levels for r in level):  # as a new session would find it
            spark.sql(f"DROP TABLE {name}")
        index = substrings.FingerprintIndex(spark, str(tmp_path / "index"))
        assert index.generation == k // 6
        history = frame(rows[:k]) if k else None
        for r in substrings.remove_repeats(frame(rows[k : k + 6]), batches=1, index=index, history=history).collect():
            got[r.doc_id] = (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
    assert got == substrings.brute_force(rows) and sum(v[1] > 0 for v in got.values()) > 15
    assert 1 <= len(index.levels[0]) + len(index.levels[1]) + len(index.levels[2]) < 5  # runs were compacted
    with pytest.raises(ValueError):
        substrings.remove_repeats(frame(rows[:1]), index=substrings.FingerprintIndex(spark, str(tmp_path / "index")))
    wide = substrings.remove_repeats(frame(rows[:1]).selectExpr("*", "1 AS _id", "2 AS key", "3 AS print"))
    assert wide.columns == ["doc_id", "n_words", "n_removed", "kept"] and wide.count() == 1


def test_repeats_on_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(clashing(odd)).collect()}
    assert (None, 0, 0, "") in got and (1, 3, 0, "a b c") in got and (3, 3000, 2999, "q") in got
    assert substrings.remove_repeats(odd.limit(0)).collect() == []


# near duplicates


def shingle_set(text):
    w = re.findall(r"[^ \t-\r]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """Classes by the weighted similarity of all pairs, with weights from plain document counts."""
    texts = [minhash.canonical(t) for _, t in rows]
    parts, table = [], np.zeros(1 << minhash.TABLE_BITS)
    for _, h, counts in minhash.shingles(texts):
        parts += np.split(h, np.cumsum(counts)[:-1])
    for h in parts:
        table[np.unique(np.unique(h) & np.uint32(len(table) - 1))] += 1
    for h in parts:  # a text counts in a slot once for each of its shingles there
        u = np.unique(h) & np.uint32(len(table) - 1)
        slot, n = np.unique(u, return_counts=True)
        table[slot] += n - 1
    weigh = minhash.Idf(table, len(texts))
    counted = [dict(zip(*map(np.ndarray.tolist, np.unique(h, return_counts=True)), strict=True)) for h in parts]
    weighted = [{s: n * w for (s, n), w in zip(c.items(), weigh(np.array(list(c), dtype=np.uint32)).tolist(), strict=True)} for c in counted]
    total = [sum(w.values()) for w in weighted]
    ids = [i for i, _ in rows]
    leader = {i: i for i in ids}

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = (weighted[a], weighted[b]) if len(weighted[a]) < len(weighted[b]) else (weighted[b], weighted[a])
            low = sum(min(w, y[s]) for s, w in x.items() if s in y)
            if low and low >= 0.8 * (total[a] + total[b] - low) and find(ids[a]) != find(ids[b]):
                leader[max(find(ids[a]), find(ids[b]))] = min(find(ids[a]), find(ids[b]))
    return {i: find(i) for i in ids}


def test_classes_equal_brute_force(spark, docs):
    got = {r.doc_id: r.class_id for r in QUERIES["op5_weighted_minhash"](spark, SF).collect()}
    assert got == brute_classes([(i, r.text) for i, r in docs.items()])


def test_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = ["w%d" % rng.randrange(10**6) for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(300)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join("r%d" % rng.randrange(10**6) for _ in range(100))) for i in range(40)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_group_around_the_threshold(spark):
    rng = random.Random(12)
    base = ["w%d" % rng.randrange(10**6) for _ in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(150)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) > 20


def test_prefix_leaves_less_than_the_threshold():
    rng = np.random.default_rng(4)
    weigh = minhash.Idf(np.ones(1 << minhash.TABLE_BITS), 10)
    for n in (1, 2, 5, 10, 33):
        vec = rng.integers(0, 2**32, n, dtype=np.uint32)
        got, total = minhash.prefix(vec.tobytes(), np.zeros(1 << minhash.TABLE_BITS), weigh, 0.8)
        assert n - len(got) < 0.8 * n <= n - len(got) + 1 and abs(total - n * weigh(vec)[0]) < 1e-4


def test_group_that_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1 << 12)
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(10**6) for _ in range(150)]
    rows = []
    for i in range(200):
        w = list(base)[: 150 - rng.randrange(30)]
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_repeated_passages_weigh(spark):
    rng = random.Random(4)
    text = " ".join("w%d" % rng.randrange(10**6) for _ in range(100))
    rows = [(1, text), (2, f"{text} {text}"), (3, f"{text} once more")]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) == {1: 1, 2: 2, 3: 1}  # the same set of shingles, but twice as often


def test_near_duplicates_on_odd_rows(spark, odd):
    got = minhash.near_duplicate_classes(clashing(odd)).collect()
    assert len(got) == len(ODD) and {r.class_id for r in got if r.doc_id == 1} == {1}
    assert minhash.near_duplicate_classes(odd.limit(0)).collect() == []
    kept = minhash.keep_one_of_each(odd).collect()
    assert sum(r.doc_id == 1 for r in kept) == 1 and {2, 3, 4} <= {r.doc_id for r in kept}


def test_sampling_follows_weighted_similarity():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**32, 400, dtype=np.uint32)
    wa, wb = rng.uniform(1, 3, 300), rng.uniform(1, 3, 300)
    a, b = h[:300], h[100:]
    wb[:200] = wa[100:]
    sig = minhash.icws(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([300, 300]), samples=2000)
    true = wa[100:].sum() / (wa.sum() + wb[200:].sum())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 65537])
def test_permutation(n):
    p = permute.permute(np.arange(n), n, 99)
    assert sorted(p.tolist()) == list(range(n))
    assert (permute.permute(p, n, 99, back=True) == np.arange(n)).all()
    assert sharding.row_at(*sharding.locate(n - 1, n, 4, 7), n, 4, 7) == n - 1


def test_shards_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op6_feistel_shards"])
    got = QUERIES["op6_feistel_shards"](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.shuffle_into_shards(clashing(odd), ["doc_id", "text"], shards=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, by.values())) == [2, 2, 3] and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shuffle_into_shards(odd.limit(0), ["doc_id"]).collect() == []


# neighbours


def test_recall_against_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = {(a, c) for a, _, c, _ in neighbours.brute_force([r.vec_id for r in e], [r.embedding for r in e])}
    got = QUERIES["op7_collision_counting"](spark, SF).collect()
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    by = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in e}
    for r in got:
        a, b = by[r.query_id], by[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_recall_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(200, 32))
    x = (centres[rng.integers(200, size=20_000)] + 0.6 * rng.normal(size=(20_000, 32))).astype(np.float32)
    monkeypatch.setattr(neighbours, "BATCH_BYTES", 1 << 15)  # several batches too
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = {(a, c) for a, _, c, _ in neighbours.brute_force(list(range(len(x))), x)}
    got = neighbours.nearest(df).collect()
    assert len(got) == len(want) == 5 * 400 and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.95 * len(want)


def test_repeated_ids_give_unique_ranks(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.9, 0.1]), (50, [1.0, 0.0]), *((i, [1.0, 0.01 * i]) for i in (1, 2, 3) for _ in range(3)), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "7 AS id", "7 AS v", "7 AS dim", "7 AS bound", "7 AS score")
    got = neighbours.nearest(df).orderBy("rank").collect()
    assert [(r.query_id, r["rank"]) for r in got] == [(50, 1), (50, 2), (50, 3), (50, 4)] and [r.vec_id for r in got][-1] == 4 and {r.vec_id for r in got} == {1, 2, 3, 4}


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (150, [1.0, 0.0, 0.0]), (7, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 6)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# quality and languages


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op8_boosted_quality"](spark, sf).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    trees = gbdt.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20, depth=4)

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])


@pytest.mark.parametrize("n", [1, 2, 3, 399, 400, 401, 5000])
def test_statistics_count_pairs_the_same_at_every_length(n):
    rng = random.Random(n)
    words = [rng.choice(["aa", "b", "Cc.", "ééé", "12"]) for _ in range(n)]
    got = dict(zip(quality.STATS, quality.statistics(" ".join(words)), strict=True))
    pairs = {}
    for p in zip(words, words[1:], strict=False):
        pairs[p] = pairs.get(p, 0) + 1
    assert got["top_pair"] == max(pairs.values(), default=1) / n and got["unique_words"] == len(set(words)) / n and got["top_word"] == max(words.count(w) for w in set(words)) / n
    assert got["log_words"] == pytest.approx(np.log1p(n)) and got["mean_word"] == pytest.approx(np.mean([len(w.encode()) for w in words]))


def test_quality_query_equals_brute_force(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    stats = {i: np.array(quality.statistics(r.text), dtype=np.float32).astype(np.float64) for i, r in docs.items()}
    rows = QUERIES["op8_boosted_quality"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:  # equal statistics, equal scores; the cut decides
        assert r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.7)
    taught = [i for i in labels if i in docs and not held[i]]
    order = sorted(rows, key=lambda r: r.doc_id)
    model = quality.fit_quality(spark.createDataFrame([(i, stats[i].tolist()) for i in docs], "doc_id long, stats array<float>"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = model.score(np.stack([stats[r.doc_id] for r in order]))
    assert len(taught) > 20 and np.allclose([r.score for r in order], want)


def test_quality_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.quality_scores(clashing(odd), labels).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id in (1,)}) == 1
    assert quality.quality_scores(odd.limit(0), labels).collect() == []
    none = quality.quality_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in QUERIES["op9_crf_language"](spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    counts, e, trans = np.array([1, 4, 2]), rng.uniform(0.1, 1, (7, 3)), rng.uniform(0.1, 2, (3, 3))
    got, at = langid.forward_backward(e.copy(), trans, counts), 0
    for n in counts:
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=int(n)):
            p = np.prod([e[at + t, y] for t, y in enumerate(path)]) * np.prod([trans[a, b] for a, b in zip(path, path[1:], strict=False)])
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_long_texts_pass_messages_whole(monkeypatch):
    rng = np.random.default_rng(5)
    counts = np.array([1, 700, 64, 65, 3, 128])
    e, trans = rng.uniform(1e-6, 1, (int(counts.sum()), 4)), rng.uniform(0.01, 2, (4, 4))
    got = langid.forward_backward(e.copy(), trans, counts)
    for size in (1, 7, 10**6):
        monkeypatch.setattr(langid, "PIECE", size)
        assert np.allclose(langid.forward_backward(e.copy(), trans, counts), got)


def test_words_of_mixed_text(docs):
    samples = [(r.text, r.lang) for r in docs.values() if r.lang]
    model = langid.train([(langid.word_runs(t), g) for t, g in samples])
    pick = {lang: next(t for t, g in samples if g == lang and len(t) > 400).split()[5:25] for lang in ("en", "de")}
    found = langid.label_words(" ".join(pick["en"] + pick["de"]), model)
    half = len(found) // 2
    assert sum(g == "en" for _, g, _ in found[: half - 2]) > 0.8 * (half - 2) and sum(g == "de" for _, g, _ in found[half + 2 :]) > 0.7 * (half - 2)


def test_long_words_count_whole():
    rng = random.Random(6)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    one, two = "山川日本人大", "ไทยกขคง"
    model = langid.train([([run(letters, 6).encode() for _ in range(80)], lang) for letters, lang in ((one, "a"), (two, "b")) for _ in range(20)])
    assert [g for g, *_ in model.documents([run(one, 64) + "。" + run(two, 3000), run(two, 64) + run(one, 3000), run(one, 40)])] == ["b", "a", "a"]
    flat, tri, n = langid.features(["x" * 70 + "end", "", "x" * 70, "end", "日本"], {"日本": 3})
    assert n.tolist()[1] == 0 and n.sum() == len(flat) and tri.sum() == 73 + 70 + 3 + 2
    parts = np.split(flat, np.cumsum(n)[:-1])
    assert set(parts[0]) - set(parts[2]) and set(parts[3]) - set(parts[0])  # "end" starts one word and ends the other
    alone = langid.features(["日本"], {"日本": 3})[0]
    assert alone.tolist() == parts[4].tolist() and len(alone) > len(langid.features(["日本"], {})[0])


def test_more_languages_than_the_sample_has_rows(spark):
    rows = [(i, f"wort{i} zeile{i} satz{i}", f"l{i:03}") for i in range(400)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=50)
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(400)) > 200


def test_known_share_tells_unlearned_languages(docs):
    model = langid.train([(langid.word_runs(r.text), r.lang) for r in docs.values() if r.lang])
    rng = random.Random(2)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(60))
    found = model.documents([docs[min(docs)].text, noise, "山川日本人大 " * 30, "12 34", None])
    assert found[0][2] > 0.9 and found[1][2] < 0.5 and found[2][2] < 0.5 and found[3][2] == found[4][2] == 0


def test_long_texts_are_cut_into_spread_runs():
    words = langid.word_runs(" ".join(f"w{chr(97 + i % 26)}x{'abcdefghij'[i // 1000 % 10]}" for i in range(10000)))
    assert len(words) == langid.RUNS * langid.RUN_WORDS and {w[-1:] for w in words} > {b"a", b"j"}


def test_languages_on_odd_rows(spark, odd):
    model = langid.fit_languages(odd)
    rows = langid.detect_languages(clashing(odd), model).collect()
    assert len(rows) == len(ODD)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    again = langid.detect_languages(clashing(odd), model, out=("g", "s", "k")).collect()
    assert all(r.score == 7 and r.lang_pred == 7 for r in again) and sorted((r.g, r.s) for r in again) == sorted((r.lang_pred, r.score) for r in rows)
    nothing = langid.fit_languages(odd.limit(0))
    assert {r.lang_pred for r in langid.detect_languages(odd, nothing).collect()} == {"und"}


# mixing


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    goal = mixing.targets([100, 1000, 10])
    assert goal[0] == 300 and goal[2] == 30 and abs(sum(goal) - 1110) < 1e-6


def test_mix_meets_its_targets(spark, docs):
    rows = QUERIES["op10_block_mix"](spark, SF).collect()
    taken, source = {}, {}
    for r in rows:
        n = len(re.findall(r"[^ \t-\r]+", docs[r.doc_id].text or ""))
        assert r["size"] == n and 0 <= r.taken <= 3 * n
        s = docs[r.doc_id].source
        taken[s], source[s] = taken.get(s, 0) + r.taken, (r.source_size, r.target)
    order = sorted(source)
    assert np.allclose([source[s][1] for s in order], mixing.targets([source[s][0] for s in order]))
    assert all(abs(taken[s] - source[s][1]) <= 1.5 * mixing.BLOCK for s in order)  # half a block by rounding, the rest by the short last one
    again = {r.doc_id: r.taken for r in QUERIES["op10_block_mix"](spark, SF).collect()}
    assert all(again[r.doc_id] == r.taken for r in rows)


def test_mix_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.source, len(re.findall(r"[^ \t-\r]+", r.text or ""))) for r in docs.values()]
    taken, places = mixing.brute_force(rows)
    got = {r.doc_id: r.taken for r in QUERIES["op10_block_mix"](spark, SF).collect()}
    assert got == {rows[i][0]: n for i, n in taken.items()}
    blocks = mixing.mix_blocks(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {(r.shard, r.slot): (r.source, r.block) for r in blocks} == places
    assert sum(r.n_words for r in blocks) == sum(taken.values()) and all(len(r.text.split()) == r.n_words <= mixing.BLOCK for r in blocks)
    other, _ = mixing.brute_force(rows, seed=1)
    assert other != taken


def test_draws_beyond_a_billion_slots():
    sizes = [10**13, 10**12, 5]
    goal = mixing.targets(sizes)
    for rank, (size, t) in enumerate(zip(sizes, goal, strict=True)):
        blocks, slots = mixing.slot_count(t, size)
        draw = mixing.shard_draw(slots, rank)
        assert draw.sum() == slots and (draw >= 0).all() and abs(slots * size / blocks - t) <= max(mixing.BLOCK, 1e-9 * t)
    got = mixing.drawn_pieces(np.array([10**12]), np.array([1000]), np.array([0]), {0: (10**11, 2 * 10**11, np.array([10**11, 2 * 10**11]), np.array([0, 0]))}, [10**11, 10**11])
    assert got["words"].sum() == 2000


def test_many_sources(spark):
    rows = [(i, f"s{i % 3000:04}", 1 + i % 7) for i in range(6000)]
    got = {r.doc_id: r.taken for r in mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()}
    assert got == {rows[i][0]: n for i, n in mixing.brute_force(rows)[0].items()}


def test_mix_of_repeated_rows_and_clashing_columns(spark, odd):
    names = ["pieces", "row", "_n", "_g", "_pid", "_off", "rank", "base", "cum", "at", "size"]
    from pyspark.sql import functions as F

    wide = clashing(odd).withColumns({c: F.lit(9) for c in names})
    rows = mixing.mix_texts(wide).collect()
    assert rows and all(r.pieces == r.rank == 9 and r.taken == 7 for r in rows)
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in rows if r.doc_id is not None) == sorted((r.doc_id is None, r.doc_id, r.text) for r in mixing.mix_texts(odd).collect() if r.doc_id is not None)
    many = spark.createDataFrame([(1, "a b c d", "en", "s", 7)] * 500, KIND)
    assert mixing.mix_texts(many).count() == 500
    assert mixing.mix_blocks(odd.limit(0)).collect() == []


def test_mixed_texts(spark, odd):
    rows = mixing.mix_texts(odd).collect()
    assert rows and all(r.text for r in rows)
    words = sum(len(r.text.split()) for r in rows)
    assert abs(words - sum(len((t or "").split()) for _, t, *_ in ODD)) < 0.05 * 3010
    assert mixing.mix_texts(odd.limit(0)).collect() == []


# hashes of word windows


def test_window_hashes_do_not_depend_on_the_place():
    rng = random.Random(3)
    long = b" ".join(rng.choice([b"a", b"bcd", b"efghij", b"k" * 700]) for _ in range(30_000))
    w = words.Words([b"x y", long, b"z"])
    assert len(w.blob) > 4 << 20
    first, hashes = w.windows(5)
    near = [i for i in range(len(first)) if (w.starts[first[i]] >> 19) != (w.stops[first[i] + 4] >> 19)]  # over the edges of 512 KB
    for i in [0, len(first) - 1, *near, *rng.sample(range(len(first)), 200)]:
        part = w.bytes_of(first[i], first[i] + 4)
        value = sum((b + 1) * pow(words._BASE, k, 1 << 64) for k, b in enumerate(part)) % (1 << 64)
        assert hashes[i] == words.mix64(np.array([value], dtype=np.uint64))[0] == words.Words([part]).windows(5)[1][0]
    assert len(near) > 4


def test_workers_keep_little_of_long_texts():
    gc.collect()
    tracemalloc.start()
    try:
        words.Words([b"word " * 2_400_000])
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] < 16 << 20
        tracemalloc.reset_peak()
        texts = [b"some words of one text %d" % k * 20 for k in range(4096)]
        assert sum(len(counts) for _, _, counts in minhash.shingles(texts)) == 4096
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
