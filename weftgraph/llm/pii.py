"""Personal data: base patterns, high-recall candidates and boosted trees, all in SQL expressions.

Four base patterns always count. Further generators propose spans that the base patterns
miss (written-out addresses, numbers without a country code, numbers in groups, keys and passwords); boosted
trees score each one from its form and the words before it, and those above the threshold of their
kind are added. The trees are fitted on the driver to labelled phrases that this module makes from one set of
templates, and the thresholds are calibrated on phrases of another set (their numbers are fixed). The trees run as CASE expressions.

Every pattern is a linear-time form of the one documented beside it: possessive runs, and a
look-behind that starts a match only where a run starts or where the last match ended. Lists of matches are
built by scans over pieces of about the square root of their number, so that no text makes them quadratic.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import gbdt

KINDS = ("email", "ip", "card", "phone", "id", "secret")
#: kind -> Java pattern equal to the base definition (see op2_pii_boosting).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){13}[0-9])[0-9](?:(?![ -](?![0-9]))[0-9 -])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the pattern.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: generator -> (kind, Java pattern); bounded repeats, so that no text makes them slow.
GENERATORS = {
    "spelled_email": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}+){1,4}"),
    "national_phone": ("phone", r"(?<![A-Za-z0-9+.-])(?<![0-9+][ (])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"),
    "double_zero_phone": ("phone", r"(?<![A-Za-z0-9+.-])00[1-9][0-9 ]{8,18}[0-9](?![0-9A-Za-z])"),
    "grouped_id": ("id", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"),
    "iban": ("id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "short_card": ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12}(?![0-9]|[ -][0-9])"),
    "long_token": ("secret", r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,199}[0-9])(?=[0-9_+/=-]{0,199}[A-Za-z])[A-Za-z0-9_+/=-]{20,200}+(?![A-Za-z0-9_+/=-])"),
    "named_secret": ("secret", r"(?<=(?i:password|passwd|pwd|secret|token|key)[\"']?[ ]?[:=][ ]?[\"']?)(?<![A-Za-z0-9_+/=!@#$%^&*.-])[A-Za-z0-9_+/=!@#$%^&*.-]{6,200}+(?![A-Za-z0-9_+/=!@#$%^&*-])"),
}
#: generator -> what every text with a match has, as a cheap SQL test of `{t}`; all but these need a digit.
BARE = ("spelled_email", "named_secret")
CHEAP = {
    "spelled_email": "(contains({t}, '(at)') OR contains({t}, '[at]') OR contains({t}, '(AT)') OR contains({t}, '[AT]'))",
    "national_phone": "rlike({t}, r'[0-9]{{3}}[ ).-]{{1,2}}[0-9]{{3}}[ .-][0-9]{{4}}')",
    "double_zero_phone": "contains({t}, '00')",
    "grouped_id": "rlike({t}, r'[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')",
    "iban": "rlike({t}, r'[A-Z]{{2}}[0-9]{{2}}')",
    "short_card": "rlike({t}, r'[0-9](?:[ -]?[0-9]){{12}}')",
    "long_token": "rlike({t}, r'(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{{20}}')",
    "named_secret": "((contains({t}, '=') OR contains({t}, ':')) AND rlike({t}, r'(?i:password|passwd|pwd|secret|token|key)[\"\\x27]?[ ]?[:=]'))",
}
CUES = {
    "email": "(?i)mail|contact|write",
    "phone": "(?i)phone|tel|call|mobile|fax",
    "card": "(?i)card|visa|credit|payment|debit",
    "id": "(?i)ssn|social|passport|iban|account|insurance",
    "secret": "(?i)token|secret|passw|pwd|key|auth|bearer|credential",
    "assigned": "[:=][ ]?[\"']?$",
    "other": "(?i)order|version|isbn|serial|invoice|part|sku|ref|build|https?:|www",
}
FEATURES = ["generator", "length", "digits", "letters", "breaks", "luhn", "first", "distinct", "turns", *(f"cue_{k}" for k in CUES)]
#: The threshold of a kind is the least at which its calibration phrases reach this precision.
PRECISION = 0.98
BEFORE = 32


def _length(s: str) -> str:
    return f"cast(char_length({s}) AS int)"


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with a lambda variable for a value that would else be computed at each use."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan_sql(items: str, kind: str, state: str, step: str, end: str) -> str:
    """What a scan over an array gives out: array<kind>.

    step, over the state s and the item x, is a struct (s, out) of the next state and an array; end, over the
    last state s, is one more array.
    """
    none = f"cast(array() AS array<{kind}>)"
    inner = f"aggregate(part, struct(a.s AS s, {none} AS out), (b, x) -> " + _let("s", "b.s", _let("n", step, "struct(n.s AS s, concat(b.out, n.out) AS out)")) + ")"
    outer = _let("p", inner, "struct(p.s AS s, concat(a.out, array(p.out)) AS out)")
    parts = "transform(sequence(0, greatest(0, size(z) - 1) div width), k -> slice(z, k * width + 1, width))"
    whole = f"aggregate({parts}, struct({state} AS s, cast(array() AS array<array<{kind}>>) AS out), (a, part) -> {outer}, a -> concat(flatten(a.out), {_let('s', 'a.s', end)}))"
    return _let("z", items, f"CASE WHEN size(z) = 0 THEN {none} ELSE {_let('width', 'cast(ceil(sqrt(size(z))) AS int)', whole)} END")


def _spans_sql(text: str, pattern: str) -> str:
    """array<struct<start:int,end:int,match:string>> of a pattern's matches, in code points."""
    # the pieces between matches and the matches give every place by adding lengths
    items = f"zip_with(split({text}, {_q(pattern)}, -1), regexp_extract_all({text}, {_q(pattern)}, 0), (gap, m) -> struct(gap, m))"
    found = f"struct(s + {_length('x.gap')} AS start, s + {_length('x.gap')} + {_length('x.m')} AS end, x.m AS match)"
    step = f"CASE WHEN x.m IS NULL THEN struct(s AS s, cast(array() AS array<struct<start:int,end:int,match:string>>) AS out) ELSE struct(s + {_length('x.gap')} + {_length('x.m')} AS s, array({found}) AS out) END"
    return _scan_sql(items, "struct<start:int,end:int,match:string>", "0", step, "cast(array() AS array<struct<start:int,end:int,match:string>>)")


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn_sql(digits: str) -> str:
    """Whether a short digit string passes the Luhn test."""
    return (
        f"(aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN c = '' THEN 0 WHEN i % 2 = 0 THEN int(c) "
        f"WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END), 0, (a, b) -> a + b) % 10 = 0)"
    )


VALID = {
    "email": "true",
    "ip": "forall(split(x.match, '[.]'), p -> char_length(ltrim('0', p)) < 4 AND int(right(concat('000', ltrim('0', p)), 3)) <= 255)",
    "card": f"char_length({_digits('x.match')}) BETWEEN 14 AND 19 AND {_luhn_sql(_digits('x.match'))}",
    "phone": f"char_length({_digits('x.match')}) BETWEEN 10 AND 15",
}


def _kind_rank(kind: str) -> int:
    return KINDS.index(kind)


def base_spans_sql(text: str, digit: str) -> str:
    """array<struct<start,rank,end>> of all base spans, in order of start and kind; digit: whether the text has one."""
    parts = []
    for kind, pattern in BASE.items():
        has = f"contains({text}, '{NEEDS[kind]}')" if NEEDS[kind] else f"{digit} AND rlike({text}, {_q('[0-9](?:[ -]?[0-9]){13}')})"
        if kind == "ip":
            has = f"{digit} AND rlike({text}, {_q('[0-9][.][0-9]++[.][0-9]')})"
        spans = f"transform(filter({_spans_sql(text, pattern)}, x -> {VALID[kind]}), x -> struct(x.start AS start, {_kind_rank(kind)} AS rank, x.end AS end))"
        parts.append(f"CASE WHEN {has} THEN {spans} ELSE cast(array() AS array<struct<start:int,rank:int,end:int>>) END")
    return f"array_sort(concat({', '.join(parts)}))"


def features_of(generator: int, match: str, before: str) -> list[float]:
    """The features of one candidate; features_sql computes the same."""
    digits = re.sub("[^0-9]", "", match)
    d = [int(c) for c in reversed(digits)]
    total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d))
    return [
        float(generator), float(len(match)), float(len(digits)), float(len(re.sub("[^A-Za-z]", "", match))), float(len(re.sub("[A-Za-z0-9]", "", match))), float(total % 10 == 0),
        float(digits[0]) if digits else -1.0, float(len(set(digits))), float(len(re.findall("[0-9][A-Za-z]|[A-Za-z][0-9]", match))), *(float(bool(re.search(p, before))) for p in CUES.values()),
    ]


def features_sql(generator: int, match: str, before: str) -> str:
    """A struct of FEATURES."""
    digits = _digits(match)
    values = [
        f"{generator}D", f"double(char_length({match}))", f"double(char_length({digits}))", f"double(char_length(regexp_replace({match}, '[^A-Za-z]', '')))",
        f"double(char_length(regexp_replace({match}, '[A-Za-z0-9]', '')))", f"double({_luhn_sql(digits)})",
        f"CASE WHEN {digits} = '' THEN -1D ELSE double(left({digits}, 1)) END", f"double(size(filter(array_distinct(split({digits}, '')), c -> c <> '')))",
        f"double(size(regexp_extract_all({match}, '[0-9][A-Za-z]|[A-Za-z][0-9]', 0)))", *(f"double(rlike({before}, {_q(p)}))" for p in CUES.values()),
    ]
    return f"struct({', '.join(f'{v} AS {n}' for v, n in zip(values, FEATURES, strict=True))})"


#: Words around made-up phrases: (filler, names of people, mail hosts, cue by kind, wrong cues) for fitting and for calibrating.
FITTING = (
    ["the thing is", "en la con de", "und der mit", "a b c", "note that", "see", "", "erti"], ["anna", "j.doe", "info7", "max_m"], ["mail1.org", "corp.example"],
    {"email": ["mail: ", "write to "], "phone": ["phone ", "call "], "card": ["credit card ", "visa "], "id": ["ssn ", "iban "], "secret": ["token = \"", "password: ", "api_key=", "secret = '"]},
    ["order ", "version ", "isbn ", "serial ", "invoice ", "part ", ""],
)
CALIBRATING = (
    ["please note", "voir le", "aber das", "x y", "today", "la que", "thorsti"], ["maria", "k-lee", "sales", "b.o.b"], ["post.net", "web9.info"],
    {"email": ["e-mail ", "contact "], "phone": ["tel. ", "mobile: "], "card": ["payment card ", "debit "], "id": ["social security ", "account no "], "secret": ["auth token: ", "pwd=", "client secret = \"", "bearer key="]},
    ["sku ", "build ", "ref ", "order no ", "isbn-13 ", "serial no ", ""],
)


def _phrases(rng: random.Random, n: int, words: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates in made-up contexts: personal ones with fitting cues, others as part and serial numbers, paths and names."""
    fillers, people, hosts, cues, wrongs = words
    names = list(GENERATORS)
    x, y = [], []
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    some = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    for _ in range(n):
        g = rng.randrange(len(names))
        name, kind, good = names[g], GENERATORS[names[g]][0], rng.random() < 0.5
        before = None
        if name == "spelled_email":
            user, (host, top) = rng.choice(people), rng.choice(hosts).split(".")
            s = user + rng.choice([" (at) ", "[at]", " [AT] "]) + host + rng.choice([" (dot) ", ".", "[dot]"]) + top
            if not good:  # a remark in brackets between words that are no host
                s = rng.choice(["look", "we are", "meet me"]).split()[-1] + " (at) " + rng.choice(["noon", "home", "work"]) + "." + rng.choice(["Then", "The", "It"])
        elif name == "national_phone":
            a, b, c = rng.choice("23456789") + num(2), num(3), num(4)
            s = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])
            if not good and rng.random() < 0.5:
                s = "0" + s.lstrip("(").replace(")", "")[1:]
        elif name == "double_zero_phone":
            s = "00" + rng.choice("123456789") + num(rng.randint(9, 12))
        elif name == "grouped_id":
            s = f"{num(3)}-{num(2)}-{num(4)}"
        elif name == "iban":
            s = rng.choice(["DE", "FR", "ES", "GB"]) + num(2) + "".join((" " if good else "") + num(4) for _ in range(4)) + num(2)
        elif name == "long_token":
            if good:
                s = rng.choice([some("0123456789abcdef", rng.choice([32, 40, 64])), some("ABCDEFGHJKMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz0123456789", rng.randint(20, 60)), "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)])
                if rng.random() < 0.4:
                    before = rng.choice(fillers) + " "
            else:
                part = lambda: some("abcdefghilmnoprstu", rng.randint(3, 8))
                s = rng.choice(["-", "_", "/"]).join(part() for _ in range(5)) + rng.choice(["-", "_", "/"]) + num(rng.randint(1, 4))
                if rng.random() < 0.5:
                    before = rng.choice(fillers) + rng.choice([" https://a.b/", " ", " = "])
        elif name == "named_secret":
            if good:
                s = rng.choice([some("abcdefghkmnpqrstuvwxyzABCDEFGH", rng.randint(4, 9)) + num(rng.randint(1, 4)) + rng.choice(["", "!", "#x"]), some("0123456789abcdef", rng.choice([16, 32, 40]))])
            else:
                s, before = some("abcdefghilmnoprstu", rng.randint(6, 12)), rng.choice(fillers) + rng.choice([" the key: ", " token: ", " secret: "])
        else:
            s = num(13)
        bare = rng.random() < 0.15
        if before is None:
            cue = rng.choice(cues[kind])
            before = rng.choice(fillers) + " " + ((rng.choice(["", "no. "]) if bare and name != "named_secret" else cue) if good else rng.choice(wrongs))
            if bare and good and name in ("short_card", "double_zero_phone", "grouped_id", "iban", "national_phone"):
                good = rng.random() < 0.5
        x.append(features_of(g, s, before[-BEFORE:]))
        y.append(good)
    return np.array(x), np.array(y, dtype=float)


@cache
def model(seed: int = 7, n: int = 4000) -> tuple[gbdt.Trees, dict[str, float]]:
    """Fitted trees and the least margin of each kind that holds PRECISION on the calibration phrases."""
    rng = random.Random(seed)
    trees = gbdt.fit(*_phrases(rng, n, FITTING), trees=24, depth=3, rate=0.3, bins=32)
    x, y = _phrases(rng, n, CALIBRATING)
    margin, kinds = trees.margin(x), [GENERATORS[g][0] for g in GENERATORS]
    of = np.array([kinds.index(kinds[int(g)]) for g in x[:, 0]])
    out = {}
    for kind in dict.fromkeys(kinds):
        own = np.flatnonzero(of == kinds.index(kind))
        levels = np.unique(margin[own])[::-1]  # a threshold lies between two scores
        right = [y[own][margin[own] >= v].mean() >= PRECISION for v in levels]
        last = max((i for i, r in enumerate(right) if r), default=None)
        out[kind] = float("inf") if last is None else float((levels[last] + levels[last + 1]) / 2 if last + 1 < len(levels) else levels[last] - 1)
    return trees, out


def _all_spans_sql(text: str, base: str, digit: str) -> str:
    """array<struct<start,rank,end>>: the base spans and the accepted candidates that touch no base span nor a better candidate.

    A scan by start holds the end of the base spans so far and one open candidate. Of two candidates that overlap the better one stays: the
    larger margin, then the longer, then the earlier one.
    """
    trees, least = model()
    parts = []
    fields = ",".join(f"{n}:double" for n in FEATURES)
    for g, (name, (kind, pattern)) in enumerate(GENERATORS.items()):
        before = f"substring({text}, greatest(1, x.start + 1 - {BEFORE}), least(x.start, {BEFORE}))"
        made = f"transform({_spans_sql(text, pattern)}, x -> struct(x.start AS start, {_kind_rank(kind)} AS rank, x.end AS end, {features_sql(g, 'x.match', before)} AS f))"
        may = CHEAP[name].format(t=text) if name in BARE else f"{digit} AND {CHEAP[name].format(t=text)}"
        parts.append(f"CASE WHEN {may} THEN {made} ELSE cast(array() AS array<struct<start:int,rank:int,end:int,f:struct<{fields}>>>) END")
    score = trees.sql_margin([f"y.f.{n}" for n in FEATURES])
    scored = f"transform(concat({', '.join(parts)}), y -> struct(y.start AS start, y.rank AS rank, y.end AS end, true AS extra, {score} AS score))"
    bounds = " ".join(f"WHEN {_kind_rank(k)} THEN z.score >= {v!r}D" for k, v in least.items() if np.isfinite(v))
    accepted = f"filter({scored}, z -> CASE z.rank {bounds} ELSE false END)"
    own = f"transform({base}, x -> struct(x.start AS start, x.rank AS rank, x.end AS end, false AS extra, 0D AS score))"
    plain = lambda v: f"struct({v}.start AS start, {v}.rank AS rank, {v}.end AS end)"
    none = "cast(array() AS array<struct<start:int,rank:int,end:int>>)"
    state = lambda reach, has, v: f"struct({reach} AS reach, {has} AS has, {v} AS p)"
    opened = f"CASE WHEN s.has THEN array({plain('s.p')}) ELSE {none} END"
    better = "struct(x.score, x.end - x.start) > struct(s.p.score, s.p.end - s.p.start)"
    step = (
        f"CASE WHEN NOT x.extra THEN struct({state('greatest(s.reach, x.end)', 'false', 's.p')} AS s, concat(CASE WHEN s.has AND s.p.end <= x.start THEN array({plain('s.p')}) ELSE {none} END, array({plain('x')})) AS out) "
        f"WHEN x.start < s.reach THEN struct(s AS s, {none} AS out) "
        f"WHEN s.has AND s.p.end > x.start THEN struct(CASE WHEN {better} THEN {state('s.reach', 'true', 'x')} ELSE s END AS s, {none} AS out) "
        f"ELSE struct({state('s.reach', 'true', 'x')} AS s, {opened} AS out) END"
    )
    first = state("0", "false", "struct(0 AS start, 0 AS rank, 0 AS end, true AS extra, 0D AS score)")
    scanned = _scan_sql(f"array_sort(concat({own}, more))", "struct<start:int,rank:int,end:int>", first, step, opened)
    return _let("more", accepted, f"CASE WHEN size(more) = 0 THEN {base} ELSE array_sort({scanned}) END")


def pii_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Append base_spans and spans: array<struct<kind,start,end>> in code points, end exclusive.

    Sorted by start, then kind in the order of KINDS. A null or empty text has none. Columns with
    these names are replaced; all others stay.
    """
    df = df.drop("base_spans", "spans")
    row, held, digit, base, every = "_row", "_text", "_digit", "_base", "_all"  # the given columns lie in a struct beside them
    staged = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(row), F.coalesce(F.col(text), F.lit("")).alias(held))
    staged = staged.withColumn(digit, F.rlike(held, F.lit("[0-9]")))
    staged = staged.withColumn(base, F.expr(base_spans_sql(held, digit)))
    staged = staged.withColumn(every, F.expr(_all_spans_sql(held, base, digit)))
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    show = lambda a: F.expr(f"transform({a}, s -> struct({names}[s.rank] AS kind, s.start AS start, s.end AS end))")
    return staged.select(*(F.col(f"{row}.`{c}`") for c in df.columns), show(base).alias("base_spans"), show(every).alias("spans"))


def pii_redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of `text` by its kind in square brackets; overlapping spans merge under the first one's kind.

    Null stays null. All other columns stay, whatever their names.
    """
    found = pii_spans(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text).alias("old")), "old")
    piece = "struct(greatest(s, x.end) AS s, CASE WHEN x.start < s THEN cast(array() AS array<string>) ELSE array(substring(old, s + 1, x.start - s), concat('[', upper(x.kind), ']')) END AS out)"
    # the rest of the text goes on from the end of the last span
    out = f"CASE WHEN old IS NULL OR size(spans) = 0 THEN old ELSE array_join({_scan_sql('spans', 'string', '0', piece, 'array(substring(old, s + 1))')}, '') END"
    return found.select(*(F.expr(out).alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns))


def _joined(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, s -> concat_ws(':', s.kind, string(s.start), string(s.end))), ',')")


def op2_pii_boosting(spark, sf_dir: str) -> DataFrame:
    """Counts of base spans, the digest of their places, all spans and their number, for every document.

    Base: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+; ip [0-9]+(\\.[0-9]+){3}, parts at most 255; card
    [0-9]([ -]?[0-9])+, 14 to 19 digits that pass Luhn; phone \\+[0-9][ ().0-9-]+[0-9], 10 to 15 digits.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pii_spans(docs)
    counts = [F.expr(f"cast(size(filter(base_spans, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
