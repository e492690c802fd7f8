"""Personal data by weak supervision: labelers vote on candidate spans, a fitted model decides.

Candidates are the base spans (email, ip, card, phone; always kept) and spans of further kinds.
Labelers of three sorts (regular expressions on the shape, gazetteers, context words) vote yes, no or
nothing on each candidate. Votes are counted per pattern over all rows: there are at most
``len(KINDS) * 3 ** LABELERS`` patterns, whatever the size of the table. On those counts
expectation-maximisation estimates how reliable each labeler is per kind, and its posteriors train
a logistic span classifier over votes. Spans of further kinds are added from ``ACCEPT`` on, unless they
overlap a base span.

One pass reads the texts and stores the candidates of each document. Null texts count as
empty, repeated rows are searched one by one, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sparkrecon.llm.words import column
from sparkrecon.plans.lineage import scratch_path

# fixed values: the base kinds, in the order in which spans are listed
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn", "local_phone")
LABELERS = 5
ACCEPT = 0.9
ROUNDS = 50

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
FURTHER = {
    "secret": re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": re.compile(r"\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}(?![0-9])"),
}

# gazetteers and context words of the labelers
TOP_DOMAINS = frozenset("com org net edu gov info biz io de fr es uk eu us ca au ch at it nl be pl jp cn in br".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "4", "5", "6", "8", "9")
IBAN_COUNTRIES = frozenset("DE FR ES GB IT NL BE AT CH PL PT SE DK FI IE LU CZ HU GR NO".split())
NEAR = {
    "email": "mail contact write",
    "ip": "ip host server address",
    "card": "card visa payment credit",
    "phone": "phone tel call fax mobile",
    "secret": "token key secret password api auth",
    "iban": "iban account bank",
    "ssn": "ssn social security",
    "local_phone": "phone tel call fax mobile",
}
NEAR_WORDS = {kind: tuple(words.split()) for kind, words in NEAR.items()}
FAR_WORDS = ("version", "chapter", "figure", "isbn", "sha", "commit", "checksum", "md5")
REACH = 40


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the @ signs; linear in the text."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base spans, by kind and start."""
    spans = [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text) is None:
        return spans
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind number, start, end, vote pattern) of base spans and of further ones beside them."""
    spans = base_spans(text)
    if DIGIT.search(text) is not None:
        taken = sorted((a, b) for _, a, b in spans)
        for k, kind in enumerate(KINDS[len(BASE_KINDS) :], len(BASE_KINDS)):
            found = [(k, m.start(), m.end()) for m in FURTHER[kind].finditer(text)]
            spans += _apart(found, taken) if found and taken else found
    return [(k, a, b, votes(KINDS[k], text, a, b)) for k, a, b in spans]


def _apart(found: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of ``taken``; both sorted by start."""
    out, i, reach = [], 0, 0
    for k, a, b in found:
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            out.append((k, a, b))
    return out


def _vote(good: bool | None) -> int:
    return 1 if good is None else 2 if good else 0


def votes(kind: str, text: str, start: int, end: int) -> int:
    """The votes on a span as one number, three values (no, none, yes) per labeler."""
    span = text[start:end]
    before = text[max(0, start - REACH) : start].lower()
    digits = _digits(span)
    shape = gazetteer = None
    if kind == "email":
        domain = span.rpartition("@")[2]
        shape = ".." not in span and not span.startswith(".") and 2 <= len(domain.rpartition(".")[2]) <= 24
        gazetteer = domain.rpartition(".")[2].lower() in TOP_DOMAINS
    elif kind == "ip":
        parts = span.split(".")
        shape = all(p == "0" or not p.startswith("0") for p in parts)
        gazetteer = parts[0] not in ("0", "10", "127", "255")
    elif kind == "card":
        shape = len(set(digits)) > 2
        gazetteer = digits[0] in "23456"
    elif kind == "phone":
        shape = len(digits) >= 10
        gazetteer = digits.startswith(CALLING_CODES)
    elif kind == "secret":
        shape = len(set(span)) >= 8
        gazetteer = True if len(span) in (32, 40, 64) else None
    elif kind == "iban":
        shape = _mod97(span) == 1
        gazetteer = span[:2] in IBAN_COUNTRIES
    elif kind == "ssn":
        shape = span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
    else:
        shape = span[1] not in "01" and span[6] not in "01"
    context = True if any(w in before for w in NEAR_WORDS[kind]) else None
    contrary = False if any(w in before for w in FAR_WORDS) else None
    edge = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    code = 0
    for value in (shape, gazetteer, context, contrary, edge):
        code = 3 * code + _vote(value)
    return code


def _mod97(iban: str) -> int:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97


def _unpack(codes: np.ndarray) -> np.ndarray:
    """Votes per pattern (rows) and labeler (columns)."""
    return np.stack([codes // 3**j % 3 for j in range(LABELERS - 1, -1, -1)], axis=1)


def reliabilities(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability that a span with a vote pattern is real, by expectation-maximisation.

    Each labeler has a table of vote probabilities for real and for false spans, with one
    pseudo-count that leans to agreement; the start is the share of yes votes.
    """
    v = _unpack(codes)
    yes, no = (v == 2).sum(axis=1), (v == 0).sum(axis=1)
    real = (yes + 1.0) / (yes + no + 2.0)
    lean = np.array([[0.5, 1.0, 0.2], [0.2, 1.0, 0.5]])
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - real), counts * real])
        share = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        logs = np.log(share)[:, None] + np.zeros((2, len(codes)))
        for j in range(LABELERS):
            table = np.stack([(weight * (v[:, j] == value)).sum(axis=1) for value in range(3)], axis=1) + lean
            table /= table.sum(axis=1, keepdims=True)
            logs += np.log(table[:, v[:, j]])
        real = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return real


def fit(pattern_counts: list[tuple[int, int, int]]) -> dict[int, set[int]]:
    """Accepted vote patterns per kind number, from (kind number, pattern, count) rows."""
    rows = sorted(pattern_counts)
    if not rows:
        return {}
    kind, code, n = (np.array(c) for c in zip(*rows))
    target = np.zeros(len(rows))
    for k in np.unique(kind):
        own = kind == k
        target[own] = reliabilities(code[own], n[own].astype(float))
    v = _unpack(code)
    x = np.column_stack([*[kind == k for k in range(len(KINDS))], *[v == value for value in (0, 2)]]).astype(float)
    x = np.column_stack([x, *[x[:, [k]] * (v - 1) for k in range(len(KINDS))]])
    # every pattern of a kind weighs by the logarithm of its count, so rare patterns are learnt too
    weight = np.log1p(n)
    w = np.zeros(x.shape[1])
    for _ in range(2_000):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= 2.0 * ((x.T @ (weight * (p - target))) / weight.sum() + 1e-3 * w)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
    found: dict[int, set[int]] = {}
    for k, c, q in zip(kind.tolist(), code.tolist(), p.tolist()):
        # a span that no labeler of context or gazetteer supports is never added
        if q >= ACCEPT and (_unpack(np.array([c]))[0, 1:3] == 2).any():
            found.setdefault(k, set()).add(c)
    return found


def candidate_table(docs: DataFrame) -> DataFrame:
    """doc_id and arrays of kind number, start, end and vote pattern of its candidates."""

    def run(batches):
        names = ["k", "a", "b", "v"]
        for batch in batches:
            found = [candidates(t) if t else [] for t in column(batch, "text").to_pylist()]
            lists = [pa.array([[c[i] for c in doc] for doc in found], pa.list_(pa.int32())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *lists], ["doc_id", *names])

    ints = ", ".join(f"{n} array<int>" for n in ("k", "a", "b", "v"))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {ints}")


def accepted_patterns(table: DataFrame) -> dict[int, set[int]]:
    """Count vote patterns over the whole candidate table and fit the model on the counts."""
    pairs = table.select(F.explode(F.arrays_zip("k", "v")).alias("p")).select("p.k", "p.v")
    counts = pairs.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit([(r["k"], r["v"], r["n"]) for r in counts])


def _kept(accepted: dict[int, set[int]]) -> F.Column:
    """Candidates of the row that are base spans or accepted, as structs k, a, b."""
    codes = [F.lit(k * 3**LABELERS + v) for k, vs in sorted(accepted.items()) if k >= len(BASE_KINDS) for v in sorted(vs)]
    known = F.array(*codes) if codes else F.array().cast("array<int>")
    return F.filter(
        F.arrays_zip("k", "a", "b", "v"),
        lambda c: (c["k"] < len(BASE_KINDS)) | F.array_contains(known, c["k"] * 3**LABELERS + c["v"]),
    )


def _listed(spans: F.Column) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["k"] + 1), c["a"], c["b"])), ","
    )


def _of_kind(k: int):
    # one parameter only: Spark passes an element's position as the second
    return lambda c: c["k"] == k


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans, and all spans as text."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pii")
    candidate_table(docs).write.parquet(path)
    table = spark.read.parquet(path)
    spans = table.select("doc_id", _kept(accepted_patterns(table)).alias("s"))
    base = F.filter("s", lambda c: c["k"] < len(BASE_KINDS))
    return spans.select(
        "doc_id",
        *[
            F.size(F.filter("s", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)
        ],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets.

    A null text stays null; a numeric column ``n_chars`` is set to the new length, one of another type stays. Columns
    of any other name and type pass unchanged, texts of any length are redacted whole, an empty table stays empty.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pii")
    candidate_table(docs.select(F.monotonically_increasing_id().alias("doc_id"), text)).write.parquet(path)
    accepted = accepted_patterns(spark.read.parquet(path))
    schema = docs.schema
    counted = any(f.name == "n_chars" and isinstance(f.dataType, NumericType) for f in schema.fields)

    def run(batches):
        for batch in batches:
            texts = column(batch, text).to_pylist()
            out = [t if t is None else redacted(t, accepted) for t in texts]
            arrays = {text: pa.array(out, column(batch, text).type)}
            if counted:
                lengths = pa.array([None if t is None else len(t) for t in out], pa.int64())
                arrays["n_chars"] = lengths.cast(column(batch, "n_chars").type, safe=False)
            yield pa.RecordBatch.from_arrays(
                [arrays.get(f.name, column(batch, f.name)) for f in schema.fields], [f.name for f in schema.fields]
            )

    return docs.mapInArrow(run, schema)


def redacted(text: str, accepted: dict[int, set[int]]) -> str:
    """Overlapping spans of two kinds become one gap, named after the first."""
    spans = sorted((a, b, k) for k, a, b, v in candidates(text) if k < len(BASE_KINDS) or v in accepted.get(k, ()))
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])
