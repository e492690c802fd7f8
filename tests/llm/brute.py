"""Plain Python versions of the text operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Long, empty, null, repeated, tied and odd texts.
ODD = [
    (1, "a b c d e f g h", "s"),
    (1, "a b c d e f g h", "s"),
    (2, "", "s"),
    (3, None, None),
    (None, "A b C d e f g h", "t"),
    (4, "A B C D E F G H", "t"),
    (5, " \n\t\r\x0b\x0c ", "t"),
    (6, "é漢🙂\x00\xa0x " * 40, None),
    (7, "word " * 3000, "s"),
    (7, "other text of the same id", "s"),
    (8, "x" * 20000, "s"),
    (9, "a\nb\na\n\nb\n", "u"),
]


def frame(spark, rows, extra: bool = True):
    """doc_id, text, source and columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    if extra:
        for name in ("size", "score", "n", "key", "doc", "hub", "th", "bucket", "piece", "p", "k", "component"):
            df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text: str | None) -> set:
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard_components(rows, percent: int = 75) -> list[tuple]:
    sets = [(doc, shingle_set(text)) for doc, text, *_ in rows]
    parent: dict = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for i, (doc, s) in enumerate(sets):
        for gram in s if doc is not None else ():
            holders[gram].append(i)
    for a, b in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        (x, s), (y, t) = sets[a], sets[b]
        overlap = len(s & t)
        if 100 * overlap >= percent * (len(s) + len(t) - overlap):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    return [(doc, len(s), find(doc) if s and doc is not None else doc) for doc, s in sets]


def text_counts(text: str | None) -> tuple:
    w = words(text)
    triples = defaultdict(list)
    for i in range(len(w) - 2):
        triples[tuple(w[i : i + 3])].append(i)
    covered = {i + j for at in triples.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def without_repeats(rows, window: int) -> list[tuple]:
    first: dict = {}
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - window + 1 if doc is not None else 0):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if doc is not None else 0):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text: str) -> list[tuple]:
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    spans = [(0, *m.span()) for m in EMAIL.finditer(text)]
    spans += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    spans += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return spans + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
