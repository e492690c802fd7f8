"""License scans with ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z) and rewritten as its words, each between two spaces of its own, so a signature
is a plain regular expression over words. The rules are every form of ``FORMS`` for every family of
``FAMILIES``, the base phrases and some general notices: several hundred expressions, each gated
by a keyword that must stand in the text before its expression runs. A detection is an interval of
words. Sorted by start, longest first, a detection is suppressed when an interval of the same or a
higher priority covers it; the labels of those left are reported together with the base labels.

Null texts count as empty (no words, no label, score 0), repeated rows are scanned one by one, an empty
table gives an empty result, other columns are ignored. Work per text is linear in its words and
detections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base phrases and their labels
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Label, words of the name, keyword. A word in square brackets may be absent, bars divide alternatives,
# an underscore stands for a space inside an alternative. Every alternative holds the whole keyword.
FAMILIES = [
    ("mit", "mit licen[cs]e", "mit"),
    ("mit", "expat licen[cs]e", "expat"),
    ("apache-2", "apache [software] licen[cs]e [version] 2 [0]", "apache"),
    ("apache-1.1", "apache [software] licen[cs]e [version] 1 1", "apache"),
    ("bsd-2-clause", "bsd 2 clause [licen[cs]e]", "bsd"),
    ("bsd-2-clause", "freebsd 2 clause [licen[cs]e]", "freebsd"),
    ("bsd-2-clause", "simplified bsd [licen[cs]e]", "bsd"),
    ("bsd-3-clause", "bsd 3 clause [licen[cs]e]", "bsd"),
    ("bsd-3-clause", "(new|revised|modified) bsd [licen[cs]e]", "bsd"),
    ("gpl-2", "gnu general public licen[cs]e [version] 2 [0]", "general public"),
    ("gpl-3", "gnu general public licen[cs]e [version] 3 [0]", "general public"),
    ("gpl", "gnu general public licen[cs]e", "general public"),
    ("gpl-2", "gpl [version] (2|v2)", "gpl"),
    ("lgpl-2.1", "gnu lesser general public licen[cs]e [version] 2 1", "lesser general"),
    ("lgpl-3", "gnu lesser general public licen[cs]e [version] 3 [0]", "lesser general"),
    ("lgpl", "gnu (lesser|library) general public licen[cs]e", "general public"),
    ("agpl-3", "gnu affero general public licen[cs]e [version] 3 [0]", "affero"),
    ("agpl", "gnu affero general public licen[cs]e", "affero"),
    ("gfdl", "gnu free documentation licen[cs]e", "free documentation"),
    ("mpl-1.1", "mozilla public licen[cs]e [version] 1 1", "mozilla"),
    ("mpl-2", "mozilla public licen[cs]e [version] 2 [0]", "mozilla"),
    ("epl-1", "eclipse public licen[cs]e [version] 1 [0]", "eclipse"),
    ("epl-2", "eclipse public licen[cs]e [version] 2 [0]", "eclipse"),
    ("cddl-1", "common development and distribution licen[cs]e", "common development"),
    ("isc", "isc licen[cs]e", "isc"),
    ("zlib", "zlib [libpng] licen[cs]e", "zlib"),
    ("unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "you want to"),
    ("artistic-2", "artistic licen[cs]e [version] 2 [0]", "artistic"),
    ("bsl-1", "boost software licen[cs]e", "boost"),
    ("postgresql", "postgresql licen[cs]e", "postgresql"),
    ("psf-2", "python software foundation licen[cs]e", "python software"),
    ("ofl-1.1", "(sil|open) [open] font licen[cs]e", "font"),
    ("eupl-1.2", "european union public licen[cs]e", "european union"),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft public"),
    ("openssl", "openssl licen[cs]e", "openssl"),
    ("odbl-1", "open database licen[cs]e", "open database"),
    ("cc0-1", "(cc0|cc) [zero] 1 0 universal", "universal"),
]
CC_STEMS = [("cc by", "cc by"), ("creative commons attribution", "creative commons")]
CC_TERMS = [
    ("cc-by-nc-nd", "(nc|noncommercial) (nd|noderivatives|noderivs)"),
    ("cc-by-nc-sa", "(nc|noncommercial) (sa|sharealike)"),
    ("cc-by-nc", "(nc|noncommercial)"),
    ("cc-by-nd", "(nd|noderivatives|noderivs)"),
    ("cc-by-sa", "(sa|sharealike)"),
    ("cc-by", "[international] licen[cs]e"),
    ("cc-by", "4 [0]"),
]

# words before the name, words after it, priority
FORMS = [
    ("", "", 60),
    ("licen[cs]ed under [the] [terms] [of] [the]", "[terms]", 80),
    ("released under [the] [terms] [of] [the]", "[terms]", 80),
    ("distributed under [the] [terms] [of] [the]", "[terms]", 80),
    ("available under [the] [terms] [of] [the]", "[terms]", 80),
    ("subject to [the] [terms] [of] [the]", "[terms]", 80),
    ("governed by [the] [terms] [of] [the]", "[terms]", 80),
    ("spdx licen[cs]e identifier", "", 90),
]

# label, words, keyword, priority
NOTICES = [
    ("all-rights-reserved", "all rights reserved", "rights reserved", 20),
    ("public-domain", "(dedicated_to|released_into|placed_in) the public domain", "public domain", 60),
    ("proprietary", "proprietary and confidential", "proprietary", 40),
]
BASE_PRIORITY = 70
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PRIORITIES = (90, 80, 70, 60, 40, 20)


def _pattern(words: str) -> str:
    """Expression over a text whose words each stand between two spaces of their own."""
    out = []
    for word in words.replace("(", "(?:").split(" "):
        if word.startswith("["):
            out.append(f"(?: {word[1:-1]} )?")
        else:
            out.append(f" {word.replace('_', '  ')} ")
    return "".join(out)


def rules() -> list[tuple[int, str, str, str, int]]:
    """Number, label, keyword, expression and priority of every rule, in order."""
    families = FAMILIES + [
        (label, f"{stem} {terms}", keyword) for stem, keyword in CC_STEMS for label, terms in CC_TERMS
    ]
    found = [(label, phrase, phrase, BASE_PRIORITY) for phrase, label in BASE]
    for label, name, keyword in families:
        for before, after, priority in FORMS:
            found.append((label, " ".join(filter(None, (before, name, after))), keyword, priority))
    found += NOTICES
    return [
        (i, label, f" {keyword.replace(' ', '  ')} ", _pattern(words), priority)
        for i, (label, words, keyword, priority) in enumerate(found)
    ]


def gate_stems() -> list[str]:
    """A text without any of these has no match: each rule needs a license word or its keyword."""
    stems = {
        " licen" if any(part.startswith("licen") for part in pattern.split(" ")) else keyword
        for keyword, pattern in ((r[2], r[3].replace("(?: licen[cs]e )?", "")) for r in rules())
    }
    return sorted(stems)


def spaced_words(text: Column) -> Column:
    """Lower-cased words of a text, each between two spaces of its own; empty without words."""
    lower = F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    joined = F.trim(F.regexp_replace(lower, NO_WORD, "  "))
    return F.when(joined == "", "").otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def places(words: Column, pattern: Column) -> Column:
    """Numbers of the words at which the matches of a pattern start."""
    marked = F.split(F.regexp_replace(words, pattern, F.lit("\u0001$0")), " ")
    at = F.transform(marked, lambda w, i: F.when(w == "\u0001", (i / 2).cast("int")))
    return F.filter(at, lambda i: i.isNotNull())


def detections(words: Column) -> Column:
    """Array of (start, back, rank, rule, label, priority, end): all matches of all rules."""
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"),
                F.lit(label).alias("label"),
                F.lit(keyword).alias("keyword"),
                F.lit(pattern).alias("pattern"),
                F.lit(priority).alias("priority"),
            )
            for i, label, keyword, pattern, priority in rules()
        ]
    )
    gated = F.filter(table, lambda r: F.contains(words, r["keyword"]))

    def of_rule(r: Column) -> Column:
        found = F.regexp_extract_all(words, r["pattern"], F.lit(0))
        return F.zip_with(
            places(words, r["pattern"]),
            found,
            lambda start, match: F.struct(
                start.alias("start"),
                (-(start + _n_words(match))).alias("back"),
                (-r["priority"]).alias("rank"),
                r["rule"].alias("rule"),
                r["label"].alias("label"),
            ),
        )

    return F.array_sort(F.flatten(F.transform(gated, of_rule)))


def _n_words(words: Column) -> Column:
    """Every word has two spaces."""
    return ((F.length(words) - F.length(F.replace(words, F.lit(" ")))) / 2).cast("int")


def surviving(found: Column) -> Column:
    """Struct of the labels and the highest priority of detections that no other suppresses.

    One sweep in order of start: per priority, the furthest end seen so far; a detection goes
    when its end lies within that of its own or a higher priority.
    """
    empty = F.struct(
        F.array(*[F.lit(0)] * len(PRIORITIES)).alias("ends"),
        F.array().cast("array<string>").alias("labels"),
        F.lit(0).alias("best"),
    )
    level = F.array(*[F.lit(-p) for p in PRIORITIES])

    def step(state: Column, d: Column) -> Column:
        own = F.array_position(level, d["rank"]).cast("int")
        covered = F.exists(F.slice(state["ends"], F.lit(1), own), lambda end: end >= -d["back"])
        ends = F.transform(
            state["ends"], lambda end, i: F.when(i + 1 == own, F.greatest(end, -d["back"])).otherwise(end)
        )
        return F.when(covered, state).otherwise(
            F.struct(
                ends.alias("ends"),
                F.array_union(state["labels"], F.array(d["label"])).alias("labels"),
                F.greatest(state["best"], -d["rank"]).alias("best"),
            )
        )

    return F.aggregate(found, empty, step)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and labels, all labels, and a score per document.

    The score is the highest priority left, as a share of 100.
    """
    words = docs.select("doc_id", spaced_words(F.col("text")).alias("w"))
    gate = F.lit(False)
    for stem in gate_stems():
        gate = gate | F.contains("w", F.lit(stem))
    none = F.array().cast("array<int>")
    based = words.select(
        "doc_id",
        "w",
        _n_words(F.col("w")).cast("long").alias("n_words"),
        gate.alias("gated"),
        *[
            F.when(F.contains("w", F.lit(_pattern(phrase))), places(F.col("w"), F.lit(_pattern(phrase))))
            .otherwise(none)
            .alias(f"p{i}")
            for i, (phrase, _) in enumerate(BASE)
        ],
    )
    every = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    base = F.array_compact(
        F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)])
    )
    kept = F.when(F.col("gated"), surviving(detections(F.col("w"))))
    labelled = based.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        base.alias("base"),
        kept.alias("kept"),
    )
    none_kept = F.array().cast("array<string>")
    return labelled.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union("base", F.coalesce(F.col("kept.labels"), none_kept))), ","
        ).alias("labels"),
        F.coalesce(F.col("kept.best") / 100, F.lit(0.0)).alias("score"),
    )
