"""Text expressions: lines, fences, tags, rendering."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a line besides the line feed.
ODD_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
OTHER_BREAKS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# An opening and a closing code fence with the line end next to it.
FENCE_OPEN = r"(?m)^```(?:rust)?\s*\n?"
FENCE_CLOSE = r"(?m)\n?```\s*$"

# Keyword rules in order (tag, keywords, present or absent), and the tag that
# fills up a short list.
SOURCE_RULES = [
    ("case_insensitive_compare", ["LSAME"], True),
    ("implicit_typing", ["IMPLICIT"], False),
    ("goto", ["GOTO", "GO TO"], True),
    ("error_handler", ["XERBLA"], True),
    ("external_procedure", ["EXTERNAL"], True),
]
GENERIC_TAG = "numeric_semantics"
MAX_TAGS = 3

STEP = 64
# A pair of parentheses with at most DEPTH - 1 further ones inside each other.
DEPTH = 5
PAIR = r"\([^()]*+\)"
for _ in range(DEPTH - 1):
    PAIR = rf"\((?:[^()]++|{PAIR})*+\)"



def strip_ws(c: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def has_odd_break(text: Column) -> Column:
    """Whether something else than a line feed ends a line."""
    return reduce(lambda a, b: a | b, [text.contains(c) for c in ODD_BREAKS])


def _uniform(text: Column) -> Column:
    """Line feeds as the only line ends. Most texts have no others and skip the pattern."""
    return F.when(has_odd_break(text), F.regexp_replace(text, OTHER_BREAKS, "\n")).otherwise(text)


def _chomped(text: Column) -> Column:
    ends = F.endswith(text, F.lit("\n"))
    return F.when(ends, F.left(text, F.char_length(text) - 1)).otherwise(text)


def plain_text(text: Column) -> Column:
    """Text with line feeds as its only line ends and none after the last line."""
    return bound(_uniform(text), _chomped)


def lines_of(text: Column) -> Column:
    """Array of lines; a final line break does not start another line."""
    none = F.array().cast("array<string>")
    return bound(_uniform(text), lambda t: F.when(t == "", none).otherwise(F.split(_chomped(t), "\n")))


def split_outside(text: Column, mark: str = ",") -> Column:
    """Parts of ``text`` between the ``mark`` characters that stand outside all parentheses.

    A text that closes more than it opens, or opens more, is not cut while the count of parentheses is off zero. Nesting may
    be of any depth: up to ``DEPTH`` pairs a pattern finds the parts, which Spark compiles; beyond, or with a stray closing
    one, every part between two marks is closed or carried on by its own count of parentheses.
    """

    def extra(x: Column) -> Column:
        return F.length(F.replace(x, F.lit(")"), F.lit(""))) - F.length(F.replace(x, F.lit("("), F.lit("")))

    def state(depth: Column, at: Column, ends: Column) -> Column:
        return F.struct(depth.alias("depth"), at.alias("at"), ends.alias("ends"))

    def step(acc: Column, more: Column) -> Column:
        depth, at = acc["depth"] + more, acc["at"] + 1
        return state(depth, at, F.when(depth == 0, F.concat(acc["ends"], F.array(at))).otherwise(acc["ends"]))

    def onward(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, state(acc["depth"], acc["at"], none), step)
        return bound(inner, lambda s: state(s["depth"], s["at"], F.concat(acc["ends"], s["ends"])))

    def closed(pieces: Column) -> Column:
        """How many pieces there are up to the end of each part."""
        # in chunks, as an aggregate copies its state at every step
        at = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / STEP).cast("int"))
        chunks = F.transform(at, lambda c: F.transform(F.slice(pieces, c * STEP + 1, F.lit(STEP)), extra))
        return F.aggregate(
            chunks,
            state(F.lit(0), F.lit(0), none),
            onward,
            lambda s: F.when(s["depth"] == 0, s["ends"]).otherwise(F.concat(s["ends"], F.array(s["at"]))),
        )

    def part(pieces: Column, ends: Column, end: Column, k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get(ends, k - 1))
        return F.array_join(F.slice(pieces, begin + 1, end - begin), mark)

    none = F.array().cast("array<int>")
    nested = bound(
        F.split(text, f"[{mark}]"),
        lambda pieces: bound(closed(pieces), lambda ends: F.transform(ends, lambda e, k: part(pieces, ends, e, k))),
    )
    # a parenthesis that no pair starts with stays open, so the rest of the text is one part
    part_of_pairs = rf"(?s)[{mark}]((?:[^{mark}()]++|{PAIR})*+(?:\(.*+)?)"
    parts = F.regexp_extract_all(F.concat(F.lit(mark), text), F.lit(part_of_pairs), F.lit(1))
    left = F.regexp_replace(text, "[^()]+", "")
    for _ in range(DEPTH):
        left = F.replace(left, F.lit("()"), F.lit(""))
    return F.when(~left.contains(")"), parts).otherwise(nested)


def truncate_ellipsis(c: Column, n: int) -> Column:
    """First ``n`` characters, followed by an ellipsis when something was cut."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def strip_fences(c: Column) -> Column:
    """Remove code-fence lines around and inside a text."""
    opened = F.regexp_replace(strip_ws(c), FENCE_OPEN, "")
    closed = F.regexp_replace(strip_ws(opened), FENCE_CLOSE, "")
    return strip_ws(closed)


def rule_tags(
    text: Column,
    rules: list[tuple[str, list[str], bool]] | None = None,
    generic: str = GENERIC_TAG,
    cap: int = MAX_TAGS,
) -> Column:
    """Tags of the first ``cap`` keyword rules that hold, in rule order.

    The generic tag is added when fewer than ``cap`` rules hold.
    """
    upper = F.upper(text)
    hits = []
    for tag, words, wanted in rules or SOURCE_RULES:
        found = F.lit(False)
        for word in words:
            found = found | upper.contains(word)
        hits.append(F.when(found if wanted else ~found, F.lit(tag)))
    tags = F.concat(F.array_compact(F.array(*hits)), F.array(F.lit(generic)))
    return F.slice(tags, 1, cap)


def escape_html(c: Column) -> Column:
    """Replace the five characters HTML reserves."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def dims_label(dims: Column) -> Column:
    """Map of sizes as ``K=256, M=256``, sorted by name."""
    pairs = F.transform(
        F.array_sort(F.map_entries(dims)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return F.array_join(pairs, ", ")


def run_stamp(name: Column) -> Column:
    """Time stamp in ``report_YYYYMMDD_HHMMSS``; null when the name has another shape."""
    stamp = F.regexp_extract(name, r"^report_(\d{8}_\d{6})$", 1)
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))
