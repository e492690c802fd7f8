"""Fixed-form source text as tables: lines, units, chunks, declarations, call edges.

A corpus is ``(doc, text)``, one row per file. A line table is ``(doc, ln, line)`` with ``ln``
from 1. Units are ``(doc, unit, source)``; ``unit`` numbers the units of a file in order,
not always densely. Cutting a text into units happens inside its row: no shuffle, and no
group larger than one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.functions.text import bound, lines_of, plain_text, split_outside, strip_ws
from sparkrecon.plans.joins import lookup_join

# Patterns of fixed-form source text. Column 6 marks a continuation.
COMMENT = r"^[Cc*!]"
BLANK = r"[^\S\n]"
RETURN_TYPES = (
    rf"DOUBLE{BLANK}+PRECISION|REAL(?:{BLANK}*\*{BLANK}*\d+)?|INTEGER(?:{BLANK}*\*{BLANK}*\d+)?|LOGICAL"
    rf"|CHARACTER(?:{BLANK}*\*{BLANK}*\d+)?|COMPLEX(?:{BLANK}*\*{BLANK}*\d+)?"
)
UNIT_KIND = rf"(?:RECURSIVE{BLANK}+)?(SUBROUTINE|FUNCTION){BLANK}+(\w+){BLANK}*"
HEADER = rf"(?im)^{BLANK}{{0,6}}(?:({RETURN_TYPES}){BLANK}+)?{UNIT_KIND}\("
HEADER_BARE = rf"(?im)^{BLANK}{{0,6}}{UNIT_KIND}$"
FROM_HEADER = rf"(?:{HEADER}|{HEADER_BARE})(?s:.*)"
END_LINE = rf"(?im)^({BLANK}{{0,6}}END(?:{BLANK}+(?:SUBROUTINE|FUNCTION)\b[^\n]*|{BLANK}*))(?:\n|\z)"
CONTINUED = r"\n {5}[^ \n]"
CALL_STATEMENT = r"(?i)^\s+CALL\s+(\w+)\s*\("
CALL_EXPRESSION = r"(?i)\b([A-Z]\w+)\s*\("
DECLARATION = r"^(?:(DOUBLE\s+PRECISION|REAL|INTEGER|LOGICAL)|(CHARACTER)(?:\s*\*\s*1?)?)\s+(.*)"
# From the grammar: a type, with a length or PRECISION after it, then letters and ranges in parentheses.
IMPLICIT_RULE = r"(?i)\bIMPLICIT\s+([A-Z]\w*(?:\s*\*\s*\d+|\s+PRECISION)?)\s*\(([^()]*)\)"
IMPLICIT_NONE = r"(?i)^\s*IMPLICIT\s+NONE"
CHUNK_LINES = 200

# Names followed by "(" that are no calls.
KEYWORDS = (
    "IF DO WHILE THEN ELSE END RETURN WRITE READ FORMAT PRINT OPEN CLOSE MAX MIN ABS SQRT INT "
    "REAL DBLE ICHAR CHAR CMPLX CONJG AIMAG LOG EXP SIN COS TAN ATAN ATAN2 SIGN MOD DIM "
    "PARAMETER IMPLICIT NONE INTEGER DOUBLE PRECISION LOGICAL CHARACTER EXTERNAL INTRINSIC DATA "
    "COMMON EQUIVALENCE SAVE ALLOCATE DEALLOCATE NULLIFY SUBROUTINE FUNCTION PROGRAM MODULE "
    "CONTAINS USE CALL GOTO CONTINUE STOP"
).split()

UNIT = ["doc", "unit"]


def line_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, every other column kept."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(lines_of(F.col(text))).alias("ln", "line")).withColumn(
        "ln", F.col("ln") + 1
    )


def is_comment(line: Column) -> Column:
    return line.rlike(COMMENT)


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def code_part(line: Column) -> Column:
    """Line without a trailing comment: cut at the first ``!`` unless it is inside quotes."""
    before = F.substring_index(line, "!", 1)

    def even(mark: str) -> Column:
        return (F.length(before) - F.length(F.replace(before, F.lit(mark), F.lit("")))) % 2 == 0

    cut = line.contains("!") & even("'") & even('"')
    return F.when(cut, F.regexp_replace(before, r"\s+$", "")).otherwise(line)


def strip_comments(lines: DataFrame) -> DataFrame:
    """Drop comment lines and blank lines, cut trailing comments. Line numbers stay."""
    kept = lines.filter(~is_comment(F.col("line")) & ~is_blank(F.col("line")))
    return kept.withColumn("line", code_part(F.col("line")))


def chunk(lines: DataFrame, keys: list[str], pos: str, n: int = CHUNK_LINES) -> DataFrame:
    """Pieces of at most ``n`` lines: ``(keys, piece, n_lines, text)``; ``pos`` starts at 0."""
    return (
        lines.withColumn("piece", F.floor(F.col(pos) / F.lit(n)))
        .groupBy(*keys, "piece")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("line").alias("t")))),
                    lambda e: e["t"],
                ),
                "\n",
            ).alias("text"),
        )
    )


def chunk_texts(docs: DataFrame, keys: list[str], text: str = "text", n: int = CHUNK_LINES) -> DataFrame:
    """``chunk`` of texts that are one cell still: they are sliced in their row, and nothing is shuffled."""

    def pieces(lines: Column) -> Column:
        many = F.ceil(F.size(lines) / F.lit(n)).cast("int")
        return F.transform(
            F.slice(F.sequence(F.lit(0), many), F.lit(1), many),
            lambda i: F.struct(
                i.cast("long").alias("piece"),
                F.least(F.lit(n), F.size(lines) - i * n).cast("long").alias("n_lines"),
                F.array_join(F.slice(lines, i * n + 1, F.lit(n)), "\n").alias("text"),
            ),
        )

    return docs.select(*keys, F.explode(bound(lines_of(F.col(text)), pieces)).alias("_p")).select(*keys, "_p.*")


def units(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Program units of every file: ``(doc, unit, source)``.

    END lines cut a text into segments; a unit is a segment from its first header on. A
    file without a unit that is not blank counts as one unit.
    """
    keep = keep or []
    # Uniform line ends free the carriage return as a segment mark.
    plain = docs.select("doc", *keep, plain_text(F.col("text")).alias("_plain"))
    cut = plain.withColumn(
        "_units",
        F.filter(
            F.transform(
                F.split(F.regexp_replace("_plain", END_LINE, "$1\r"), "\r"),
                lambda s, n: F.struct(n.alias("unit"), F.regexp_extract(s, FROM_HEADER, 0).alias("source")),
            ),
            lambda u: u["source"] != "",
        ),
    )
    # No filter, and no explode of a plain column: Spark would push a test of the worked-out
    # array below the projections and cut every text again for it.
    whole = F.size("_units") == 0
    only = F.array(F.struct(F.lit(0).alias("unit"), F.col("_plain").alias("source")))
    fallback = F.when(F.col("_plain").rlike(r"\S"), only).otherwise(F.slice(only, 1, 0))
    return cut.select(
        "doc", *keep, whole.alias("whole"), F.explode(F.when(whole, fallback).otherwise(F.col("_units"))).alias("_u")
    ).select("doc", *keep, "_u.unit", "_u.source", "whole")


def file_stem(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def unit_header(found: DataFrame) -> DataFrame:
    """Add name, kind, return type, arguments and line count to units.

    Continuation lines are joined to the header before its argument list is read. A
    whole-file unit takes the upper-case file name and has no arguments.
    """
    unfolded = F.regexp_replace("source", CONTINUED, " ")
    head = F.split(unfolded, "\n", 2)[0]
    args = F.filter(
        F.transform(F.split(F.regexp_extract("_head", r"\(([^)]*)\)", 1), ","), lambda a: F.trim(a)),
        lambda a: a != "",
    )
    kind = F.coalesce(
        F.nullif(F.regexp_extract("_head", HEADER, 2), F.lit("")),
        F.regexp_extract("_head", HEADER_BARE, 1),
    )
    name = F.coalesce(
        F.nullif(F.regexp_extract("_head", HEADER, 3), F.lit("")),
        F.regexp_extract("_head", HEADER_BARE, 2),
    )
    rtype = F.upper(F.regexp_replace(F.regexp_extract("_head", HEADER, 1), r"\s+", " "))
    whole = F.col("whole")
    return found.withColumn("_head", head).select(
        *found.columns,
        F.when(whole, F.upper(file_stem(F.col("doc").cast("string")))).otherwise(F.upper(name)).alias("name"),
        F.when(whole, "subroutine").otherwise(F.lower(kind)).alias("kind"),
        F.when(~whole, F.nullif(rtype, F.lit(""))).alias("return_type"),
        F.when(whole, F.array().cast("array<string>")).otherwise(args).alias("args"),
        F.size(lines_of(F.col("source"))).alias("line_count"),
    )


def unit_lines(found: DataFrame) -> DataFrame:
    """Lines of units: ``(doc, unit, pos, line)``."""
    return found.select(*UNIT, F.posexplode(lines_of(F.col("source"))).alias("pos", "line"))


def unit_stats(found: DataFrame) -> DataFrame:
    """Lines and characters per unit."""
    return found.select(
        *UNIT,
        F.size(lines_of(F.col("source"))).alias("n_lines"),
        F.char_length("source").alias("n_chars"),
    )


def declarations(headed: DataFrame) -> DataFrame:
    """Type and dimensions of every argument: ``(doc, unit, arg_ord, arg, ftype, dims)``.

    A later declaration replaces an earlier one; an argument without any is a scalar of
    type DOUBLE PRECISION. Items end at commas outside all parentheses; the dimensions of an item reach to its
    first closing parenthesis. Declared items of arguments are shuffled by unit and argument, not whole lines. A unit is read
    once: the names of its arguments go along as one more line.
    """
    # lines hold no other white space: the rest of it ends them
    trimmed = lambda c: F.btrim(c, F.lit(" \t"))
    code = F.upper(trimmed(F.substring_index("line", "!", 1)))
    ftype = F.concat(F.regexp_extract("_code", DECLARATION, 1), F.regexp_extract("_code", DECLARATION, 2))
    upper_args = F.transform("args", lambda a: F.upper(a))
    firsts = F.transform("_args", lambda a: F.left(a, F.lit(1)))
    heads = F.transform("_args", lambda a: F.regexp_extract(a, r"^\w*", 0))
    none = F.array().cast("array<string>")
    named = headed.select(*UNIT, "source", upper_args.alias("_args"))
    lines = named.select(
        *UNIT,
        "_args",
        heads.alias("_heads"),
        firsts.alias("_firsts"),
        # line -1 is null and stands for the arguments themselves
        F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(lines_of(F.col("source")), none))).alias(
            "pos", "line"
        ),
    )
    own = F.col("line").isNull()
    first = F.left(F.ltrim("_item"), F.lit(1))
    begins = F.array_contains("_firsts", first) | (first < "!")
    declaring = ~is_comment(F.col("line")) & F.col("_code").rlike(DECLARATION)
    found = (
        lines.withColumn("_code", code)
        .filter(own | declaring)
        .select(
            *UNIT,
            "_args",
            "_heads",
            "_firsts",
            "pos",
            own.alias("_own"),
            F.regexp_replace(ftype, r"\s+", " ").alias("ftype"),
            F.regexp_extract("_code", DECLARATION, 3).alias("_items"),
        )
        .select(
            *UNIT,
            "_args",
            "_heads",
            "_firsts",
            "pos",
            "_own",
            "ftype",
            # an outer form keeps Spark from cutting every line twice to test whether there is an item
            F.posexplode_outer(F.when(F.col("_own"), F.col("_args")).otherwise(split_outside(F.col("_items")))).alias(
                "item_ord", "_item"
            ),
        )
        # an item that is no argument mostly shows by its first letter or word; only the others are looked at closely
        .filter(F.col("_own") | (begins & F.array_contains("_heads", F.regexp_extract("_item", r"^\s*(\w*)", 1))))
        .withColumn("_item", F.when(F.col("_own"), F.col("_item")).otherwise(trimmed(F.col("_item"))))
        .filter("_own or _item <> ''")
        .select(
            *UNIT,
            "_args",
            "pos",
            "item_ord",
            "_own",
            "ftype",
            "_item",
            F.regexp_extract("_item", r"^(\w+)\s*\([^)]+\)", 1).alias("_array"),
            F.regexp_extract("_item", r"^\w+\s*\(([^)]+)\)", 1).alias("_dims"),
            F.split("_item", r"\s+")[0].alias("_scalar"),
        )
        .select(
            *UNIT,
            "_args",
            F.when(F.col("_own"), F.col("_item"))
            .when(F.col("_array") != "", F.col("_array"))
            .otherwise(F.col("_scalar"))
            .alias("arg"),
            F.when(F.col("_own"), F.col("item_ord")).alias("_ord"),
            F.when(
                ~F.col("_own"),
                F.struct(
                    F.col("pos"),
                    F.col("item_ord"),
                    F.col("ftype"),
                    F.when(F.col("_array") != "", F.transform(F.split("_dims", ","), strip_ws))
                    .otherwise(F.array().cast("array<string>"))
                    .alias("dims"),
                ),
            ).alias("_decl"),
        )
        # only arguments are shuffled, however much a unit declares; a unit without a name declares nothing
        .filter(
            F.col("_ord").isNotNull()
            | (F.array_contains("_args", F.col("arg")) & F.col("doc").isNotNull() & F.col("unit").isNotNull())
        )
    )
    last = found.groupBy(*UNIT, "arg").agg(F.max("_decl").alias("_decl"), F.collect_list("_ord").alias("_ords"))
    return last.select(*UNIT, "arg", "_decl", F.explode("_ords").alias("arg_ord")).select(
        *UNIT,
        "arg_ord",
        "arg",
        F.coalesce("_decl.ftype", F.lit("DOUBLE PRECISION")).alias("ftype"),
        F.coalesce("_decl.dims", F.array().cast("array<string>")).alias("dims"),
    )


def implicit_types(found: DataFrame) -> DataFrame:
    """Type of every initial letter per unit: ``(doc, unit, letter, ftype)``.

    I to N are INTEGER and the rest REAL unless an IMPLICIT rule says otherwise; a unit
    with IMPLICIT NONE has no rows. All of it happens inside the unit's row.
    """

    def rules(line: Column) -> Column:
        ftype = F.regexp_replace(F.upper(F.regexp_extract(line, IMPLICIT_RULE, 1)), r"\s*\*\s*", "*")
        ftype = F.regexp_replace(ftype, " ", "_")
        ranges = F.filter(
            F.transform(F.split(F.upper(F.regexp_extract(line, IMPLICIT_RULE, 2)), ","), lambda p: F.trim(p)),
            lambda p: (ftype != "") & p.rlike(r"^[A-Z](?:\s*-\s*[A-Z])?$"),
        )
        return F.transform(
            ranges, lambda p: F.struct(F.substring(p, 1, 1).alias("low"), F.substring(p, -1, 1).alias("high"), ftype.alias("ftype"))
        )

    def typed(given: Column) -> Column:
        """One entry per letter; the last rule that names it counts."""
        alphabet = F.split(F.lit("A B C D E F G H I J K L M N O P Q R S T U V W X Y Z"), " ")

        def entry(letter: Column) -> Column:
            last = F.get(F.reverse(F.filter(given, lambda r: (r["low"] <= letter) & (letter <= r["high"]))), 0)
            default = F.when(letter.between("I", "N"), "INTEGER").otherwise("REAL")
            return F.struct(letter.alias("letter"), F.coalesce(last["ftype"], default).alias("ftype"))

        return F.transform(alphabet, entry)

    def letters(implicit: Column) -> Column:
        whole = bound(F.flatten(F.transform(implicit, rules)), typed)
        return F.when(F.exists(implicit, lambda s: s.rlike(IMPLICIT_NONE)), F.slice(whole, 1, 0)).otherwise(whole)

    implicit = F.filter(lines_of(F.col("source")), lambda s: F.upper(s).contains("IMPLICIT"))
    return found.select(*UNIT, F.explode(bound(implicit, letters)).alias("_l")).select(*UNIT, "_l.letter", "_l.ftype")


def call_edges(headed: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)``: unit name to every name it calls, in upper case.

    Comments do not count as calls and a unit does not call itself.
    """
    named = (
        headed.select(F.col("name").alias("src"), F.explode(lines_of(F.col("source"))).alias("line"))
        .filter(F.col("line").contains("(") & ~is_comment(F.col("line")))
        .withColumn("line", code_part(F.col("line")))
    )
    expressions = F.filter(
        F.transform(F.regexp_extract_all("line", F.lit(CALL_EXPRESSION), F.lit(1)), lambda n: F.upper(n)),
        lambda n: ~n.isin(KEYWORDS),
    )
    statement = F.array(F.upper(F.regexp_extract("line", CALL_STATEMENT, 1)))
    return (
        named.select("src", F.explode(F.concat(expressions, statement)).alias("dst"))
        .filter((F.col("dst") != "") & ~F.col("dst").eqNullSafe(F.col("src")))
        .distinct()
    )


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a node. A target named by very many edges is salted."""
    return lookup_join(edges, nodes.select(F.col("name").alias("dst")).distinct(), ["dst"], "left_semi").select(
        "src", "dst"
    )
