"""Text corpus jobs over documents, and over source files written from the part table.

Every part becomes one source file. Parts of size 30 and less hold two units (a subroutine
with a continued header and a typed function), sizes 31 to 40 one unit without arguments
or END, larger sizes no unit at all.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrecon.operators import corpus as C
from sparkrecon.operators import graph as G
from sparkrecon.queries.registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)


def source_files(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    implicit = (
        F.when(size <= 10, "      IMPLICIT NONE\n").when(size <= 20, "      IMPLICIT REAL (I-K, Z)\n").otherwise("")
    )
    two_units = F.concat(
        F.lit("*     part "), F.col("p_name"), F.lit("\n      SUBROUTINE P"), k,
        F.lit("(N,ALPHA,\n     $   XV,INCX)\n"), implicit,
        F.lit("      INTEGER N,INCX\n      DOUBLE PRECISION XV(INCX,*) ! CALL HIDDEN(N)\nC     CALL IGNORED(N)\n\n"),
        F.lit("      call P"), F.floor(k / 2), F.lit("(N,ALPHA)\n      WRITE(*,*) 'a!b' ! note\n      END\n"),
        F.lit("      INTEGER FUNCTION F"), k, F.lit("(A, B)\n      F"), k, F.lit(" = SQRT(A) + P"), F.floor(k / 3),
        F.lit("(B)\n      end function\n"),
    )
    bare = F.concat(F.lit("      SUBROUTINE Q"), k, F.lit("\n      RETURN\n"))
    none = F.lit("      CALL P5(1)\n      X = MAX(1, 2)\n")
    return t.part.select(
        F.concat(F.lit("src/part_"), k, F.lit(".f")).alias("doc"),
        F.when(size <= 30, two_units).when(size <= 40, bare).otherwise(none).alias("text"),
    )


# What the files above hold, stated per unit: source text, name, kind, type, arguments.
IMPLICIT = """CASE WHEN p_size <= 10 THEN '      IMPLICIT NONE\n' WHEN p_size <= 20 THEN '      IMPLICIT REAL (I-K, Z)\n' ELSE '' END"""
UNITS = f"""(SELECT 'src/part_' || p_partkey || '.f' AS doc, 0 AS unit, p_partkey AS k, p_size, 'P' || p_partkey AS name,
      'subroutine' AS kind, NULL AS return_type, 'N,ALPHA,XV,INCX' AS args,
      '      SUBROUTINE P' || p_partkey || '(N,ALPHA,\n     $   XV,INCX)\n' || {IMPLICIT} ||
      '      INTEGER N,INCX\n      DOUBLE PRECISION XV(INCX,*) ! CALL HIDDEN(N)\nC     CALL IGNORED(N)\n\n      call P' ||
      p_partkey // 2 || '(N,ALPHA)\n      WRITE(*,*) ''a!b'' ! note\n      END' AS source FROM part WHERE p_size <= 30
    UNION ALL SELECT 'src/part_' || p_partkey || '.f', 1, p_partkey, p_size, 'F' || p_partkey, 'function', 'INTEGER', 'A,B',
      '      INTEGER FUNCTION F' || p_partkey || '(A, B)\n      F' || p_partkey || ' = SQRT(A) + P' || p_partkey // 3 ||
      '(B)\n      end function' FROM part WHERE p_size <= 30
    UNION ALL SELECT 'src/part_' || p_partkey || '.f', 0, p_partkey, p_size, 'Q' || p_partkey, 'subroutine', NULL, '',
      '      SUBROUTINE Q' || p_partkey || '\n      RETURN' FROM part WHERE p_size BETWEEN 31 AND 40
    UNION ALL SELECT 'src/part_' || p_partkey || '.f', 0, p_partkey, p_size, 'PART_' || p_partkey, 'subroutine', NULL, '',
      '      CALL P5(1)\n      X = MAX(1, 2)' FROM part WHERE p_size > 40)"""


def _sql_text(sql: str) -> str:
    """Line breaks inside SQL string literals as chr(10)."""
    out, inside = [], False
    for ch in sql:
        if ch == "'":
            inside = not inside
        out.append("' || chr(10) || '" if inside and ch == "\n" else ch)
    return "".join(out)


DOC_LINES = "(SELECT doc_id, unnest(range(1, len(l) + 1)) AS ln, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d)"


@query("line_table", f"SELECT doc_id, CAST(ln AS INTEGER) AS ln, line FROM {DOC_LINES}")
def line_table(t):
    return C.line_table(t.documents.select("doc_id", "text"))


# Document lines starting with C are comments, and an exclamation mark is put in by hand.
@query(
    "strip_comments",
    rf"""SELECT doc_id, ln, CASE WHEN contains(line, '!')
            AND (length(b) - length(replace(b, '''', ''))) % 2 = 0 AND (length(b) - length(replace(b, '"', ''))) % 2 = 0
            THEN regexp_replace(b, '\s+$', '') ELSE line END AS line
         FROM (SELECT doc_id, CAST(ln AS INTEGER) AS ln, line, string_split(line, '!')[1] AS b
               FROM (SELECT doc_id, ln, replace(replace(line, '. ', ' ! '), 'it', '''') AS line FROM {DOC_LINES}) m
               WHERE substr(line, 1, 1) NOT IN ('C', 'c', '*', '!') AND regexp_matches(line, '\S')) s""",
)
def strip_comments(t):
    lines = C.line_table(t.documents.select("doc_id", "text"))
    marked = F.replace(F.replace("line", F.lit(". "), F.lit(" ! ")), F.lit("it"), F.lit("'"))
    return C.strip_comments(lines.withColumn("line", marked))


@query("segment_units", None)
def segment_units(t):
    return C.units(source_files(t)).select("doc", "unit", "source")


@query("whole_file_fallback", None)
def whole_file_fallback(t):
    return C.unit_header(C.units(source_files(t)).filter("whole")).select("doc", "unit", "name", "source")


@query("unit_header", None)
def unit_header(t):
    return C.unit_header(C.units(source_files(t))).select(
        "doc", "unit", "name", "kind", "return_type", F.array_join("args", ",").alias("args"), "line_count"
    )


@query(
    "chunk",
    f"""SELECT doc_id, (ln - 1) // 5 AS piece, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY ln) AS text
        FROM {DOC_LINES} GROUP BY 1, 2""",
)
def chunk(t):
    lines = C.line_table(t.documents.select("doc_id", "text")).withColumn("pos", F.col("ln") - 1)
    return C.chunk(lines, ["doc_id"], "pos", 5)


@query(
    "chunk_texts",
    f"""SELECT doc_id, (ln - 1) // 5 AS piece, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY ln) AS text
        FROM {DOC_LINES} GROUP BY 1, 2""",
)
def chunk_texts(t):
    return C.chunk_texts(t.documents, ["doc_id"], n=5)


@query("declarations", None)
def declarations(t):
    found = C.declarations(C.unit_header(C.units(source_files(t))))
    return found.withColumn("dims", F.array_join("dims", ","))


# Sources from the documents: every line of a text becomes a declaration line whose items are its words, with dimensions
# that hold commas and parentheses of their own, odd indents, notes and comments; the first words are the arguments.
SHAPES = ["{w}", "{w}(n,*)", "{w}(max(1,n), *)", "{w} (2,n)", "{w}(f(g(1),h(2)),3)", "{w}((1)"]
KINDS = ["INTEGER", "double  precision", "Real", "CHARACTER*1", "LOGICAL"]
INDENTS = ["      ", "\t", "  \t "]


def declared_texts(t):
    def item(w, k):
        shape = F.when(F.length(w) == 11, 5).otherwise((F.length(w) + k) % 5)
        return F.concat(w, F.element_at(F.array(*[F.lit(s.removeprefix("{w}")) for s in SHAPES]), shape + 1))

    def line(text, n):
        names = F.regexp_extract_all(text, F.lit("[a-z]{2,}"), F.lit(0))
        start = F.when(n % 7 == 6, "C").otherwise(F.element_at(F.array(*map(F.lit, INDENTS)), n % 3 + 1))
        kind = F.element_at(F.array(*map(F.lit, KINDS)), n % 5 + 1)
        note = F.when(n % 4 == 3, " ! note, (").otherwise("")
        return F.concat(start, kind, F.lit(" "), F.array_join(F.transform(names, item), ", "), note)

    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{2,}"), F.lit(0)))
    head = F.concat(F.lit("      SUBROUTINE D("), F.array_join(F.slice(words, 1, 8), ","), F.lit(")\n"))
    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return t.documents.select(F.col("doc_id").alias("doc"), F.concat(head, body).alias("text"))


def _pick(index: str, values: list[str]) -> str:
    quoted = ", ".join("chr(9)" if v == "\t" else "'  ' || chr(9) || ' '" if "\t" in v else f"'{v}'" for v in values)
    return f"list_extract([{quoted}], ({index}) + 1)"


@query(
    "declarations_in_text",
    rf"""WITH lines AS (SELECT doc_id, ln - 1 AS n, line FROM {DOC_LINES}),
      written AS (
        SELECT doc_id, n, CASE WHEN n % 7 = 6 THEN 'C' ELSE {_pick("n % 3", INDENTS)} END || {_pick("n % 5", KINDS)} || ' ' ||
          array_to_string(list_transform(regexp_extract_all(line, '[a-z]{{2,}}'), lambda w, k:
            replace({_pick("CASE WHEN len(w) = 11 THEN 5 ELSE (len(w) + k - 1) % 5 END", SHAPES)}, '{{w}}', w)), ', ') ||
          CASE WHEN n % 4 = 3 THEN ' ! note, (' ELSE '' END AS line
        FROM lines),
      code AS (SELECT doc_id, n, upper(regexp_replace(string_split(line, '!')[1], '^\s+|\s+$', '', 'g')) AS c
        FROM written WHERE line[1] <> 'C'),
      typed AS (SELECT doc_id, n, regexp_replace(regexp_extract(c, '^(DOUBLE\s+PRECISION|REAL|INTEGER|LOGICAL|CHARACTER)', 1), '\s+', ' ') AS t,
          regexp_replace(c, '^(DOUBLE\s+PRECISION|REAL|INTEGER|LOGICAL|CHARACTER\s*\*\s*1)\s*', '') AS s FROM code),
      pieces AS (SELECT doc_id, n, t, unnest(p) AS piece, unnest(range(len(p))) AS k FROM (SELECT *, string_split(s, ',') AS p FROM typed) x),
      depths AS (SELECT *, sum(len(replace(piece, ')', '')) - len(replace(piece, '(', ''))) OVER (PARTITION BY doc_id, n ORDER BY k) AS depth
        FROM pieces),
      groups AS (SELECT *, coalesce(sum((depth = 0)::INT) OVER (PARTITION BY doc_id, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS g FROM depths),
      items AS (SELECT doc_id, n, t, g AS k, trim(string_agg(piece, ',' ORDER BY k)) AS item FROM groups GROUP BY doc_id, n, t, g),
      parsed AS (SELECT doc_id, n, k, t, regexp_extract(item, '^(\w+)\s*\([^)]+\)', 1) AS a,
          regexp_extract(item, '^\w+\s*\(([^)]+)\)', 1) AS d, regexp_extract(item, '^\S+') AS w FROM items WHERE item <> ''),
      last AS (SELECT doc_id, CASE WHEN a <> '' THEN a ELSE w END AS arg, arg_max(t, n * 1000000 + k) AS t,
          arg_max(CASE WHEN a <> '' THEN regexp_replace(d, '\s*,\s*', ',', 'g') ELSE '' END, n * 1000000 + k) AS d
        FROM parsed GROUP BY 1, 2),
      words AS (SELECT doc_id, upper(w) AS arg, min(p) AS p FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p
          FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]{{2,}}') AS ws FROM documents) d) e GROUP BY 1, 2),
      args AS (SELECT doc_id, arg, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS arg_ord FROM words)
    SELECT a.doc_id AS doc, 0 AS unit, CAST(arg_ord AS INTEGER) AS arg_ord, a.arg, coalesce(t, 'DOUBLE PRECISION') AS ftype, coalesce(d, '') AS dims
    FROM args a LEFT JOIN last USING (doc_id, arg) WHERE arg_ord < 8""",
)
def declarations_in_text(t):
    found = C.declarations(C.unit_header(C.units(declared_texts(t))))
    return found.withColumn("dims", F.array_join("dims", ","))


@query("implicit_types", None)
def implicit_types(t):
    return C.implicit_types(C.units(source_files(t)))


@query("call_edges", None)
def call_edges(t):
    return C.call_edges(C.unit_header(C.units(source_files(t))))


@query("unit_stats", None)
def unit_stats(t):
    return C.unit_stats(C.units(source_files(t)))


EDGES = """(SELECT 'P' || k AS src, 'XV' AS dst FROM {0} u WHERE unit = 0 AND p_size <= 30
    UNION SELECT 'P' || k, 'P' || k // 2 FROM {0} u WHERE unit = 0 AND p_size <= 30 AND k // 2 <> k
    UNION SELECT 'F' || k, 'P' || k // 3 FROM {0} u WHERE unit = 1
    UNION SELECT name, 'P5' FROM {0} u WHERE p_size > 40)"""


def _set(name: str, sql: str) -> None:
    QUERIES[name] = (QUERIES[name][0], sql)


UNITS = _sql_text(UNITS)
EDGES = EDGES.format(UNITS)
_set("segment_units", f"SELECT doc, unit, source FROM {UNITS} u")
_set("whole_file_fallback", f"SELECT doc, unit, name, source FROM {UNITS} u WHERE p_size > 40")
_set(
    "unit_header",
    f"""SELECT doc, unit, name, kind, return_type, args, CAST(len(string_split(source, chr(10))) AS INTEGER) AS line_count
        FROM {UNITS} u""",
)
_set(
    "unit_stats",
    f"""SELECT doc, unit, CAST(len(string_split(source, chr(10))) AS INTEGER) AS n_lines,
          CAST(length(source) AS INTEGER) AS n_chars FROM {UNITS} u""",
)
_set(
    "declarations",
    f"""SELECT doc, unit, arg_ord, arg, ftype, dims FROM {UNITS} u JOIN (VALUES
          (0, 0, 'N', 'INTEGER', ''), (0, 1, 'ALPHA', 'DOUBLE PRECISION', ''), (0, 2, 'XV', 'DOUBLE PRECISION', 'INCX,*'),
          (0, 3, 'INCX', 'INTEGER', ''), (1, 0, 'A', 'DOUBLE PRECISION', ''), (1, 1, 'B', 'DOUBLE PRECISION', ''))
          AS d(unit, arg_ord, arg, ftype, dims) USING (unit) WHERE p_size <= 30""",
)
_set(
    "implicit_types",
    f"""SELECT doc, unit, chr(CAST(c AS INTEGER)) AS letter, CASE WHEN unit = 0 AND p_size BETWEEN 11 AND 20 AND chr(CAST(c AS INTEGER)) IN ('I', 'J', 'K', 'Z')
            THEN 'REAL' WHEN chr(CAST(c AS INTEGER)) BETWEEN 'I' AND 'N' THEN 'INTEGER' ELSE 'REAL' END AS ftype
        FROM {UNITS} u, range(65, 91) r(c) WHERE NOT (unit = 0 AND p_size <= 10)""",
)
_set("call_edges", f"SELECT src, dst FROM {EDGES} e")


@query("known_edges", f"SELECT src, dst FROM {EDGES} e WHERE dst IN (SELECT name FROM {UNITS} u)")
def known_edges(t):
    headed = C.unit_header(C.units(source_files(t)))
    return C.known_edges(C.call_edges(headed), headed)


# --- graph ----------------------------------------------------------------------------


def part_tree(t):
    """Every part needs the part of half its number; nations form a ring, regions need it."""
    parts = t.part.select(
        F.concat(F.lit("P"), "p_partkey").alias("src"), F.concat(F.lit("P"), F.floor(F.col("p_partkey") / 2)).alias("dst")
    )
    ring = t.nation.select(
        F.concat(F.lit("N"), "n_nationkey").alias("src"),
        F.concat(F.lit("N"), (F.col("n_nationkey") + 1) % 25).alias("dst"),
    )
    regions = t.region.select(
        F.concat(F.lit("R"), "r_regionkey").alias("src"), F.concat(F.lit("N"), "r_regionkey").alias("dst")
    )
    edges = parts.unionByName(ring).unionByName(regions)
    return edges, edges.select(F.col("src").alias("node"))


@query(
    "topo_levels",
    """SELECT 'P' || p_partkey AS node, CAST(CASE p_partkey WHEN 0 THEN 0 ELSE length(bin(p_partkey)) END AS INTEGER) AS level FROM part
       UNION ALL SELECT 'N' || n_nationkey, NULL FROM nation UNION ALL SELECT 'R' || r_regionkey, NULL FROM region""",
)
def topo_levels(t):
    return G.topo_levels(*part_tree(t))


PRIORITIES = "(SELECT DISTINCT o_custkey, o_orderpriority FROM orders)"


def priorities(t):
    edges = t.orders.select(
        F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst")
    )
    return edges, t.customer.select(F.col("c_custkey").alias("node"))


@query(
    "adjacency",
    f"SELECT c_custkey AS node, o_orderpriority AS callee FROM customer LEFT JOIN {PRIORITIES} p ON c_custkey = o_custkey",
)
def adjacency(t):
    return G.adjacency(*priorities(t))


@query(
    "render_adjacency",
    f"""SELECT c_custkey AS node, coalesce(string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority), '(leaf)') AS callees
        FROM customer LEFT JOIN {PRIORITIES} p ON c_custkey = o_custkey GROUP BY 1""",
)
def render_adjacency(t):
    return G.render_adjacency(*priorities(t))
