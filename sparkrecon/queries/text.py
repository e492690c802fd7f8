"""Selections, first-wins choices, text expressions, logs, and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrecon.functions import text as X
from sparkrecon.operators import catalogue as K
from sparkrecon.operators import logs as L
from sparkrecon.operators import selection as S
from sparkrecon.plans.lineage import scratch_path
from sparkrecon.queries.registry import registrar
from sparkrecon.sources import text as IO

QUERIES: dict = {}
query = registrar(QUERIES)

NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in K.CATALOGUE) + "]"
RAW = """(SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN ' ' || c_nationkey || ' '
    WHEN 'HOUSEHOLD' THEN ' dgemm, DAXPY ,,' || c_name WHEN 'FURNITURE' THEN CAST(c_custkey * 10 AS VARCHAR)
    WHEN 'BUILDING' THEN '-5' ELSE c_name || ',' END AS raw FROM customer)"""


def requests(t):
    segment = F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey",
        "c_name",
        F.when(segment == "MACHINERY", F.concat(F.lit(" "), "c_nationkey", F.lit(" ")))
        .when(segment == "HOUSEHOLD", F.concat(F.lit(" dgemm, DAXPY ,,"), "c_name"))
        .when(segment == "FURNITURE", (F.col("c_custkey") * 10).cast("string"))
        .when(segment == "BUILDING", "-5")
        .otherwise(F.concat("c_name", F.lit(",")))
        .alias("raw"),
    )


def selected(t):
    chosen = requests(t).select("c_custkey", F.posexplode(S.parse_selection(F.col("raw"))).alias("pos", "name"))
    return chosen


SELECTED = f"""(SELECT c_custkey, unnest(range(len(names))) AS pos, unnest(names) AS name FROM (
    SELECT c_custkey, CASE WHEN try_cast(trim(raw) AS INTEGER) IS NOT NULL
        THEN list_slice({NAMES_SQL}, 1, greatest(1, least(try_cast(trim(raw) AS INTEGER), {len(K.CATALOGUE)})))
        ELSE list_filter(list_transform(string_split(raw, ','), lambda x: lower(trim(x))), lambda x: x <> '') END AS names
    FROM {RAW}) s)"""


@query("parse_selection", f"SELECT c_custkey, CAST(pos AS INTEGER) AS pos, name FROM {SELECTED}")
def parse_selection(t):
    return selected(t)


@query(
    "ordered_dedupe",
    f"SELECT name, min(c_custkey * 1000 + pos) AS ord FROM {SELECTED} GROUP BY 1",
)
def ordered_dedupe(t):
    placed = selected(t).withColumn("ord", F.col("c_custkey") * 1000 + F.col("pos"))
    return S.ordered_dedupe(placed, "name", "ord")


@query(
    "dedupe_lower",
    """SELECT lower(name) AS name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand
       FROM (SELECT CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name, p_partkey, p_brand FROM part) s
       GROUP BY 1""",
)
def dedupe_lower(t):
    mixed = t.part.select(
        F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), "p_partkey", "p_brand"
    )
    return S.dedupe_lower(mixed, "name", "p_partkey")


CANDIDATES = """(SELECT 'doc_' || doc_id AS name, 2 AS priority, source AS origin, length(text) AS bytes, true AS downloaded FROM documents
    UNION ALL SELECT 'doc_' || doc_id, 1, 'label', 50 + 60 * quality, true FROM labels
    UNION ALL SELECT 'doc_' || page_id, 0, 'cache', 10, NOT contains(url, 'www') FROM pages
    UNION ALL SELECT 'doc_' || item_id, 4, 'embedded', length(text), false FROM benchmark)"""


def candidates(t):
    def rows(df, key, priority, origin, size, downloaded):
        return df.select(
            F.concat(F.lit("doc_"), F.col(key)).alias("name"),
            F.lit(priority).alias("priority"),
            origin.alias("origin"),
            size.cast("long").alias("bytes"),
            downloaded.alias("downloaded"),
        )

    return (
        rows(t.documents, "doc_id", 2, F.col("source"), F.char_length("text"), F.lit(True))
        .unionByName(rows(t.labels, "doc_id", 1, F.lit("label"), 50 + 60 * F.col("quality"), F.lit(True)))
        .unionByName(rows(t.pages, "page_id", 0, F.lit("cache"), F.lit(10), ~F.col("url").contains("www")))
        .unionByName(rows(t.benchmark, "item_id", 4, F.lit("embedded"), F.char_length("text"), F.lit(False)))
    )


RESOLVED = f"""(SELECT name, min(priority) AS priority, arg_min(origin, priority) AS origin,
    CAST(arg_min(bytes, priority) AS BIGINT) AS bytes
    FROM {CANDIDATES} c WHERE NOT downloaded OR bytes > 100 GROUP BY 1)"""


@query("resolve_sources", f"SELECT * FROM {RESOLVED}")
def resolve_sources(t):
    return S.resolve_sources(candidates(t))


@query(
    "missing_sources",
    f"""SELECT name FROM (SELECT 'doc_' || o_custkey AS name FROM orders) o
        WHERE name NOT IN (SELECT name FROM {RESOLVED}) GROUP BY 1""",
)
def missing_sources(t):
    wanted = t.orders.select(F.concat(F.lit("doc_"), F.col("o_custkey")).alias("name"))
    return S.missing_sources(wanted, S.resolve_sources(candidates(t)))


RULES = [
    ("tion", ["TION"], True),
    ("no_eau", ["EAU"], False),
    ("the", ["THE ", "THE,"], True),
    ("digits", ["0", "1", "2"], True),
]


@query(
    "rule_tags",
    """SELECT doc_id, array_to_string(list_slice(CASE WHEN len(tags) < 3 THEN list_append(tags, 'numeric_semantics') ELSE tags END, 1, 3), '|') AS tags
       FROM (SELECT doc_id, list_filter([CASE WHEN contains(u, 'TION') THEN 'tion' END,
                CASE WHEN NOT contains(u, 'EAU') THEN 'no_eau' END,
                CASE WHEN contains(u, 'THE ') OR contains(u, 'THE,') THEN 'the' END,
                CASE WHEN contains(u, '0') OR contains(u, '1') OR contains(u, '2') THEN 'digits' END],
                lambda x: x IS NOT NULL) AS tags
             FROM (SELECT doc_id, upper(text) AS u FROM documents) d) s""",
)
def rule_tags(t):
    return t.documents.select("doc_id", F.array_join(X.rule_tags(F.col("text"), RULES), "|").alias("tags"))


@query(
    "truncate_ellipsis",
    "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS cut FROM documents",
)
def truncate_ellipsis(t):
    return t.documents.select("doc_id", X.truncate_ellipsis(F.col("text"), 120).alias("cut"))


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(
    "strip_fences",
    f"""SELECT conv_id, turn, {STRIP.format('text')} AS body, {STRIP.format("text || chr(10) || 'b')")} AS two FROM conversations""".replace(
        "'b')", "'b'"
    ),
)
def strip_fences(t):
    fence = F.lit("```")
    one = F.concat(F.lit(" "), fence, F.lit("rust\n"), F.col("text"), F.lit("\n"), fence, F.lit("  \n"))
    two = F.concat(fence, F.lit("\n"), F.col("text"), F.lit("\n"), fence, F.lit("\nb\n"), fence)
    return t.conversations.select("conv_id", "turn", X.strip_fences(one).alias("body"), X.strip_fences(two).alias("two"))


# --- logs -----------------------------------------------------------------------------

# Events as build-log lines of a user: views are blank lines, errors name a module.
LOG = """(SELECT user_id AS log, event_id AS ln, CASE event_type WHEN 'view' THEN '  '
    WHEN 'error' THEN '  --> src/mod_' || CAST(floor(value / 10) AS BIGINT) || '.rs:12:5'
    WHEN 'click' THEN 'warning in src/lib.rs:1' ELSE 'note: ' || event_type END AS line FROM events)"""


def log_lines(t):
    kind = F.col("event_type")
    module = F.floor(F.col("value") / 10).cast("string")
    return t.events.select(
        F.col("user_id").alias("log"),
        F.col("event_id").alias("ln"),
        F.when(kind == "view", "  ")
        .when(kind == "error", F.concat(F.lit("  --> src/mod_"), module, F.lit(".rs:12:5")))
        .when(kind == "click", "warning in src/lib.rs:1")
        .otherwise(F.concat(F.lit("note: "), kind))
        .alias("line"),
    )


@query(
    "failing_modules",
    rf"""SELECT log, module, min(ln) AS first_ln FROM (SELECT log, ln, regexp_extract(line, 'src/(\w+)\.rs:', 1) AS module FROM {LOG}) s
        WHERE module <> '' AND module <> 'lib' GROUP BY 1, 2""",
)
def failing_modules(t):
    return L.failing_modules(log_lines(t))


@query(
    "error_blocks",
    f"""WITH n AS (SELECT *, trim(line) = '' AS blank, sum(CAST(trim(line) = '' AS INTEGER)) OVER (PARTITION BY log ORDER BY ln) AS blk FROM {LOG}),
        h AS (SELECT log, blk FROM n WHERE NOT blank GROUP BY 1, 2 HAVING bool_or(contains(line, 'src/mod_3.rs')))
        SELECT n.log, CAST(n.blk AS BIGINT) AS blk, n.ln, n.line FROM n JOIN h ON n.log = h.log AND n.blk = h.blk WHERE NOT n.blank
        UNION ALL SELECT log, NULL, ln, line FROM n WHERE log NOT IN (SELECT log FROM h)""",
)
def error_blocks(t):
    return L.error_blocks(log_lines(t), F.col("line").contains("src/mod_3.rs"))


@query(
    "error_blocks_in_text",
    r"""SELECT doc_id, CASE WHEN len(b) > 0 THEN array_to_string(b, chr(10) || chr(10)) ELSE t END AS blocks
        FROM (SELECT doc_id, t, list_filter(string_split(t, chr(10) || chr(10)), lambda x: contains(x, 'tion')) AS b
              FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents) d) s""",
)
def error_blocks_in_text(t):
    """Every document line as a block of its own."""
    logs = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return L.error_blocks_in_text(logs, F.lit("tion")).select("doc_id", "blocks")


# --- files ----------------------------------------------------------------------------


@query(
    "read_corpus",
    """SELECT lang, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
       FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) s GROUP BY 1""",
)
def read_corpus(t):
    """Documents written as text files per language, read back as whole files, cut into lines."""
    path = scratch_path(t.spark, "corpus")
    (
        t.documents.select("lang", F.col("text").alias("value"))
        .write.option("maxRecordsPerFile", 10_000)
        .partitionBy("lang")
        .text(path)
    )
    files = IO.read_corpus(t.spark, path, "*.txt")
    lines = files.select(
        F.regexp_extract("doc", "lang=([^/]+)/", 1).alias("lang"), F.explode(X.lines_of(F.col("text"))).alias("line")
    )
    return lines.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars")
    )


@query(
    "read_lines",
    """SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, n) AS ln, line
       FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n
             FROM documents) s""",
)
def read_lines(t):
    """All texts of a language in files that sort into one text, read back in splits with line numbers of the whole text."""
    path = scratch_path(t.spark, "lines")
    (
        t.documents.select("lang", "doc_id", F.col("text").alias("value"))
        .repartitionByRange("lang", "doc_id")
        .sortWithinPartitions("lang", "doc_id")
        .select("lang", "value")
        .write.partitionBy("lang")
        .text(path)
    )
    lines = IO.read_lines(t.spark, path, "*.txt", by_folder=True)
    return lines.select(F.regexp_extract("doc", "lang=([^/]+)$", 1).alias("lang"), "ln", "line")


VALUES = """(SELECT CAST(l_linenumber AS VARCHAR) AS "case", row_number() OVER (PARTITION BY l_linenumber ORDER BY arg, pos) - 1 AS pos, v
    FROM (SELECT l_linenumber, 0 AS arg, l_orderkey AS pos, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 3
          UNION ALL SELECT l_linenumber, 1, l_orderkey, max(l_tax) FROM lineitem GROUP BY 1, 3) s)"""


def case_values(t):
    """Two arguments per line number: prices, then tax rates, by order."""
    per_order = t.lineitem.groupBy(F.col("l_linenumber").alias("case"), F.col("l_orderkey").alias("pos")).agg(
        F.max("l_extendedprice").alias("a"), F.max("l_tax").alias("b")
    )
    return per_order.select(
        "case",
        "pos",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("arg_ord"), F.col("a").alias("v")),
                F.struct(F.lit(1).alias("arg_ord"), F.col("b").alias("v")),
            )
        ).alias("x"),
    ).select("case", "x.arg_ord", "pos", "x.v")


@query("write_values", f'SELECT "case", CAST(pos AS INTEGER) AS pos, v FROM {VALUES}')
def write_values(t):
    path = scratch_path(t.spark, "values")
    IO.write_values(case_values(t), path, ["case"])
    back = IO.read_values(t.spark, path, "*.txt")
    return back.select(F.regexp_extract("file", "case=([^/]+)", 1).alias("case"), F.col("pos").cast("int").alias("pos"), "v")


@query("write_values_long", f'SELECT "case", CAST(pos AS INTEGER) AS pos, v FROM {VALUES}')
def write_values_long(t):
    """The same round trip with every long case cut into several files."""
    path = scratch_path(t.spark, "values")
    IO.write_values(case_values(t), path, ["case"], lines_per_file=2_000)
    back = IO.read_values(t.spark, path, "*.txt")
    return back.select(F.regexp_extract("file", "case=([^/]+)", 1).alias("case"), F.col("pos").cast("int").alias("pos"), "v")


@query(
    "read_values",
    """SELECT user_id, CASE WHEN void THEN NULL ELSE CAST(pos AS INTEGER) END AS pos, CASE WHEN void THEN NULL ELSE v END AS v
       FROM (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
               max(value) OVER (PARTITION BY user_id) > 150 AS void FROM events) s
       WHERE NOT void OR pos = 0""",
)
def read_values(t):
    """Value files per user with blank lines; a user with a large value has a bad line."""
    from sparkrecon.plans.prefix import ordered_concat

    bad = F.when(F.col("value") > 150, F.lit("T")).otherwise(F.col("value").cast("string"))
    lines = t.events.select("user_id", "event_id", F.concat(F.lit(" "), bad, F.lit(" \n")).alias("line"))
    texts = ordered_concat(lines, ["user_id"], "event_id", "line", "\n", "text")
    return IO.parse_values(texts, "user_id", "text")


@query(
    "write_report",
    "SELECT '| ' || o_orderkey || ' | ' || o_orderstatus || ' |' AS line FROM orders",
)
def write_report(t):
    from sparkrecon.operators.report import render_rows

    path = scratch_path(t.spark, "report")
    rows = render_rows(t.orders, [F.col("o_orderkey").cast("string"), F.col("o_orderstatus")], keep=["o_orderkey"])
    IO.write_report(rows, path, ["o_orderkey"])
    return IO.read_report(t.spark, path)
