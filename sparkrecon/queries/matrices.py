"""Matrix operators over order x part and nation x nation quantities, and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrecon.operators import matrices as M
from sparkrecon.operators import vectors as V
from sparkrecon.plans.lineage import checkpoint
from sparkrecon.queries.registry import registrar, rounded

QUERIES: dict = {}
query = registrar(QUERIES)

ORDER_PART = "(SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
PRICE = "(SELECT p_partkey AS k, p_retailprice AS v FROM part)"
TOTAL = "(SELECT o_orderkey AS k, o_totalprice AS v FROM orders)"
# Trade matrix: nation of the supplier x nation of the customer.
TRADE = """(SELECT CAST(s_nationkey AS BIGINT) AS i, CAST(c_nationkey AS BIGINT) AS j, sum(l_quantity) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
# Quantity per customer nation x order priority digit, and balances per nation.
BALANCE = "(SELECT CAST(s_nationkey AS BIGINT) AS k, sum(s_acctbal) AS v FROM supplier GROUP BY 1)"
CBALANCE = "(SELECT CAST(c_nationkey AS BIGINT) AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1)"
NATIONS = 25


def order_part(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")
    )


def price(t):
    return t.part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))


def total(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))


def trade(t):
    """Supplier nation x customer nation, built by aggregating before the last lookups."""
    per_order = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    placed = per_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_suppkey", "o_custkey", "v"
    )
    named = placed.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.supplier, F.col("l_suppkey") == F.col("s_suppkey")
    )
    return M.matrix(named, F.col("s_nationkey").cast("long"), F.col("c_nationkey").cast("long"), "v")


def stored_trade(t):
    """The trade matrix, written once for queries that read it more than once."""
    return checkpoint(trade(t))


def balance(t):
    return V.vector(t.supplier, F.col("s_nationkey").cast("long"), "s_acctbal")


def cbalance(t):
    return V.vector(t.customer, F.col("c_nationkey").cast("long"), "c_acctbal")


@query(
    "gemv",
    f"""SELECT k, round(sum(v), 3) AS v FROM (
          SELECT i AS k, 2 * a.v * p.v AS v FROM {ORDER_PART} a JOIN {PRICE} p ON a.j = p.k
          UNION ALL SELECT k, -0.5 * v FROM {TOTAL}) s GROUP BY k""",
)
def gemv(t):
    return rounded(M.gemv(order_part(t), price(t), total(t), alpha=2.0, beta=-0.5), 3, "v")


@query(
    "gemv_transposed",
    f"SELECT a.j AS k, round(sum(a.v * o.v), 2) AS v FROM {ORDER_PART} a JOIN {TOTAL} o ON a.i = o.k GROUP BY 1",
)
def gemv_transposed(t):
    return rounded(M.gemv(order_part(t), total(t), trans="T"), 2, "v")


@query(
    "gemv_salted",
    f"SELECT a.j AS k, round(sum(a.v * o.v), 2) AS v FROM {ORDER_PART} a JOIN {TOTAL} o ON a.i = o.k GROUP BY 1",
)
def gemv_salted(t):
    """The same product when the vector may not be broadcast and busy orders are salted."""
    return rounded(M.gemv(order_part(t), total(t), trans="T", hot_rows=8), 2, "v")


@query(
    "gemm",
    f"""SELECT i, j, round(sum(v), 1) AS v FROM (
          SELECT a.i, b.j, 0.5 * a.v * b.v AS v FROM {TRADE} a JOIN {TRADE} b ON a.j = b.i
          UNION ALL SELECT i, j, 3 * v FROM {TRADE}) s GROUP BY 1, 2""",
)
def gemm(t):
    a = stored_trade(t)
    return rounded(M.gemm(a, a, a, alpha=0.5, beta=3.0), 1, "v")


@query(
    "gemm_transposed",
    f"""SELECT a.j AS i, b.i AS j, round(sum(a.v * b.v), 1) AS v
        FROM {TRADE} a JOIN {TRADE} b ON a.i = b.j GROUP BY 1, 2""",
)
def gemm_transposed(t):
    a = stored_trade(t)
    return rounded(M.gemm(a, a, ta="T", tb="C"), 1, "v")


# Order x segment times part: who buys what together with which customer segment.
SEGMENT = "(SELECT o_orderkey AS i, c_nationkey AS j, CAST(1 AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(
    "gemm_sparse",
    f"""SELECT CAST(s.j AS BIGINT) AS i, a.j AS j, sum(a.v * s.v) AS v
        FROM {SEGMENT} s JOIN {ORDER_PART} a ON s.i = a.i GROUP BY 1, 2""",
)
def gemm_sparse(t):
    """Nation x order times order x part; Spark chooses how to join and splits busy orders."""
    who = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("i"), F.col("c_nationkey").cast("long").alias("j"), F.lit(1.0).alias("v")
    )
    return M.gemm(who, order_part(t), ta="T")


# Many matrices at once: one case per supplier, with its own factors and flags. op(A) is order x part and op(B) part x
# line number in every case, stored transposed where the flag says so; the twins start from the plain products.
CASE_OP = "(SELECT l_suppkey AS g, l_orderkey AS o, l_partkey AS p, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"
CASE_PL = "(SELECT l_suppkey AS g, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS l, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"
CASE_OL = "(SELECT l_suppkey AS g, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"


def case_table(t):
    g = F.col("l_suppkey")
    return t.lineitem.select(g.alias("g")).distinct().select(
        "g",
        (F.col("g") % 4).cast("double").alias("alpha"),
        (F.col("g") % 2).cast("double").alias("beta"),
        F.when(F.col("g") % 3 == 0, "t").otherwise("N").alias("ta"),
        F.when(F.col("g") % 5 == 0, "C").otherwise("n").alias("tb"),
    )


def case_matrix(t, row, col, turned_every):
    """Quantity per supplier, row and column, transposed for every so manieth supplier (0: for none)."""
    row, col = F.col(row).cast("long"), F.col(col).cast("long")
    turned = F.col("l_suppkey") % turned_every == 0 if turned_every else F.lit(False)
    cells = t.lineitem.groupBy(
        F.col("l_suppkey").alias("g"), F.when(turned, col).otherwise(row).alias("i"), F.when(turned, row).otherwise(col).alias("j")
    )
    return cells.agg(F.sum("l_quantity").alias("v"))


def case_vector(t, position):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("g"), F.col(position).alias("k")).agg(F.sum("l_quantity").alias("v"))


@query(
    "keyed_gemv",
    f"""SELECT g, k, sum(v) AS v FROM (
          SELECT a.g, a.o AS k, a.g % 4 * a.v * x.v AS v FROM {CASE_OP} a
          JOIN (SELECT l_suppkey AS g, l_partkey AS p, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) x ON a.g = x.g AND a.p = x.p
          WHERE a.g % 4 <> 0
          UNION ALL SELECT l_suppkey, l_orderkey, l_quantity FROM lineitem WHERE l_suppkey % 2 = 1) s GROUP BY 1, 2""",
)
def keyed_gemv(t):
    cases = case_table(t).withColumnRenamed("ta", "trans")
    a = case_matrix(t, "l_orderkey", "l_partkey", 3)
    x, y = case_vector(t, "l_partkey"), case_vector(t, "l_orderkey")
    return M.keyed_gemv(cases, a, x, y, ["g"], M.tasks_for(t.lineitem.count()))


@query(
    "keyed_gemm",
    f"""SELECT g, i, j, sum(v) AS v FROM (
          SELECT a.g, a.o AS i, b.l AS j, a.g % 4 * a.v * b.v AS v
          FROM {CASE_OP} a JOIN {CASE_PL} b ON a.g = b.g AND a.p = b.p WHERE a.g % 4 <> 0
          UNION ALL SELECT g, o, l, v FROM {CASE_OL} c WHERE g % 2 = 1) s GROUP BY 1, 2, 3""",
)
def keyed_gemm(t):
    a = case_matrix(t, "l_orderkey", "l_partkey", 3)
    b = case_matrix(t, "l_partkey", "l_linenumber", 5)
    c = case_matrix(t, "l_orderkey", "l_linenumber", 0)
    return M.keyed_gemm(case_table(t), a, b, c, ["g"], M.tasks_for(t.lineitem.count()))


@query("transpose", f"SELECT j AS i, i AS j, v FROM {ORDER_PART}")
def transpose(t):
    return M.transpose(M.coalesce_coo(order_part(t)))


@query(
    "ger",
    f"""SELECT coalesce(a.i, o.i) AS i, coalesce(a.j, o.j) AS j, round(coalesce(a.v, 0) + coalesce(o.v, 0), 0) AS v
        FROM {TRADE} a FULL JOIN (SELECT x.k AS i, y.k AS j, 0.5 * x.v * y.v AS v FROM {BALANCE} x, {CBALANCE} y) o
        ON a.i = o.i AND a.j = o.j""",
)
def ger(t):
    return rounded(M.ger(0.5, balance(t), cbalance(t), trade(t), NATIONS), 0, "v")


@query("coalesce_coo", ORDER_PART[1:-1])
def coalesce_coo(t):
    return M.coalesce_coo(order_part(t))


VEC = "(SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings)"


@query(
    "colmajor_to_coo",
    f"SELECT vec_id, p % 8 + 1 AS i, p // 8 + 1 AS j, CAST(v AS DOUBLE) AS v FROM {VEC}",
)
def colmajor_to_coo(t):
    return M.colmajor_to_coo(t.embeddings, "embedding", 8, ["vec_id"])


@query(
    "coo_to_colmajor",
    f"""SELECT vec_id, slot, CASE WHEN slot % 8 <= slot // 8 THEN CAST(v AS DOUBLE) ELSE 0.0 END AS v
        FROM (SELECT vec_id, p AS slot, v FROM {VEC}) s""",
)
def coo_to_colmajor(t):
    """Upper triangle of every 8 x 8 embedding matrix, back in flat form."""
    upper = M.tri_view_keyed(M.colmajor_to_coo(t.embeddings, "embedding", 8, ["vec_id"]), "U")
    flat = M.coo_to_colmajor(upper, 8, 8, ["vec_id"])
    return flat.select("vec_id", F.posexplode("arr").alias("slot", "v")).withColumn("slot", F.col("slot").cast("long"))


@query(
    "packed_to_coo",
    f"""WITH cells AS (SELECT * FROM (SELECT vec_id, p, CAST(v AS DOUBLE) AS v FROM {VEC}
            UNION ALL SELECT vec_id, 64, CAST(label AS DOUBLE) FROM embeddings
            UNION ALL SELECT vec_id, 65, CAST(vec_id AS DOUBLE) FROM embeddings) c),
          up AS (SELECT row_number() OVER (ORDER BY j, i) - 1 AS p, i, j
                 FROM range(11) a(i), range(11) b(j) WHERE i <= j),
          lo AS (SELECT row_number() OVER (ORDER BY j, i) - 1 AS p, i, j
                 FROM range(11) a(i), range(11) b(j) WHERE i >= j)
        SELECT 'U' AS uplo, vec_id, i, j, v FROM cells JOIN up USING (p)
        UNION ALL SELECT 'L', vec_id, i, j, v FROM cells JOIN lo USING (p)""",
)
def packed_to_coo(t):
    extra = F.array(F.col("label").cast("double"), F.col("vec_id").cast("double"))
    packed = t.embeddings.select("vec_id", F.concat(F.col("embedding").cast("array<double>"), extra).alias("ap"))
    parts = [
        M.packed_to_coo(packed, "ap", 11, uplo, ["vec_id"]).select(F.lit(uplo).alias("uplo"), "vec_id", "i", "j", "v")
        for uplo in ("U", "L")
    ]
    return parts[0].unionByName(parts[1])


@query("band_view", f"SELECT i, j, v FROM {TRADE} WHERE j - i <= 2 AND i - j <= 1")
def band_view(t):
    return M.band_view(trade(t), 1, 2)


@query(
    "sym_view",
    f"SELECT i, j, v FROM {TRADE} WHERE i <= j UNION ALL SELECT j, i, v FROM {TRADE} WHERE i < j",
)
def sym_view(t):
    return M.sym_view(trade(t), "U")


@query(
    "tri_view",
    f"""SELECT i, j, v FROM {TRADE} WHERE i > j
        UNION ALL SELECT range AS i, range AS j, CAST(1 AS DOUBLE) FROM range({NATIONS})""",
)
def tri_view(t):
    return M.tri_view(trade(t), "L", unit=NATIONS)


def _mv(matrix: str, vec: str) -> str:
    return f"SELECT a.i AS k, round(sum(a.v * x.v), 2) AS v FROM ({matrix}) a JOIN {vec} x ON a.j = x.k GROUP BY 1"


SYM = f"SELECT i, j, v FROM {TRADE} WHERE i <= j UNION ALL SELECT j, i, v FROM {TRADE} WHERE i < j"
LOW = f"SELECT i, j, v FROM {TRADE} WHERE i >= j"
BAND = "j - i <= 2 AND i - j <= 2"


@query("trmv", _mv(LOW, BALANCE))
def trmv(t):
    return rounded(M.trmv(trade(t), balance(t), "L"), 2, "v")


@query(
    "trmm",
    f"SELECT a.i, b.j, round(2 * sum(a.v * b.v), 1) AS v FROM ({LOW}) a JOIN {TRADE} b ON a.j = b.i GROUP BY 1, 2",
)
def trmm(t):
    a = stored_trade(t)
    return rounded(M.trmm(a, a, alpha=2.0, side="L", uplo="L"), 1, "v")


@query(
    "symv",
    f"""SELECT k, round(sum(v), 2) AS v FROM (
          SELECT a.i AS k, a.v * x.v AS v FROM ({SYM}) a JOIN {BALANCE} x ON a.j = x.k
          UNION ALL SELECT k, 2 * v FROM {CBALANCE}) s GROUP BY 1""",
)
def symv(t):
    return rounded(M.symv(trade(t), balance(t), cbalance(t), 1.0, 2.0, "U"), 2, "v")


@query(
    "symm",
    f"""SELECT i, j, round(sum(v), 1) AS v FROM (
          SELECT b.i, a.j, b.v * a.v AS v FROM {TRADE} b JOIN ({SYM}) a ON b.j = a.i
          UNION ALL SELECT i, j, v FROM {TRADE}) s GROUP BY 1, 2""",
)
def symm(t):
    a = stored_trade(t)
    return rounded(M.symm(a, a, a, 1.0, 1.0, side="R", uplo="U"), 1, "v")


@query("gbmv", _mv(f"SELECT * FROM {TRADE} WHERE j - i <= 2 AND i - j <= 1", BALANCE))
def gbmv(t):
    return rounded(M.gbmv(trade(t), balance(t), 1, 2), 2, "v")


@query("sbmv", _mv(f"SELECT * FROM ({SYM}) WHERE {BAND}", BALANCE))
def sbmv(t):
    return rounded(M.sbmv(trade(t), balance(t), 2), 2, "v")


@query("spmv", _mv(SYM, BALANCE))
def spmv(t):
    packed = M.coo_to_packed(trade(t), NATIONS, "U")
    return rounded(M.spmv(packed, balance(t), NATIONS, uplo="U"), 2, "v")


@query("tbmv", _mv(f"SELECT * FROM ({LOW}) WHERE {BAND}", BALANCE))
def tbmv(t):
    return rounded(M.tbmv(trade(t), balance(t), 2, "L"), 2, "v")


@query("tpmv", _mv(LOW, BALANCE))
def tpmv(t):
    packed = M.coo_to_packed(trade(t), NATIONS, "L")
    return rounded(M.tpmv(packed, balance(t), NATIONS, "L"), 2, "v")


def _rank(pairs: str, keep: str) -> str:
    return f"""SELECT i, j, round(sum(v), 0) AS v FROM (
        SELECT i, j, v FROM {TRADE} WHERE {keep} UNION ALL SELECT * FROM ({pairs}) p WHERE {keep}) s GROUP BY 1, 2"""


SYR = f"SELECT x.k AS i, y.k AS j, 2 * x.v * y.v AS v FROM {BALANCE} x, {BALANCE} y"
SYR2 = f"""SELECT x.k AS i, y.k AS j, 2 * x.v * y.v AS v FROM {BALANCE} x, {CBALANCE} y
           UNION ALL SELECT y.k, x.k, 2 * x.v * y.v FROM {BALANCE} x, {CBALANCE} y"""
PACKED_U = "i + j * (j + 1) // 2"
PACKED_L = f"i + j * ({2 * NATIONS - 1} - j) // 2"


@query("syr", _rank(SYR, "i >= j"))
def syr(t):
    return rounded(M.syr(2.0, balance(t), trade(t), NATIONS, "L"), 0, "v")


@query("syr2", _rank(SYR2, "i <= j"))
def syr2(t):
    return rounded(M.syr2(2.0, balance(t), cbalance(t), trade(t), NATIONS, "U"), 0, "v")


@query("spr", f"SELECT CAST({PACKED_L} AS BIGINT) AS p, v FROM ({_rank(SYR, 'i >= j')}) r")
def spr(t):
    packed = M.coo_to_packed(trade(t), NATIONS, "L")
    return rounded(M.spr(2.0, balance(t), packed, NATIONS, "L"), 0, "v")


@query("spr2", f"SELECT CAST({PACKED_U} AS BIGINT) AS p, v FROM ({_rank(SYR2, 'i <= j')}) r")
def spr2(t):
    packed = M.coo_to_packed(trade(t), NATIONS, "U")
    return rounded(M.spr2(2.0, balance(t), cbalance(t), packed, NATIONS, "U"), 0, "v")


@query(
    "syrk",
    f"""SELECT i, j, round(sum(v), 1) AS v FROM (
          SELECT a.i, b.i AS j, a.v * b.v AS v FROM {TRADE} a JOIN {TRADE} b ON a.j = b.j WHERE a.i <= b.i
          UNION ALL SELECT i, j, 2 * v FROM {TRADE} WHERE i <= j) s GROUP BY 1, 2""",
)
def syrk(t):
    a = stored_trade(t)
    return rounded(M.syrk(a, a, 1.0, 2.0, "N", "U"), 1, "v")


@query(
    "syrk_gram",
    f"""SELECT CAST(a.p AS INTEGER) AS i, CAST(b.p AS INTEGER) AS j,
          round(sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)), 6) AS v
        FROM {VEC} a JOIN {VEC} b ON a.vec_id = b.vec_id AND a.p <= b.p GROUP BY 1, 2""",
)
def syrk_gram(t):
    return rounded(M.gram(t.embeddings, "embedding", 64), 6, "v")


@query(
    "syr2k",
    f"""SELECT i, j, round(sum(v), 1) AS v FROM (
          SELECT a.i, b.j, a.v * b.v AS v FROM {TRADE} a JOIN {TRADE} b ON a.j = b.i
          UNION ALL SELECT b.j, a.i, a.v * b.v FROM {TRADE} a JOIN {TRADE} b ON a.j = b.i) s
        WHERE i >= j GROUP BY 1, 2""",
)
def syr2k(t):
    """B is the transposed matrix, so A*B' is the square of A."""
    a = stored_trade(t)
    return rounded(M.syr2k(a, M.transpose(a), uplo="L"), 1, "v")
