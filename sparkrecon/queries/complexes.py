"""Complex vector and matrix operators over orders, lineitem, part and the nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrecon.functions.rotations import rotg as rotation
from sparkrecon.operators import complexes as C
from sparkrecon.operators.matrices import tasks_for
from sparkrecon.queries.registry import registrar, rounded

QUERIES: dict = {}
query = registrar(QUERIES)

NATIONS = 25
# Rounding leaves every digit that sums of prices, taxes and quantities have, so no tie is cut.
# Per order: Z = price and total in thousands, W = quantity and minus a tenth of the share of tax.
Z = """(SELECT coalesce(l.k, o_orderkey) AS k, coalesce(l.re, 0) AS re, coalesce(o_totalprice, 0) / 1000 AS im
  FROM (SELECT l_orderkey AS k, sum(l_extendedprice) / 1000 AS re FROM lineitem GROUP BY 1) l
  FULL JOIN orders ON l.k = o_orderkey)"""
W = "(SELECT l_orderkey AS k, sum(l_quantity) AS re, -sum(l_tax) AS im FROM lineitem GROUP BY 1)"
# Order x part: quantity and discount. Order x nation of the supplier: quantity and tax.
OP = "(SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS re, sum(l_discount) AS im FROM lineitem GROUP BY 1, 2)"
ON = """(SELECT l_orderkey AS i, CAST(s_nationkey AS BIGINT) AS j, sum(l_quantity) AS re, sum(l_tax) AS im
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
P = "(SELECT p_partkey AS k, p_retailprice / 1000 AS re, CAST(p_size AS DOUBLE) / 10 AS im FROM part)"
# Per nation: balances in thousands and counts, of suppliers and customers.
NS = "(SELECT CAST(s_nationkey AS BIGINT) AS k, sum(s_acctbal) / 1000 AS re, CAST(count(*) AS DOUBLE) AS im FROM supplier GROUP BY 1)"
NC = "(SELECT CAST(c_nationkey AS BIGINT) AS k, sum(c_acctbal) / 1000 AS re, CAST(count(*) AS DOUBLE) AS im FROM customer GROUP BY 1)"


def z_of(t):
    prices = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_extendedprice") / 1000).alias("re"), F.lit(0.0).alias("im"))
    totals = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(0.0).alias("re"), (F.col("o_totalprice") / 1000).alias("im"))
    return prices.unionByName(totals).groupBy("k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def w_of(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("re"), (-F.sum("l_tax")).alias("im"))


def order_part(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("re"), F.col("l_discount").alias("im")
    )


def order_nation(t, tasks=None):
    joined = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    keyed = joined.select(F.col("l_orderkey").alias("i"), F.col("s_nationkey").cast("long").alias("j"), "l_quantity", "l_tax")
    # the keys of the groups as they are, or Spark deals the rows anew
    keyed = keyed if tasks is None else keyed.repartition(tasks, "i", "j")
    return keyed.groupBy("i", "j").agg(F.sum("l_quantity").alias("re"), F.sum("l_tax").alias("im"))


def parts(t):
    return t.part.select(
        F.col("p_partkey").alias("k"), (F.col("p_retailprice") / 1000).alias("re"), (F.col("p_size").cast("double") / 10).alias("im")
    )


def balances(df, nation, balance):
    return df.groupBy(F.col(nation).cast("long").alias("k")).agg(
        (F.sum(balance) / 1000).alias("re"), F.count(F.lit(1)).cast("double").alias("im")
    )


def suppliers(t):
    return balances(t.supplier, "s_nationkey", "s_acctbal")


def customers(t):
    return balances(t.customer, "c_nationkey", "c_acctbal")


def product(t):
    """Nation x nation: the Hermitian product of order x nation with itself."""
    a = order_nation(t)
    return C.zgemm(a, a, ta="C")


# (a.re - i a.im)(b.re + i b.im) added up per pair of nations
PRODUCT = f"""(SELECT a.j AS i, b.j AS j, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im
  FROM {ON} a JOIN {ON} b ON a.i = b.i GROUP BY 1, 2)"""


@query("zscal", f"SELECT k, round(0.5 * re + 2 * im, 7) AS re, round(0.5 * im - 2 * re, 7) AS im FROM {Z}")
def zscal(t):
    return rounded(C.zscal(0.5 - 2j, z_of(t)), 7, "re", "im")


@query(
    "zaxpy",
    f"""SELECT k, round(sum(re), 6) AS re, round(sum(im), 6) AS im FROM (
          SELECT k, 1.5 * re - 0.5 * im AS re, 1.5 * im + 0.5 * re AS im FROM {W}
          UNION ALL SELECT k, re, im FROM {Z}) s GROUP BY 1""",
)
def zaxpy(t):
    return rounded(C.zaxpy(1.5 + 0.5j, w_of(t), z_of(t)), 6, "re", "im")


@query(
    "zdotu",
    f"""SELECT round(sum(w.re * z.re - w.im * z.im), 1) AS re, round(sum(w.re * z.im + w.im * z.re), 1) AS im
        FROM {W} w JOIN {Z} z USING (k)""",
)
def zdotu(t):
    return rounded(C.zdotu(w_of(t), z_of(t)), 1, "re", "im")


@query(
    "zdotc",
    f"""SELECT round(sum(w.re * z.re + w.im * z.im), 1) AS re, round(sum(w.re * z.im - w.im * z.re), 1) AS im
        FROM {W} w JOIN {Z} z USING (k)""",
)
def zdotc(t):
    return rounded(C.zdotc(w_of(t), z_of(t)), 1, "re", "im")


@query("izamax", f"SELECT k FROM {Z} ORDER BY round(abs(re) + abs(im), 5) DESC, k LIMIT 1")
def izamax(t):
    return C.izamax(rounded(z_of(t), 6, "re", "im"))


@query(
    "zgemv",
    f"""SELECT k, round(sum(re), 8) AS re, round(sum(im), 8) AS im FROM (
          SELECT a.i AS k, a.im * p.re + a.re * p.im AS re, a.im * p.im - a.re * p.re AS im FROM {OP} a JOIN {P} p ON a.j = p.k
          UNION ALL SELECT k, 2 * re, 2 * im FROM {Z}) s GROUP BY 1""",
)
def zgemv(t):
    """Times -i, plus twice the totals."""
    return rounded(C.zgemv(order_part(t), parts(t), z_of(t), alpha=-1j, beta=2), 8, "re", "im")


@query(
    "zgemv_conjugate",
    f"""SELECT a.j AS k, round(sum(a.re * z.re + a.im * z.im), 8) AS re, round(sum(a.re * z.im - a.im * z.re), 8) AS im
        FROM {OP} a JOIN {Z} z ON a.i = z.k GROUP BY 1""",
)
def zgemv_conjugate(t):
    return rounded(C.zgemv(order_part(t), z_of(t), trans="C", hot_rows=1000), 8, "re", "im")


@query(
    "zgemm_conjugate",
    f"""SELECT i, j, round(sum(re), 1) AS re, round(sum(im), 1) AS im FROM (
          SELECT i, j, -im AS re, re AS im FROM {PRODUCT} p
          UNION ALL SELECT s.k, c.k, 3 * s.re * c.re, 3 * s.re * c.im FROM {NS} s CROSS JOIN {NC} c) u GROUP BY 1, 2""",
)
def zgemm_conjugate(t):
    """i * A^H A plus three times a nation x nation matrix of balances."""
    a = order_nation(t)
    none = customers(t).limit(0).select(F.col("k").alias("i"), F.col("k").alias("j"), "re", "im")
    real = suppliers(t).withColumn("im", F.lit(0.0))
    c = C.zgeru(1, real, customers(t), none, NATIONS)
    return rounded(C.zgemm(a, a, c, alpha=1j, beta=3, ta="C"), 1, "re", "im")


@query("zgemm_tiles", f"SELECT i, j, round(re, 5) AS re, round(im, 5) AS im FROM {PRODUCT} p")
def zgemm_tiles(t):
    tasks = tasks_for(t.lineitem.count())
    a = order_nation(t, tasks)
    return rounded(C.zgemm(a, a, ta="C", tile=64, tasks=tasks), 5, "re", "im")


@query(
    "zhemv",
    f"""SELECT p.i AS k, round(sum(p.re * c.re - p.im * c.im), 0) AS re, round(sum(p.re * c.im + p.im * c.re), 0) AS im
        FROM (SELECT i, j, re, CASE WHEN i = j THEN 0 ELSE im END AS im FROM {PRODUCT} q) p JOIN {NC} c ON p.j = c.k GROUP BY 1""",
)
def zhemv(t):
    """The upper triangle stands for the whole matrix."""
    return rounded(C.zhemv(product(t).filter("i <= j"), customers(t), uplo="U"), 0, "re", "im")


def _rank(terms: str, triangle: str = "true") -> str:
    return f"""SELECT i, j, round(sum(re), 1) AS re, round(sum(CASE WHEN {triangle} AND i = j AND '{triangle}' <> 'true' THEN 0 ELSE im END), 1) AS im
        FROM (SELECT i, j, re, im FROM {PRODUCT} p UNION ALL {terms}) u WHERE {triangle} GROUP BY 1, 2"""


@query(
    "zgeru",
    _rank(
        f"""SELECT s.k, c.k, 2 * (s.re * c.re - s.im * c.im) - (s.re * c.im + s.im * c.re),
                   2 * (s.re * c.im + s.im * c.re) + (s.re * c.re - s.im * c.im) FROM {NS} s CROSS JOIN {NC} c"""
    ),
)
def zgeru(t):
    return rounded(C.zgeru(2 + 1j, suppliers(t), customers(t), product(t), NATIONS), 1, "re", "im")


@query(
    "zgerc",
    _rank(f"SELECT s.k, c.k, s.re * c.re + s.im * c.im, s.im * c.re - s.re * c.im FROM {NS} s CROSS JOIN {NC} c"),
)
def zgerc(t):
    return rounded(C.zgerc(1, suppliers(t), customers(t), product(t), NATIONS), 1, "re", "im")


@query(
    "zher",
    _rank(
        f"SELECT s.k, c.k, 2 * (s.re * c.re + s.im * c.im), 2 * (s.im * c.re - s.re * c.im) FROM {NC} s CROSS JOIN {NC} c", "i >= j"
    ),
)
def zher(t):
    return rounded(C.zher(2.0, customers(t), product(t), NATIONS, "L"), 1, "re", "im")


@query(
    "zher2",
    _rank(
        f"""SELECT s.k, c.k, s.re * c.im - s.im * c.re, s.re * c.re + s.im * c.im FROM {NS} s CROSS JOIN {NC} c
            UNION ALL SELECT c.k, s.k, c.im * s.re - c.re * s.im, -(c.re * s.re + c.im * s.im) FROM {NS} s CROSS JOIN {NC} c""",
        "i <= j",
    ),
)
def zher2(t):
    """alpha = i: the second term goes with -i."""
    return rounded(C.zher2(1j, suppliers(t), customers(t), product(t), NATIONS, "U"), 1, "re", "im")


# A pair per order: price above or below 30,000 and total above or below 100,000.
PAIRS = "(SELECT l_orderkey AS k, sum(l_extendedprice - 30000) AS a FROM lineitem GROUP BY 1) l JOIN orders ON k = o_orderkey"


@query(
    "rotg",
    f"""SELECT k, round(r, 2) AS r, round(a / r, 6) AS c, round(b / r, 6) AS s,
               round(CASE WHEN abs(a) > abs(b) THEN b / r WHEN abs(a) > 0 THEN r / a ELSE 1 END, 3) AS z
        FROM (SELECT k, a, b, sqrt(a * a + b * b) * CASE WHEN (CASE WHEN abs(a) > abs(b) THEN a ELSE b END) < 0 THEN -1 ELSE 1 END AS r
              FROM (SELECT k, a, o_totalprice - 100000 AS b FROM {PAIRS}) p) q""",
)
def rotg(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") - 30000).alias("a"))
    pairs = a.join(t.orders, F.col("k") == F.col("o_orderkey"))
    out = pairs.select("k", rotation(F.col("a"), F.col("o_totalprice") - 100000).alias("g")).select("k", "g.*")
    return rounded(rounded(rounded(out, 2, "r"), 6, "c", "s"), 3, "z")
