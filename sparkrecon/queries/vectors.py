"""Vector operators over orders, lineitem, part and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrecon.operators import vectors as V
from sparkrecon.queries.registry import registrar, rounded

QUERIES: dict = {}
query = registrar(QUERIES)

# Vectors in SQL: x = signed price per order, t = order total, q = quantity per order.
X = "(SELECT l_orderkey AS k, sum(l_extendedprice - 30000) AS v FROM lineitem GROUP BY 1)"
T = "(SELECT o_orderkey AS k, o_totalprice AS v FROM orders)"
Q = "(SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1)"
# Complex vector: price per order as real part, order total as imaginary part.
Z = f"(SELECT t.k, x.v AS re, t.v AS im FROM {X} x JOIN {T} t USING (k))"
BOTH = f"(SELECT coalesce(x.k, t.k) AS k, coalesce(x.v, 0) AS x, coalesce(t.v, 0) AS y FROM {X} x FULL JOIN {T} t ON x.k = t.k)"


def x_of(t):
    return V.vector(t.lineitem, "l_orderkey", F.col("l_extendedprice") - 30000)


def t_of(t):
    return V.vector(t.orders, "o_orderkey", "o_totalprice")


def q_of(t):
    return V.vector(t.lineitem, "l_orderkey", "l_quantity")


def z_of(t):
    x, y = x_of(t).withColumnRenamed("v", "re"), t_of(t).withColumnRenamed("v", "im")
    return y.join(x, "k").select("k", "re", "im")


def by_supplier(t, value):
    """Grouped vector: one position per order within a supplier."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("k")).agg(
        F.sum(value).alias("v")
    )


G = "(SELECT l_suppkey AS g, l_orderkey AS k, sum({0}) AS v FROM lineitem GROUP BY 1, 2)"


@query("asum", f"SELECT round(sum(abs(v)), 2) AS asum FROM {X}")
def asum(t):
    return rounded(V.asum(x_of(t)), 2, "asum")


@query(
    "axpy",
    f"SELECT k, round(y - 2.5 * x, 3) AS v FROM {BOTH}",
)
def axpy(t):
    return rounded(V.axpy(-2.5, x_of(t), t_of(t)), 3, "v")


@query("copy", f"SELECT k, round(v, 2) AS v FROM {T}")
def copy(t):
    return rounded(V.copy(t_of(t)), 2, "v")


@query("swap", f"SELECT k, round(y, 2) AS x, round(x, 2) AS y FROM {BOTH}")
def swap(t):
    return rounded(V.swap(x_of(t), t_of(t)), 2, "x", "y")


@query("dot", f"SELECT round(sum(q.v * t.v), 0) AS dot FROM {Q} q JOIN {T} t USING (k)")
def dot(t):
    return rounded(V.dot(q_of(t), t_of(t)), 0, "dot")


@query(
    "dsdot",
    f"""SELECT round(sum(CAST(CAST(q.v AS REAL) AS DOUBLE) * CAST(CAST(t.v AS REAL) AS DOUBLE)), 0) AS dsdot
        FROM {Q} q JOIN {T} t USING (k)""",
)
def dsdot(t):
    return rounded(V.dsdot(q_of(t), t_of(t)), 0, "dsdot")


@query("nrm2", f"SELECT round(sqrt(sum(v * v)), 3) AS nrm2 FROM {X}")
def nrm2(t):
    return rounded(V.nrm2(x_of(t)), 3, "nrm2")


@query("rot", f"SELECT k, round(0.6 * x + 0.8 * y, 3) AS x, round(0.6 * y - 0.8 * x, 3) AS y FROM {BOTH}")
def rot(t):
    return rounded(V.rot(x_of(t), t_of(t), 0.6, 0.8), 3, "x", "y")


@query(
    "rotm",
    f"""SELECT flag, k,
          round(CASE flag WHEN -2 THEN x WHEN -1 THEN 0.5 * x - 0.25 * y WHEN 0 THEN x - 0.25 * y ELSE 0.5 * x + y END, 4) AS x,
          round(CASE flag WHEN -2 THEN y WHEN -1 THEN 2 * x + 1.5 * y WHEN 0 THEN 2 * x + y ELSE 1.5 * y - x END, 4) AS y
        FROM {BOTH}, (VALUES (-2), (-1), (0), (1)) AS f(flag)""",
)
def rotm(t):
    h = (0.5, 2.0, -0.25, 1.5)
    parts = [
        V.rotm(x_of(t), t_of(t), flag, h).select(F.lit(flag).alias("flag"), "k", "x", "y")
        for flag in (-2, -1, 0, 1)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out, 4, "x", "y")


@query("scal", f"SELECT k, round(0.5 * v, 3) AS v FROM {T}")
def scal(t):
    return rounded(V.scal(0.5, t_of(t)), 3, "v")


@query("zasum", f"SELECT round(sum(abs(re) + abs(im)), 2) AS zasum FROM {Z}")
def zasum(t):
    return rounded(V.zasum(z_of(t)), 2, "zasum")


@query("znrm2", f"SELECT round(sqrt(sum(re * re + im * im)), 3) AS znrm2 FROM {Z}")
def znrm2(t):
    return rounded(V.znrm2(z_of(t)), 3, "znrm2")


@query(
    "iamax",
    f"SELECT min(k) AS k FROM {X} WHERE round(abs(v), 2) = (SELECT max(round(abs(v), 2)) FROM {X})",
)
def iamax(t):
    return V.iamax(rounded(x_of(t), 2, "v"))


@query(
    "stride",
    f"""SELECT CAST(k // 3 AS BIGINT) AS k, round(v, 2) AS v FROM {T}
        WHERE k % 3 = 0 AND k // 3 < (SELECT count(*) FROM customer)""",
)
def stride(t):
    return rounded(V.stride(t_of(t), 3, t.customer.count()), 2, "v")


@query("grouped_asum", f"SELECT g, round(sum(abs(v)), 2) AS asum FROM {G.format('l_extendedprice - 30000')} GROUP BY g")
def grouped_asum(t):
    return rounded(V.grouped_asum(by_supplier(t, F.col("l_extendedprice") - 30000), "g"), 2, "asum")


@query("grouped_nrm2", f"SELECT g, round(sqrt(sum(v * v)), 3) AS nrm2 FROM {G.format('l_extendedprice')} GROUP BY g")
def grouped_nrm2(t):
    return rounded(V.grouped_nrm2(by_supplier(t, "l_extendedprice"), "g"), 3, "nrm2")


@query(
    "grouped_iamax",
    f"""SELECT g, min(k) AS k FROM
          (SELECT g, k, round(abs(v), 2) AS m, max(round(abs(v), 2)) OVER (PARTITION BY g) AS top
           FROM {G.format('l_extendedprice - 30000')}) s
        WHERE m = top GROUP BY g""",
)
def grouped_iamax(t):
    return V.grouped_iamax(rounded(by_supplier(t, F.col("l_extendedprice") - 30000), 2, "v"), "g")


@query(
    "grouped_dot",
    f"""SELECT g, round(sum(a.v * b.v), 2) AS dot
        FROM {G.format('l_quantity')} a JOIN {G.format('l_extendedprice')} b USING (g, k) GROUP BY g""",
)
def grouped_dot(t):
    return rounded(V.grouped_dot(by_supplier(t, "l_quantity"), by_supplier(t, "l_extendedprice"), "g"), 2, "dot")
