"""Scenario matrix: levels, expansion, sizes, overrides, generated inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.operators.catalogue import (
    BENCH_DIM_DEFAULTS,
    DIM_DEFAULTS,
    DIM_FALLBACK,
    KNOWN_LEVEL_1,
    KNOWN_LEVEL_2,
)
from sparkrecon.plans.joins import lookup_join

# Ranges of generated numbers.
SCALAR_RANGE = (0.5, 2.0)
ARRAY_RANGE = (-1.0, 1.0)

# Prime modulus and multipliers of the position hash.
HASH_PRIME = 2_147_483_647
HASH_A, HASH_B, HASH_C = 48_271, 16_807, 69_621
HASH_FOLD = 65_536

GENERATE_CHUNK = 65_536


def level_of(name: Column) -> Column:
    """1 or 2 for the known names, else 3."""
    lower = F.lower(name)
    return F.when(lower.isin(KNOWN_LEVEL_1), 1).when(lower.isin(KNOWN_LEVEL_2), 2).otherwise(3)


def classify_level(fns: DataFrame, key: str = "fn", levels: DataFrame | None = None) -> DataFrame:
    """Add ``level``. ``levels`` = ``(name, level)`` with lower-case names replaces the known names."""
    if levels is None:
        return fns.withColumn("level", level_of(F.col(key)))
    lookup = levels.select(F.col("name").alias("_name"), F.col("level"))
    return (
        lookup_join(fns.withColumn("_name", F.lower(key)), lookup, ["_name"], "left")
        .withColumn("level", F.coalesce("level", F.lit(3)))
        .drop("_name")
    )


def expand_matrix(fns: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every function with every scenario of its level."""
    return lookup_join(fns, scenarios, ["level"])


def default_dim(name: Column, bench: bool = False) -> Column:
    """Default size of an integer argument; the timing table wins in timing runs."""
    tables = [BENCH_DIM_DEFAULTS, DIM_DEFAULTS] if bench else [DIM_DEFAULTS]
    found = [_lookup(table, name) for table in tables]
    return F.coalesce(*found, F.lit(DIM_FALLBACK))


def _lookup(table: dict[str, int], name: Column) -> Column:
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), F.upper(name))


def assign_dims(args: DataFrame) -> DataFrame:
    """Sizes of the scalar integer arguments of ``(…, arg, ftype, dims)`` rows."""
    scalars = args.filter((F.col("ftype") == "INTEGER") & (F.size("dims") == 0))
    return scalars.withColumn("base", default_dim(F.col("arg"))).withColumn(
        "bench", default_dim(F.col("arg"), bench=True)
    )


def override_dims(base: Column, over: Column) -> Column:
    """Sizes: the override wins and may add names."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)


def override_floats(base: Column, over: Column) -> Column:
    """Scalars: an override counts only for a name that is already there."""
    return F.transform_values(base, lambda k, v: F.coalesce(F.try_element_at(over, k), v))


def override_chars(names: Column, over: Column) -> Column:
    """Flags: the override, or 'N'."""
    values = F.transform(names, lambda n: F.coalesce(F.try_element_at(over, n), F.lit("N")))
    return F.map_from_arrays(names, values)


def apply_overrides(df: DataFrame) -> DataFrame:
    """Merge scenario overrides into ``dims``, ``floats`` and ``chars`` (array of names)."""
    return (
        df.withColumn("dims", override_dims(F.col("dims"), F.col("dim_overrides")))
        .withColumn("floats", override_floats(F.col("floats"), F.col("float_overrides")))
        .withColumn("chars", override_chars(F.col("chars"), F.col("char_overrides")))
    )


def resolve_dim(dim: Column, assigned: Column, fallback: Column) -> Column:
    """``*`` is the fallback, then a known name, then digits, else the fallback."""
    key = F.upper(F.trim(dim))
    return F.when(key == "*", fallback).otherwise(
        F.coalesce(F.try_element_at(assigned, key), key.try_cast("int"), fallback)
    )


def array_size(
    dims: Column, assigned: Column, fallback: Column | None = None, least: Column | None = None
) -> Column:
    """Number of elements of an array argument; ``least`` is a lower bound, as strides need."""
    fallback = F.lit(DIM_FALLBACK) if fallback is None else fallback
    total = F.aggregate(
        dims,
        F.lit(1).cast("long"),
        lambda acc, d: acc * resolve_dim(d, assigned, fallback).cast("long"),
    )
    return total if least is None else F.greatest(total, least)


def strided_length(n: Column, inc: Column) -> Column:
    """Elements a vector of ``n`` values with step ``inc`` spans."""
    return F.when(n <= 0, 0).otherwise(1 + (n - 1) * F.abs(inc))


def position_hash(seed: Column, arg: Column, pos: Column) -> Column:
    """Repeatable number in [0, 2^31-1) from integer arithmetic alone."""
    prime = F.lit(HASH_PRIME).cast("long")

    def folded(c: Column) -> Column:
        return F.pmod(c.cast("long"), prime)

    def stirred(h: Column) -> Column:
        return ((h * (h % HASH_FOLD + 1)) % prime * HASH_A) % prime

    # seed and argument choose a multiplier of their own, so no two walk the same sequence
    own = stirred((folded(seed) * HASH_A + folded(arg) * HASH_B + 1) % prime)
    place = folded(pos)
    return stirred((own * (place % HASH_FOLD + 1) + place * HASH_C + own) % prime)


def uniform(seed: Column, arg: Column, pos: Column, low: float, high: float) -> Column:
    return F.lit(low) + F.lit(high - low) * (
        position_hash(seed, arg, pos).cast("double") / F.lit(float(HASH_PRIME))
    )


def generate_dataset(specs: DataFrame, keys: list[str], chunk: int = GENERATE_CHUNK) -> DataFrame:
    """Input values for ``(keys, seed, arg_ord, kind, size)`` rows, one row per number.

    ``kind`` is scalar or array; another kind, or an array without a size, is an error. Long arrays are first cut into
    chunks of positions and the chunks are spread over the cluster, so one large array is not generated by one task.
    The same seed always gives the same numbers.
    """
    kind, wrong = F.col("kind"), lambda text: F.raise_error(F.concat(F.lit(text), F.col("arg_ord"))).cast("long")
    sized = F.when(F.col("size").isNull(), wrong("array without a size: argument ")).otherwise(F.col("size").cast("long"))
    length = (
        F.when(kind == "scalar", F.lit(1).cast("long"))
        .when(kind == "array", sized)
        .otherwise(wrong("unknown kind of argument "))
    )
    cells = _positions(specs.select(*keys, "seed", "arg_ord", "kind", length.alias("_len")), keys, chunk)
    value = F.when(kind == "scalar", _uniform_scalar()).otherwise(_uniform_array())
    return cells.select(*keys, "arg_ord", "pos", value.alias("v"))


def _uniform_scalar() -> Column:
    return uniform(F.col("seed"), F.col("arg_ord"), F.col("pos"), *SCALAR_RANGE)


def _uniform_array() -> Column:
    return uniform(F.col("seed"), F.col("arg_ord"), F.col("pos"), *ARRAY_RANGE)


def _positions(sized: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """``pos`` from 0 up to ``_len``, dealt over the cluster in chunks of an argument."""
    last_chunk = F.floor((F.col("_len") - 1) / F.lit(chunk)).cast("long")
    chunked = sized.filter(F.col("_len") > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk))
    )
    spread = chunked.repartition(*keys, "arg_ord", "_chunk")
    first = F.col("_chunk") * chunk
    last = F.least(first + chunk, F.col("_len")) - 1
    return spread.withColumn("pos", F.explode(F.sequence(first, last)))


# Declared types by kind of value, and the flag a character argument holds.
REAL_TYPES, INTEGER_TYPE, CHARACTER_TYPE, LOGICAL_TYPE = ("DOUBLE PRECISION", "REAL"), "INTEGER", "CHARACTER", "LOGICAL"
FLAG_VALUE = "N"


def generate_inputs(
    args: DataFrame,
    keys: list[str],
    star_fallback: int = DIM_FALLBACK,
    chunk: int = GENERATE_CHUNK,
) -> DataFrame:
    """Values of every declared argument, as one typed table ``(keys, arg_ord, arg, kind, pos, dbl, int, chr, bool)``.

    ``args`` has ``(keys, seed, arg_ord, arg, ftype, dims, assigned)``: declarations as ``declarations`` reads them
    and the assigned sizes by upper-case name, and optionally ``floats``, a map of scalars that replace the drawn ones.

    * a real scalar is drawn from [0.5, 2), the entries of a real array from [-1, 1); an array has the product of
      its dimensions as entries, ``*`` and unknown names standing for ``star_fallback``;
    * an integer scalar is its assigned size, or 4; a character scalar is 'N'; a logical scalar is false;
    * other arrays get no value: one row of kind ``none``; a real array of no entries is one row without position;
    * any other type is an error.

    Every argument has at least one row. Long arrays are generated in chunks by many tasks.
    """
    ftype, array = F.upper("ftype"), F.size("dims") > 0
    known = ftype.isin(*REAL_TYPES, INTEGER_TYPE, CHARACTER_TYPE, LOGICAL_TYPE)
    unknown = F.raise_error(F.concat(F.lit("no values for type "), F.coalesce("ftype", F.lit("null")))).cast("string")
    kind = (
        F.when(~F.coalesce(known, F.lit(False)), unknown)
        .when(ftype.isin(*REAL_TYPES), F.when(array, "reals").otherwise("real"))
        .when(array, "none")
        .when(ftype == INTEGER_TYPE, "integer")
        .when(ftype == CHARACTER_TYPE, "character")
        .otherwise("logical")
    )
    given = F.try_element_at("floats", F.upper("arg")) if "floats" in args.columns else F.lit(None).cast("double")
    size = array_size(F.col("dims"), F.col("assigned"), F.lit(star_fallback))
    typed = args.select(
        *keys,
        "seed",
        "arg_ord",
        "arg",
        kind.alias("kind"),
        F.when(array, size).otherwise(1).cast("long").alias("_len"),
        F.coalesce(F.try_element_at("assigned", F.upper("arg")), F.lit(DIM_FALLBACK)).cast("int").alias("_size"),
        given.cast("double").alias("_given"),
    )
    filled = (F.col("kind") == "reals") & (F.col("_len") > 0)
    null = {"pos": "long", "dbl": "double", "int": "int", "chr": "string", "bool": "boolean"}
    shape = [*keys, "arg_ord", "arg", "kind"]

    def rows(df: DataFrame, **values: Column) -> DataFrame:
        cells = [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in null.items()]
        return df.select(*shape, *cells)

    kind_, placed = F.col("kind"), typed.filter(~filled).withColumn("pos", F.lit(0).cast("long"))
    drawn = F.coalesce("_given", _uniform_scalar())
    single = rows(
        placed,
        pos=F.when(~kind_.isin("none", "reals"), 0),
        dbl=F.when(kind_ == "real", drawn),
        int=F.when(kind_ == "integer", F.col("_size")),
        chr=F.when(kind_ == "character", FLAG_VALUE),
        bool=F.when(kind_ == "logical", False),
    )
    many = _positions(typed.filter(filled), keys, chunk)
    return single.unionByName(rows(many, pos=F.col("pos"), dbl=_uniform_array()))


def real_values(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """What a value file holds of :func:`generate_inputs`: ``(keys, arg_ord, pos, v)`` of the real arguments."""
    reals = inputs.filter(F.col("kind").isin("real", "reals") & F.col("pos").isNotNull())
    return reals.select(*keys, "arg_ord", "pos", F.col("dbl").alias("v"))
