"""Near duplicates by SuperMinHash signatures, banding, verification on whole sets and union-find.

A document's set holds its distinct 5-word shingles (64-bit hashes; words lower-cased in A-Z). Two documents link when
their Jaccard similarity is at least 17/20, tested on whole sets.

1. Signature of ``REGISTERS`` registers: each shingle walks its own random permutation of the registers; its j-th step
   offers ``j + u`` (u uniform) to the j-th register of the permutation, which keeps the least offer. A set is done
   when every register holds an offer of a finished step, as later steps only offer more: about
   ``max(n, m ln m)`` offers for n shingles instead of n * m.
2. Equal sets form a class, a node of the graph. Nodes are numbered when they are stored; only nodes go on.
3. ``BANDS`` bands of ``ROWS`` registers. At similarity 0.85 a pair shares 16.7 of the 32 bands on average, and none
   with a probability of 5e-11. A bucket's least node is its hub; all nodes that share a bucket with a hub are its group.
4. Each node meets its hubs: likely by signature, then exactly on whole sets. Components of these links settle
   most groups: all in one component.
5. Groups that still hold several components are compared in full, first by signature alone, which only keeps
   nodes with a likely partner in another component, then on whole sets with union-find: a pair that is already
   connected is not compared, and only links that connect something new leave a task. A group above ``GROUP`` is dealt into
   blocks that meet pairwise.

Pairs below ``LIKELY`` agreeing registers are taken as not linked: at similarity 0.85 that is 6 standard deviations away
(1e-9 with independent registers, less with these). All that is kept or linked is tested exactly.

Null texts and texts without words link with nothing; rows without an id get no component and are kept; repeated
ids are one component; an empty table gives an empty result. Very long texts make long sets, moved as one binary cell
each. Only ``doc_id`` and ``text`` are read, so further columns change nothing, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.components import components
from sparkrecon.llm.id_table import id_table, marked
from sparkrecon.llm.ngram_join import shingles
from sparkrecon.llm.words import Texts, chunks, column, mix, row_of, texts_of
from sparkrecon.plans.lineage import scratch_path

REGISTERS, BANDS, ROWS = 128, 32, 4
PERCENT = 85
LIKELY = 0.66
GROUP = 512
#: Shingles of the documents of one block, so that a task's sets stay within some tens of MB.
GROUP_SHINGLES = 1_000_000
#: Permutation cells held at once.
CELLS = 1 << 22
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.uint64(0xD6E8FEB86659FD93)
_OTHER = np.uint64(0xA0761D6478BD642F)
_NONE = np.iinfo(np.uint64).max


def set_hashes(x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and offsets of the texts into them."""
    grams, at = shingles(x)
    row = row_of(at)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[first], row[first]
    return grams, np.searchsorted(row, np.arange(x.n + 1))


def signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set: the step in the top 8 bits of a register, the uniform part below.

    Registers of an empty set hold the largest number.
    """
    m, sizes = REGISTERS, np.diff(at)
    out = np.full((len(sizes), m), _NONE, np.uint64)
    state, row = mix(grams ^ _SEED), row_of(at)
    _offer(out, state, row, 0, state % np.uint64(m))
    # a set that is unfinished after its first step has few shingles for its registers
    left = np.flatnonzero((out == _NONE).any(axis=1) & (sizes > 0))
    block = np.cumsum(sizes[left]) // max(1, CELLS // m)
    for cut in np.split(left, np.flatnonzero(np.diff(block)) + 1) if len(left) else []:
        own = np.concatenate([np.arange(at[i], at[i + 1]) for i in cut])
        _walk(out, state[own], row[own], cut)
    return out


def _offer(out: np.ndarray, state: np.ndarray, row: np.ndarray, step: int, register: np.ndarray) -> None:
    value = (np.uint64(step) << np.uint64(56)) | (mix(state + _STEP) >> np.uint64(8))
    np.minimum.at(out.reshape(-1), row * REGISTERS + register.astype(np.int64), value)


def _walk(out: np.ndarray, state: np.ndarray, row: np.ndarray, rows: np.ndarray) -> None:
    """Steps after the first, by Fisher-Yates on a row of registers per shingle."""
    m = REGISTERS
    cells = np.tile(np.arange(m, dtype=np.uint8), (len(state), 1))
    every = np.arange(len(state))
    register = (state % np.uint64(m)).astype(np.int64)
    cells[every, register], cells[every, 0] = cells[every, 0], register
    going = np.zeros(len(out), dtype=bool)
    for step in range(1, m):
        state = mix(state + _STEP + np.uint64(step))
        other = step + (state % np.uint64(m - step)).astype(np.int64)
        register = cells[every, other]
        cells[every, other] = cells[every, step]
        _offer(out, state, row, step, register)
        open_ = (out[rows] == _NONE).any(axis=1)
        if not open_.all():
            rows = rows[open_]
            if not len(rows):
                return
            going[:] = False
            going[rows] = True
            keep = going[row]
            state, row, cells = state[keep], row[keep], cells[keep]
            every = np.arange(len(state))


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band."""
    parts = signature.reshape(-1, BANDS, ROWS)
    h = np.zeros(parts.shape[:2], np.uint64)
    for r in range(ROWS):
        h = mix(h * _STEP + parts[:, :, r])
    return mix(h + np.arange(1, BANDS + 1, dtype=np.uint64) * _OTHER)


def linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= PERCENT * (a + b - overlap)


def _digests(grams: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    out = []
    for seed in (_SEED, _OTHER):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams ^ seed), out=total[1:])
        out.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64), pa.int64()))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest h1, h2 of the set, keys of the bands, one byte per register."""

    def run(batches):
        for batch in batches:
            for piece in chunks(batch):
                x = texts_of(column(piece, "text"))
                grams, at = set_hashes(x)
                signature = signatures(grams, at)
                keys = bands(signature).view(np.int64)
                marks = mix(signature).astype(np.uint8)
                ends = pa.array(np.arange(x.n + 1, dtype=np.int32) * BANDS, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        column(piece, "doc_id").cast(pa.int64()),
                        pa.array(np.diff(at), pa.int64()),
                        *_digests(grams, at),
                        pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1), pa.int64())),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                    ],
                    ["doc_id", "n", "h1", "h2", "bands", "marks"],
                )

    schema = "doc_id long, n long, h1 long, h2 long, bands array<long>, marks binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes as bytes, for ``wanted`` (node, rep, h1, h2, n).

    A fixed-size bit table of ids keeps most other sets from being moved; the join decides.
    """
    bits, table = id_table(wanted.select(F.col("rep").alias("id")))

    def run(batches):
        for batch in batches:
            for piece in chunks(batch.filter(marked(column(batch, "doc_id"), table.value, bits))):
                grams, at = set_hashes(texts_of(column(piece, "text")))
                blobs = [grams[a:b].astype("<u8").tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        column(piece, "doc_id").cast(pa.int64()),
                        pa.array(np.diff(at), pa.int64()),
                        *_digests(grams, at),
                        pa.array(blobs, pa.binary()),
                    ],
                    ["rep", "n", "h1", "h2", "keys"],
                )

    made = docs.select("doc_id", "text").mapInArrow(run, "rep long, n long, h1 long, h2 long, keys binary")
    # a row that stands in the table twice has its set once
    once = made.filter("rep is not null").groupBy("rep", "h1", "h2", "n").agg(F.min("keys").alias("keys"))
    return once.join(wanted.hint("merge"), ["rep", "h1", "h2", "n"]).select("node", "keys")


def _keys(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u8")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[place] == a).sum())


def alike(a: bytes, b: bytes) -> float:
    """Share of registers that agree."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def _stored(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, f"super-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hub_groups(nodes: DataFrame) -> DataFrame:
    """Distinct hub, node (the hub itself too): nodes that share a bucket whose least node is the hub."""
    seats = nodes.select(F.explode("bands").alias("key"), "node")
    # partial aggregates: a key that a third of all rows has is one row per task
    hubs = seats.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
    return seats.join(hubs.select("key", "hub").hint("merge"), "key").select("hub", "node").distinct()


def hub_links(groups: DataFrame, marked: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges a, b: nodes that link with their hub."""

    def likely(batches):
        for batch in batches:
            agree = [alike(a, b) >= LIKELY for a, b in zip(column(batch, "m").to_pylist(), column(batch, "hub_m").to_pylist())]
            yield batch.filter(pa.array(agree, pa.bool_())).select(["hub", "node"])

    def exact(batches):
        for batch in batches:
            good = []
            for one, two in zip(column(batch, "keys"), column(batch, "hub_keys")):
                a, b = _keys(one.as_py()), _keys(two.as_py())
                good.append(linked(overlap(a, b), len(a), len(b)))
            yield batch.filter(pa.array(good, pa.bool_())).select(["hub", "node"]).rename_columns(["a", "b"])

    own = marked.select("node", F.col("marks").alias("m"), F.col("n").alias("size"))
    of_hub = own.select(F.col("node").alias("hub"), F.col("m").alias("hub_m"), F.col("size").alias("hub_size"))
    near = (100 * F.col("size") >= PERCENT * F.col("hub_size")) & (100 * F.col("hub_size") >= PERCENT * F.col("size"))
    both = groups.filter("hub < node").join(own, "node").join(of_hub, "hub").filter(near)
    promising = both.select("hub", "node", "m", "hub_m").mapInArrow(likely, "hub long, node long")
    hub_sets = sets.select(F.col("node").alias("hub"), F.col("keys").alias("hub_keys"))
    return promising.join(sets, "node").join(hub_sets, "hub").mapInArrow(exact, "a long, b long")


class Forest:
    """Union-find over the members of one task; each starts in the component it is known to be in."""

    def __init__(self, known: list[int]):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(c, i) for i, c in enumerate(known)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))])


class Members:
    """Nodes of one task, by size: signatures, sizes, components so far, and the block each is from."""

    def __init__(self, table: pa.Table):
        size = np.array(table.column("n").to_pylist())
        self.order = np.lexsort((np.array(table.column("node").to_pylist()), size))
        picked = table.take(pa.array(self.order))
        self.node, self.size = picked.column("node").to_pylist(), size[self.order]
        self.known = picked.column("c").to_pylist()
        self.own = np.array(picked.column("own").to_pylist())
        self.signs = np.frombuffer(b"".join(picked.column("marks").to_pylist()), np.uint8).reshape(len(self.node), -1)
        self.table = picked

    def likely(self, i: int, component: np.ndarray, across: bool) -> np.ndarray:
        """Members before ``i`` that may link with it: other component, near in size, alike in signature.

        With ``across`` only members of the other block count.
        """
        begin = int(np.searchsorted(100 * self.size, PERCENT * self.size[i]))
        near = begin + np.flatnonzero(component[begin:i] != component[i])
        if across:
            near = near[self.own[near] != self.own[i]]
        agree = np.count_nonzero(self.signs[near] == self.signs[i], axis=1)
        return near[agree >= LIKELY * REGISTERS]


def hopeful(members: Members, across: bool) -> list[int]:
    """Members with a likely partner in another component."""
    component = np.unique(np.array(members.known), return_inverse=True)[1]
    some = np.zeros(len(members.node), dtype=bool)
    for i in range(1, len(some)):
        found = members.likely(i, component, across)
        some[found] = True
        some[i] |= len(found) > 0
    return np.flatnonzero(some).tolist()


def connect(members: Members, across: bool) -> list[tuple[int, int]]:
    """Links that connect components, tested on whole sets."""
    forest = Forest(members.known)
    sets = [_keys(b) for b in members.table.column("keys").to_pylist()]
    found = []
    for i in range(1, len(sets)):
        for j in members.likely(i, forest.roots(), across).tolist():
            if forest.find(i) != forest.find(j) and linked(overlap(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                forest.join(i, j)
                found.append((members.node[j], members.node[i]))
    return found


def _dealt(seats: DataFrame) -> DataFrame:
    """Seats (hub, node, c, n) of groups with several components, in blocks; a row per block that a seat meets.

    (low, high) names the meeting of two blocks of a group, ``own`` the block of the row.
    """
    sums = seats.groupBy("hub").agg(
        F.min("c").alias("first"), F.max("c").alias("last"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")
    )
    blocks = F.ceil(F.greatest(F.col("size") / GROUP, F.col("shingles") / GROUP_SHINGLES)).cast("int")
    mixed = sums.filter("first < last").select("hub", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = seats.join(mixed, "hub").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "hub", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "c", "n", "own"
    )


def group_links(seats: DataFrame, marked: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges a, b that connect the components within each group; ``seats`` has hub, node, c."""

    def by_signature(keys, table):
        members = Members(table)
        some = hopeful(members, keys[1].as_py() != keys[2].as_py())
        return pa.table({"hub": pa.array([keys[0].as_py()] * len(some), pa.int64()), "node": pa.array([members.node[i] for i in some], pa.int64())})

    def by_set(keys, table):
        links = connect(Members(table), keys[1].as_py() != keys[2].as_py())
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    marks = marked.select("node", "marks")
    seats = seats.join(marked.select("node", "n"), "node")
    first = _dealt(seats).join(marks, "node").groupBy("hub", "low", "high").applyInArrow(by_signature, "hub long, node long")
    left = _stored(first.distinct(), "hopeful")
    again = _dealt(seats.join(left, ["hub", "node"]))
    full = again.join(marks, "node").join(sets, "node")
    return full.groupBy("hub", "low", "high").applyInArrow(by_set, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs``; ``kept`` rows are their component's least id."""
    made = _stored(sketches(docs), "sketches")
    known = made.filter("doc_id is not null and n > 0")
    least = F.min(F.struct("doc_id", "bands", "marks")).alias("least")
    classes = known.groupBy("h1", "h2", "n").agg(least).select(
        F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", F.col("least.doc_id").alias("rep"), "least.bands", "least.marks"
    )
    nodes = _stored(classes, "nodes")  # numbers are fixed from here on
    groups = _stored(hub_groups(nodes), "groups")
    members = nodes.join(groups.select("node").distinct().hint("merge"), "node", "left_semi").drop("bands")
    members = _stored(members, "members")
    marked = members.select("node", "n", "marks")
    sets = _stored(whole_sets(docs, members.drop("marks")), "sets")
    links = _stored(hub_links(groups, marked, sets), "links")
    found = components(links).select("node", F.col("component").alias("c"))
    seats = groups.join(found, "node", "left").withColumn("c", F.coalesce("c", "node"))
    links = links.unionByName(_stored(group_links(seats, marked, sets), "links"))

    named = nodes.select("h1", "h2", "n", "node", "rep")
    placed = made.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left").select("doc_id", "n", "node", "rep")
    placed = _stored(placed, "placed")
    # an id with several texts joins their classes
    of_id = placed.filter("doc_id is not null and node is not null").select("doc_id", "node").distinct()
    several = of_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last")
    links = links.unionByName(of_id.join(several, "doc_id").filter("a < node").select("a", F.col("node").alias("b")))
    found = _stored(components(links), "components")
    least = found.join(named.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    lookup = found.join(least, "component").select("node", "least")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("least", "rep"))
    # without an id no class: the row stands for itself
    component = F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    return placed.join(lookup, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
