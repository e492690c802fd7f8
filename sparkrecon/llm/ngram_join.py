"""N-gram Jaccard join with prefix trees, and the components of its links.

A document's set holds its distinct 5-word shingles (64-bit hashes; words lower-cased in A-Z). Two
sets link when their Jaccard similarity is at least 3/4, tested exactly on whole sets.

1. A table of counters over all shingles, one per ``LOAD`` of them but at most ``2 ** MOST_BITS`` (one
   byte each, so it may be broadcast), gives one global order: rare counters first, then hash order.
   Counters never count too little. Beyond that size the order gets coarser, never wrong.
2. Equal sets form a class, represented by its least id. Only representatives go on.
3. Sets that link share at least ``common(n)`` shingles among the first ``prefix_length(n)`` of their order, and
   one is at least 3/4 as large as the other. A set with fewer shared prefix shingles than
   that allows links with nothing and goes. Per shingle left the least id is the hub, and everyone who
   has it joins the hub's group: each linked pair meets in a group. A shingle whose counter is at most
   ``COLD`` has at most that many holders, so a window finds its hub; for others the hub is a
   partial aggregate joined back. A set leaves the groups through which it shares so few shingles that it meets
   all it links to in others.
4. A group is a trie over ordered sets. A probe walks it sharing the overlap of common paths, and a
   subtree goes when the remaining lengths cannot reach the needed overlap or all of it
   is already connected to the probe. Groups above ``GROUP`` are dealt into blocks that all hold the
   hub; members that do not connect to the hub meet all other blocks in a second round.
5. The links found span the same components as all links do.

Null texts and texts without words link with nothing; rows without an id get no component; repeated
ids are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrecon.llm.components import components
from sparkrecon.llm.id_table import likely
from sparkrecon.llm.words import Texts, chunks, column, mix, ngrams, texts_of
from sparkrecon.plans.lineage import drop_scratch, scratch_path

N = 5
LOAD = 16
LEAST_BITS, MOST_BITS = 16, 22
SLICE_BITS = 18
COLD = 2_048
GROUP = 256
EXTRA = 16
INDEXED = 8
_OTHER = np.uint64(0x9E3779B97F4A7C15)


def shingles(x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text (with repeats), and offsets of the texts into them."""
    _, _, offsets = x.words()
    hashes = x.word_hashes(lower=True)
    grams, first = ngrams(hashes, offsets, N)
    row = np.searchsorted(offsets, first, side="right") - 1
    n_words = np.diff(offsets)
    short = np.flatnonzero((n_words > 0) & (n_words < N))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(N - 1):
            has = n_words[short] > j
            at = np.where(has, offsets[short] + j, 0)
            whole = np.where(has, mix(whole + hashes[at] + np.uint64(j + 1)), whole)
        grams, row = np.concatenate([grams, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        grams, row = grams[order], row[order]
    return grams, np.searchsorted(row, np.arange(x.n + 1))


def counter_bits(docs: DataFrame) -> int:
    """Bits for about one counter per ``LOAD`` shingles, within bounds that keep a table broadcastable."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(int(total / 6 / LOAD).bit_length(), LEAST_BITS), MOST_BITS)


def order_classes(docs: DataFrame, bits: int) -> np.ndarray:
    """Class per counter of shingles by the top ``bits`` of the hash, counted over all rows.

    0 up to the mean count, then quarter steps of powers of two; 128 is added when the count is above
    ``COLD``. Partial tables are cut into slices and packed, so few bytes are shuffled and no task adds
    more than a few slices.
    """
    size = 1 << bits
    width = min(size, 1 << SLICE_BITS)
    shift = np.uint64(64 - bits)
    schema = "s int, c binary"

    def packed(slices: dict[int, np.ndarray]) -> pa.RecordBatch:
        blobs = [zlib.compress(v.tobytes(), 1) for v in slices.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array(blobs, pa.binary())], ["s", "c"])

    def count(batches):
        total = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            for piece in chunks(batch):
                grams, _ = shingles(texts_of(column(piece, "text")))
                np.add.at(total, (grams >> shift).astype(np.int64), np.uint32(1))
        yield packed({i // width: total[i : i + width] for i in range(0, size, width)})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(column(batch, "s").to_pylist(), column(batch, "c").to_pylist()):
                values = np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64)
                sums[s] = sums[s] + values if s in sums else values
        yield packed(sums)

    parts = docs.select("text").mapInArrow(count, schema).repartition(size // width, "s").mapInArrow(add, schema)
    rows = {row["s"]: row["c"] for row in parts.collect()}  # size / width rows
    slices = {s: np.frombuffer(zlib.decompress(c), "<i8") for s, c in rows.items()}
    mean = max(1.0, sum(int(v.sum()) for v in slices.values()) / size)
    classes = np.zeros(size, dtype=np.uint8)
    for s, counts in slices.items():
        steps = np.clip(np.floor(4 * np.log2(np.maximum(counts, 1) / mean)), 0, 127)
        classes[s * width : (s + 1) * width] = steps + 128 * (counts > COLD)
    return classes


def ordered_sets(x: Texts, classes: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys of each text; a key is the class in 8 bits and 56 bits of the hash."""
    grams, offsets = shingles(x)
    shift = np.uint64(65 - len(classes).bit_length())
    order = classes[(grams >> shift).astype(np.int64)].astype(np.uint64)
    keys = (order << np.uint64(56)) | (mix(grams) >> np.uint64(8))
    return [np.unique(keys[offsets[i] : offsets[i + 1]]) for i in range(x.n)]


def common(n: int) -> int:
    """Shingles that two linked sets share in their prefixes, at least, if the one whose prefix ends
    first has ``n``."""
    return 1 + n // EXTRA


def prefix_length(n: int) -> int:
    """A set lacks at most ``n - ceil(3n/4)`` shingles of one it links to."""
    return n - (3 * n + 3) // 4 + common(n) if n else 0


def linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= 75 * (a + b - overlap)


class Node:
    """A path-compressed trie node: a run of keys, then children by their first key."""

    __slots__ = ("keys", "depth", "children", "leaves", "least", "most", "member", "index")

    def __init__(self, keys: np.ndarray, depth: int):
        self.keys, self.depth = keys, depth
        self.children: dict[int, Node] = {}
        self.leaves: list[int] = []
        self.least, self.most, self.member = 1 << 62, 0, None
        self.index: LeafIndex | None = None


class LeafIndex:
    """The rest of the keys of all leaf children of a node, inverted: a probe meets all of them at once."""

    def __init__(self, leaves: list[Node]):
        self.leaves = leaves
        if not leaves:
            return
        self.depth = np.array([leaf.depth for leaf in leaves])
        keys = np.concatenate([leaf.keys for leaf in leaves])
        owner = np.repeat(np.arange(len(leaves)), [len(leaf.keys) for leaf in leaves])
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.owner, self.ends = owner[order], np.append(first, len(keys))

    def overlaps(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.keys, keys)
        place = np.minimum(place, len(self.keys) - 1)
        hit = place[self.keys[place] == keys]
        begin, size = self.ends[hit], self.ends[hit + 1] - self.ends[hit]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(self.owner[at], minlength=len(self.leaves))


class TrieJoin:
    """Sets of one group; ``probe`` links a set to what is in the trie, ``insert`` adds it."""

    def __init__(self):
        self.frozen = False
        self.root = Node(np.zeros(0, np.uint64), 0)
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, a: int) -> int:
        self.parent.setdefault(a, a)
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def stars(self) -> tuple[list[int], list[int]]:
        """The components of the links, each as edges from its members to its least one."""
        least: dict[int, int] = {}
        members = sorted({d for link in self.links for d in link})
        for d in members:
            least.setdefault(self.find(d), d)
        edges = [(d, least[self.find(d)]) for d in members if least[self.find(d)] != d]
        return [a for a, _ in edges], [b for _, b in edges]

    def insert(self, doc: int, keys: np.ndarray) -> None:
        node, at = self.root, 0
        while True:
            node.least, node.most = min(node.least, len(keys)), max(node.most, len(keys))
            if not node.children and not node.leaves:
                node.member = doc
            elif node.member is not None and self.find(node.member) != self.find(doc):
                node.member = None
            if at == len(keys):
                node.leaves.append(doc)
                return
            first = int(keys[at])
            child = node.children.get(first)
            if child is None:
                child = Node(keys[at:], len(keys))
                child.least = child.most = len(keys)
                child.member, child.leaves = doc, [doc]
                node.children[first] = child
                return
            rest = keys[at : at + len(child.keys)]
            differ = np.flatnonzero(rest != child.keys[: len(rest)])
            same = int(differ[0]) if len(differ) else len(rest)
            if same < len(child.keys):
                upper = Node(child.keys[:same], child.depth - len(child.keys) + same)
                upper.least, upper.most, upper.member = child.least, child.most, child.member
                child.keys = child.keys[same:]
                upper.children[int(child.keys[0])] = child
                node.children[first] = child = upper
                child.leaves = []
            node, at = child, at + same

    def probe(self, doc: int, keys: np.ndarray) -> None:
        n, own = len(keys), self.find(doc)
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, overlap = stack.pop()
            if 4 * node.most < 3 * n or 4 * n < 3 * node.least:
                continue
            if node.member is not None and self.find(node.member) == own:
                continue
            if len(node.keys):
                # the run's keys and the probe's are both ascending
                rest = keys[at:]
                place = np.searchsorted(rest, node.keys)
                inside = place < len(rest)
                overlap += int((rest[place[inside]] == node.keys[inside]).sum())
                at += int(place[-1])
                if at < n and keys[at] == node.keys[-1]:
                    at += 1
            for other in node.leaves:
                if self.find(other) != own and linked(overlap, n, node.depth):
                    self.links.append((doc, other))
                    self.parent[self.find(other)] = own
            low = max(node.least, (3 * n + 3) // 4)
            reach = overlap + min(n - at, node.most - node.depth)
            if node.children and 7 * reach >= 3 * (n + low):
                children = list(node.children.values())
                if self.frozen and len(children) >= INDEXED:
                    if node.index is None:
                        node.index = LeafIndex([c for c in children if not c.children])
                    self._meet(doc, own, node.index, keys[at:], overlap, n)
                    children = [c for c in children if c.children]
                for child in children:
                    stack.append((child, at, overlap))

    def _meet(self, doc: int, own: int, index: LeafIndex, rest: np.ndarray, overlap: int, n: int) -> None:
        if not index.leaves:
            return
        common = overlap + index.overlaps(rest)
        for i in np.flatnonzero(linked(common, n, index.depth)).tolist():
            for other in index.leaves[i].leaves:
                if self.find(other) != own:
                    self.links.append((doc, other))
                    self.parent[self.find(other)] = own


def join_group(docs: list[int], sets: list[np.ndarray], probes: list[bool] | None = None) -> TrieJoin:
    """Links among the sets of a group; with ``probes``, only of those with the others."""
    trie = TrieJoin()
    order = sorted(range(len(docs)), key=lambda i: (len(sets[i]), docs[i]))
    if probes is None:
        for i in order:
            trie.probe(docs[i], sets[i])
            trie.insert(docs[i], sets[i])
    else:
        for i in order:
            if not probes[i]:
                trie.insert(docs[i], sets[i])
        trie.frozen = True
        for i in order:
            if probes[i]:
                trie.probe(docs[i], sets[i])
    return trie


def _keys(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u8")


def document_sets(docs: DataFrame, classes) -> DataFrame:
    """doc_id, n, digest h1, h2 of the set, and its prefix as longs; ``classes`` is a broadcast."""

    def run(batches):
        table = classes.value
        for batch in batches:
            for piece in chunks(batch):
                sets = ordered_sets(texts_of(column(piece, "text")), table)
                h1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                h2 = [int(mix(s ^ _OTHER).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                heads = [s[: prefix_length(len(s))] for s in sets]
                ends = np.cumsum([0, *[len(h) for h in heads]]).astype(np.int32)
                flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
                head = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        column(piece, "doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int64()),
                        head,
                    ],
                    ["doc_id", "n", "h1", "h2", "head"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, head array<long>")


def shared_keys(rows: DataFrame) -> DataFrame:
    """``rows`` (key, doc, ...) whose key another doc has too, with ``hub``: the least of them."""
    # the top bit of a key, the sign, is set when its counter is above COLD
    names = [*rows.columns, "hub"]
    same = Window.partitionBy("key")
    cold = (
        rows.filter("key >= 0")
        .withColumns({"hub": F.min("doc").over(same), "last": F.max("doc").over(same)})
        .filter("hub < last")
    )
    hot = rows.filter("key < 0")
    hubs = hot.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).filter("hub < last")
    return cold.select(*names).unionByName(hot.join(hubs.select("key", "hub"), "key").select(*names))


def hub_groups(heads: DataFrame) -> DataFrame:
    """Distinct hub, doc pairs: doc shares a prefix shingle with hub, the least id that has it."""
    spark = heads.sparkSession
    rows = heads.select(F.explode("head").alias("key"), F.col("doc_id").alias("doc"), F.col("n").cast("int").alias("n"))
    paths = {label: scratch_path(spark, label) for label in ("shared", "met")}
    shared = _stored(shared_keys(rows).drop("hub"), paths["shared"])
    able = shared.groupBy("doc", "n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > _spare())
    left = shared.join(able, ["doc", "n"], "left_semi").select("key", "doc", "n")
    met = _stored(needed_hubs(shared_keys(left)), paths["met"])
    # a hub that nobody else needs has no group
    others = met.filter("hub <> doc").select("hub").distinct()
    groups = _stored(met.join(others, "hub", "left_semi"), scratch_path(spark, "hubs"))
    drop_scratch(spark, *paths.values())
    return groups


def _spare() -> Column:
    """One shingle less than a set of ``n`` and any it links to share: the smallest partner has ceil(3n/4) shingles."""
    return F.floor(F.floor((3 * F.col("n") + 3) / 4) / EXTRA)


def needed_hubs(rows: DataFrame) -> DataFrame:
    """Distinct hub, doc pairs of ``rows`` (key, doc, n, hub), without hubs through which a doc shares few shingles.

    A doc leaves its lightest groups as long as the keys it has there are no more than half of what it could spare. Both
    sets of a linked pair then lose fewer keys than they share, so they still meet in a group. A hub stays in its own.
    """
    met = rows.groupBy("doc", "n", "hub").agg(F.count(F.lit(1)).alias("c"))
    own = F.col("doc") == F.col("hub")
    lightest = Window.partitionBy("doc", "n").orderBy(own, "c", "hub").rowsBetween(Window.unboundedPreceding, 0)
    left = met.withColumn("least", F.sum("c").over(lightest))
    return left.filter(own | (2 * F.col("least") > _spare())).select("hub", "doc").distinct()


def _stored(df: DataFrame, path: str) -> DataFrame:
    spark: SparkSession = df.sparkSession
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def group_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges a, b that connect what links within the hub groups; ``sets`` has doc and its keys."""
    sized = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / GROUP).cast("int")
    dealt = groups.join(sized, "hub").select("hub", "doc", blocks.alias("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    seats = dealt.withColumn("at", F.explode(F.when(F.col("doc") == F.col("hub"), every).otherwise(F.array("block"))))

    def first(keys, table):
        hub, _ = (k.as_py() for k in keys)
        docs = table.column("doc").to_pylist()
        trie = join_group(docs, [_keys(b) for b in table.column("keys").to_pylist()])
        centre = trie.find(hub)
        a, b = trie.stars()
        stray = []
        if table.num_rows and table.column("blocks")[0].as_py() > 1:
            stray = sorted({d for d in docs if trie.find(d) != centre})
        return pa.table(
            {
                "hub": pa.array([None] * len(a) + [hub] * len(stray), pa.int64()),
                "a": pa.array(a + stray, pa.int64()),
                "b": pa.array(b + stray, pa.int64()),
            }
        )

    seated = seats.hint("merge").join(sets, "doc").select("hub", "at", "doc", "blocks", "keys")
    path = scratch_path(sets.sparkSession, "links")
    found = _stored(seated.groupBy("hub", "at").applyInArrow(first, "hub long, a long, b long"), path)
    links = found.filter("hub is null").select("a", "b")
    strays = found.filter("hub is not null").select("hub", F.col("a").alias("doc"))
    if strays.isEmpty():
        return links
    counted = strays.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    shares = F.ceil(F.col("n") / GROUP).cast("int")
    counted = counted.select("hub", shares.alias("shares"))
    asked = (
        strays.join(counted, "hub")
        .withColumn("share", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("shares")).cast("int"))
        .join(dealt.select("hub", "blocks").distinct(), "hub")
        .withColumn("at", F.explode(every))
        .select("hub", "share", "at", "doc", F.lit(True).alias("asks"))
    )
    held = (
        dealt.join(counted, "hub")
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .select("hub", "share", F.col("block").alias("at"), "doc", F.lit(False).alias("asks"))
    )

    def second(keys, table):
        docs = table.column("doc").to_pylist()
        sets_ = [_keys(b) for b in table.column("keys").to_pylist()]
        trie = join_group(docs, sets_, table.column("asks").to_pylist())
        a, b = trie.stars()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    again = dealt.join(counted, "hub", "left_semi").select(F.col("doc").alias("id")).distinct()
    more = asked.unionByName(held).join(likely(sets, "doc", again), "doc").groupBy("hub", "share", "at").applyInArrow(second, "a long, b long")
    return links.unionByName(more)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs``."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(order_classes(docs, counter_bits(docs)))
    paths = {label: scratch_path(spark, label) for label in ("sets", "digests", "classes", "members", "seated")}
    made = _stored(document_sets(docs, classes), paths["sets"])
    known = made.filter("doc_id is not null and n > 0")
    reps = known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    reps = _stored(reps, paths["classes"])
    heads = known.join(reps.select("h1", "h2", "n", F.col("rep").alias("doc_id")), ["h1", "h2", "n", "doc_id"], "left_semi")
    groups = hub_groups(heads)
    # the prefixes are most of this table and have served
    made = _stored(made.drop("head"), paths["digests"])
    known = made.filter("doc_id is not null and n > 0")
    drop_scratch(spark, paths["sets"])

    def full(batches):
        table = classes.value
        for batch in batches:
            for piece in chunks(batch):
                sets = ordered_sets(texts_of(column(piece, "text")), table)
                blobs = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), blobs], ["doc", "keys"])

    members = groups.select(F.col("doc").alias("doc_id")).distinct()
    # merged at every size: a list of members grows with the table and is not to be broadcast
    some = likely(docs.select("doc_id", "text"), "doc_id", members.select(F.col("doc_id").alias("id")))
    texts = some.join(members.hint("merge"), "doc_id", "left_semi")
    sets = _stored(texts.mapInArrow(full, "doc long, keys binary"), paths["members"])
    links = _stored(group_links(groups, sets), paths["seated"])
    drop_scratch(spark, paths["members"])
    # an id with several texts joins their classes
    several = known.join(reps, ["h1", "h2", "n"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    edges = links.unionByName(several.filter("a < b").select("a", "b"))
    edges = edges.unionByName(several.filter("a < b").select("a", F.col("doc_id").alias("b")))
    found = components(edges)
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", "n", F.coalesce("component", "rep").alias("component")
    )
    joined = made.join(named, ["h1", "h2", "n"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of linked rows, and all rows without an id.

    Rows are compared, not ids: of several rows of one id only those go that link with a row that stays. The row with
    the least id stays, of those the least by hash; equal rows are one. A row is named by 64 bits over its id and
    text. Columns of any name and type pass unchanged; null and empty texts link with nothing.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    named = docs.filter("doc_id is not null").select(node.alias("node"), F.col("doc_id").alias("id"))
    found = jaccard_components(docs.select(node.alias("doc_id"), "text"))
    found = found.filter("doc_id is not null").select(F.col("doc_id").alias("node"), "component_id").distinct()
    first = found.join(named.distinct(), "node").groupBy("component_id").agg(F.min(F.struct("id", "node")).alias("first"))
    kept = first.select(F.col("first.node").alias("node"))
    # maps have no order or hash of their own
    plain = [c.cast("string") if "map<" in t else c for c, (_, t) in zip(columns, docs.dtypes)]
    rows = docs.filter("doc_id is not null").select(
        node.alias("node"), F.xxhash64(*plain).alias("order"), F.struct(*columns).alias("row")
    )
    single = rows.join(kept.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min_by("row", "order").alias("row"))
    return single.select("row.*").unionByName(docs.filter("doc_id is null"))
