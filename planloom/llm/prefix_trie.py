"""Conversation prefix trie with totals of every subtree (operator 11).

A node is a distinct sequence of first turns. Its key is a polynomial of the turns' digests modulo the prime
2^127 - 1, so that keys of prefixes can be made from pieces: turns are put in order by range partitioning, each
partition runs over its turns once, and a conversation that lies in several partitions is joined from their
polynomials. The key of a turn behind a replaced beginning follows from that of the original turn and two
constants of the conversation. No task needs a whole conversation, and texts are never shuffled.

Totals of subtrees come from a centroid decomposition of the forest of parent edges (``totals``), so that
a trie that is one long path takes as many rounds as a bushy one:

* a component is a connected piece of the forest with one top; each node knows the weight below it in its
  component, where a node weighs as much as it has members. These weights need no rollup: a member with L turns
  adds L - d + 1 to its node of depth d;
* nodes with more than half of their component's weight below them form a path from the top; the lowest is the
  centroid. Without it, no piece has more than half of the weight;
* component totals are aggregated, the total of the centroid's part is the total of the component without that
  of the piece above, and it is added to every node on the path from the centroid to the top.

Components of more than ``component`` nodes are split by Spark jobs, all at once in each round; the nodes of
smaller ones fit into a task, which goes on in the same way (``_settled``).

Defined results: rows without a conv_id take no part; null role or text is empty; turns go by turn (null first), then
by digest, so ties and repeated rows have an order; a conversation without turns is a member of the root only;
an empty table has no nodes. Columns other than conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.shared import written
from planloom.session import join_small

PRIME = (1 << 127) - 1
BASE = 0x2B992DDFA23249D61A6F3B9E2C4F7D85
#: A component of more nodes is split by Spark jobs; nodes of one task when smaller ones are dealt out.
COMPONENT = 20_000
NODES_A_TASK = 50_000
#: Characters of the ids that are joined before they go to the task that hashes them.
PIECE = 1 << 20

LOW = (1 << 64) - 1
SIGN = 1 << 63
HEAD = "array<struct<pos:bigint,k1:bigint,k2:bigint,n_bytes:bigint>>"


@lru_cache(maxsize=1 << 16)
def _power(n: int) -> int:
    return pow(BASE, n, PRIME)


def _joined(high: int, low: int) -> int:
    return high << 64 | low & LOW


def _halves(key: int) -> tuple[int, int]:
    low = key & LOW
    return key >> 64, low - (low & SIGN) * 2


def _columns(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of 64-bit integers."""
    names = schema.replace(" bigint", "").split(", ")
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or
                                      [pa.array([], pa.int64())] * len(names), names=names)


SCANNED = "part bigint, conv_id bigint, n_bytes bigint, local bigint, l1 bigint, l2 bigint, q1 bigint, q2 bigint"


def _scan(batches):
    """Each turn's number among its conversation's turns in this partition, the key up to it and up to the one before."""
    part, conv, n, key = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        rows = []
        for c, d1, d2, n_bytes in zip(*(batch[x].to_pylist() for x in ("conv_id", "d1", "d2", "n_bytes")), strict=True):
            if c != conv:
                conv, n, key = c, 0, 0
            n, before, key = n + 1, key, (key * BASE + (d1 << 64 | d2)) % PRIME
            rows.append((part, c, n_bytes, n, *_halves(key), *_halves(before)))
        yield _columns(SCANNED, rows)


def scanned(messages: DataFrame) -> DataFrame:
    """Turns in order, spread over range partitions; equal turns are dealt out as well."""
    partitions = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    order = ["conv_id", "turn", "d1", "d2"]
    shaped = (messages.where("conv_id IS NOT NULL")
              .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
                      F.octet_length(text).cast("long").alias("n_bytes"))
              .select("conv_id", "turn", "n_bytes", half(1).alias("d1"), half(16).alias("d2")))
    dealt = shaped.repartitionByRange(partitions, *order, F.rand(11)).sortWithinPartitions(*order)
    return written(dealt.select("conv_id", "d1", "d2", "n_bytes").mapInArrow(_scan, SCANNED), "turns")


SPANS = "conv_id bigint, part bigint, skipped bigint, b1 bigint, b2 bigint"


def _before(parts: pa.Table) -> pa.Table:
    """For a conversation that lies in several partitions: turns and key before each of them."""
    rows, n, key = [], 0, 0
    for x in sorted(parts.to_pylist(), key=lambda x: x["part"]):
        rows.append((x["conv_id"], x["part"], n, *_halves(key)))
        n, key = n + x["n"], (key * _power(x["n"]) + _joined(x["l1"], x["l2"])) % PRIME
    return pa.Table.from_batches([_columns(SPANS, rows)])


def numbered(messages: DataFrame) -> DataFrame:
    """Turns with ``pos``, their number in the conversation from 1, and what a partition's key lacks."""
    turns = scanned(messages)
    # a conversation in two partitions is the last of one and the first of another: two rows for each partition
    edges = turns.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    split = (edges.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv_id"))
             .groupBy("conv_id").count().where("count > 1").select("conv_id"))
    spans = written(join_small(turns, split, "conv_id").groupBy("conv_id", "part")
                    .agg(F.max("local").alias("n"), F.max_by("l1", "local").alias("l1"), F.max_by("l2", "local").alias("l2"))
                    .groupBy("conv_id").applyInArrow(_before, SPANS), "spans")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    joined = join_small(turns, spans, ["conv_id", "part"], "left")
    return joined.select("conv_id", "n_bytes", "local", "l1", "l2", "q1", "q2", zero("b1"), zero("b2"),
                         (F.col("local") + F.coalesce("skipped", F.lit(0))).alias("pos"))


KEYED = "conv_id bigint, n_bytes bigint, depth bigint, length bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint"
TO_KEY = ["conv_id", "n_bytes", "depth", "length", "local", "l1", "l2", "q1", "q2", "b1", "b2",
          "behind", "g1", "g2", "h1", "h2"]


def _key(batches):
    """Keys of turns and of their parents; ``g`` replaces ``h`` as key of what lies ``behind`` turns before."""
    for batch in batches:
        rows = []
        for conv, n_bytes, depth, length, local, l1, l2, q1, q2, b1, b2, behind, g1, g2, h1, h2 in zip(
                *(batch[x].to_pylist() for x in TO_KEY), strict=True):
            before, change = _joined(b1, b2), _joined(g1, g2) - _joined(h1, h2)
            key, parent = _joined(l1, l2), _joined(q1, q2)
            if before:
                key, parent = key + before * _power(local), parent + before * _power(local - 1)
            if change:
                key, parent = key + change * _power(behind), parent + change * _power(behind - 1)
            rows.append((conv, n_bytes, depth, length, *_halves(key % PRIME), *_halves(parent % PRIME)))
        yield _columns(KEYED, rows)


def occurrences(messages: DataFrame, family: int, most_turns: int) -> DataFrame:
    """(conv_id, n_bytes, depth, length, k1, k2, p1, p2): each rebuilt conversation's prefixes, the empty one included.

    A conversation c begins with the first h turns of c - c % family instead of its own, h being the crc32 of
    its decimal id modulo ``most_turns`` + 1.
    """
    turns = numbered(messages)
    nil = [F.lit(0).cast("bigint").alias(x) for x in ("g1", "g2", "h1", "h2")]
    first = turns.where(F.col("pos") <= most_turns).select(
        "*", F.col("pos").alias("depth"), F.lit(0).cast("bigint").alias("length"), F.lit(1).cast("bigint").alias("behind"), *nil)
    heads = (first.select(*TO_KEY).mapInArrow(_key, KEYED).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct(F.col("depth").alias("pos"), "k1", "k2", "n_bytes"))).alias("head")))
    convs = written(turns.groupBy("conv_id").agg(F.max("pos").alias("n")).join(heads, "conv_id", "left")
                    .select("conv_id", "n", F.coalesce("head", F.array().cast(HEAD)).alias("head")), "heads")

    zero = F.lit(0).cast("bigint")
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    at = lambda head, n, name: F.coalesce(F.get(head, F.col(n).cast("int") - 1)[name], zero)
    rebuilt = (convs.withColumn("h", crc % (most_turns + 1)).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
               .join(bases, "base", "left").withColumn("begin", F.slice(F.coalesce("base_head", F.array().cast(HEAD)), 1, F.col("h").cast("int")))
               .withColumn("g", F.size("begin").cast("bigint"))
               .withColumn("length", F.col("g") + F.greatest(F.col("n") - F.col("h"), zero))
               .select("conv_id", "h", "g", "begin", "length", *[at(F.col("begin"), "g", k).alias(f"g{k[1]}") for k in ("k1", "k2")],
                       *[at(F.col("head"), "h", k).alias(f"h{k[1]}") for k in ("k1", "k2")]))
    rebuilt = written(rebuilt, "rebuilt")

    begin, before = F.col("begin"), lambda x, name: F.coalesce(F.get(F.col("begin"), x["pos"].cast("int") - 2)[name], zero)
    prefix = lambda depth, n_bytes, *keys: F.struct(
        n_bytes.alias("n_bytes"), depth.alias("depth"),
        *[k.alias(name) for k, name in zip(keys, ("k1", "k2", "p1", "p2"), strict=True)])
    beginnings = rebuilt.select("conv_id", "length", F.explode(F.concat(
        F.array(prefix(zero, zero, zero, zero, zero, zero)),
        F.transform(begin, lambda x: prefix(x["pos"], x["n_bytes"], x["k1"], x["k2"], before(x, "k1"), before(x, "k2"))))).alias("x"))
    beginnings = beginnings.select("conv_id", "x.n_bytes", "x.depth", "length", "x.k1", "x.k2", "x.p1", "x.p2")

    behind = F.col("pos") - F.col("h")
    tails = (turns.join(rebuilt.drop("begin"), "conv_id").where(behind > 0)
             .withColumn("behind", behind).withColumn("depth", F.col("behind") + F.col("g")))
    return written(beginnings.unionByName(tails.select(*TO_KEY).mapInArrow(_key, KEYED)), "prefixes")


NODE = ["depth", "k1", "k2"]


def nodes_of(prefixes: DataFrame) -> DataFrame:
    """One row for each distinct prefix, with numbers ``id`` and ``parent`` in place of keys, and how many
    children it has."""
    seen = written(prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("n_bytes").alias("n_bytes"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
        .withColumn("id", F.monotonically_increasing_id()), "seen")
    above = seen.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                        F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    joined = seen.join(above, ["depth", "p1", "p2"], "left")
    children = joined.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    return written(joined.join(children, "id", "left").select(
        "id", "parent", *NODE, "conv_id", "parent_conv_id", "n_convs", "weight", "n_bytes",
        F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children")), "nodes")


STATE = ["id", "parent", "depth", "conv_id", "weight", "top", "leaf", "saved", "leaves_below", "saved_below"]
TOTALS = "id bigint, n_leaves bigint, saved_tokens bigint"


def totals(nodes: DataFrame, prefixes: DataFrame, component: int = COMPONENT) -> DataFrame:
    """(id, n_leaves, saved_tokens): leaves and saved bytes in each node's subtree."""
    zero = F.lit(0).cast("bigint")
    root = nodes.where("depth = 0").select("id").first()
    state = nodes.select(
        "id", "parent", "depth", "conv_id", "weight", F.lit(root.id if root else None).cast("bigint").alias("top"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        zero.alias("leaves_below"), zero.alias("saved_below"))
    done, small = [], []
    while True:
        sums = state.groupBy("top").agg(F.count("*").alias("n"), F.sum("leaf").alias("all_leaves"), F.sum("saved").alias("all_saved"),
                                        F.max("weight").alias("all_weight"))
        large = written(sums.where(F.col("n") > component), "components")
        if large.isEmpty():
            small.append(state)
            break
        known = written(join_small(state, large, "top", "left"), "known")
        small.append(known.where("n IS NULL").select(*STATE))
        state, centroids = _split(known.where("n IS NOT NULL"), nodes, prefixes)
        done.append(centroids)
    rest = small[0]
    for x in small[1:]:
        rest = rest.unionByName(x)
    groups = max(1, -(-nodes.count() // NODES_A_TASK), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = (rest.withColumn("dealt", F.pmod(F.xxhash64("top"), F.lit(groups).cast("bigint")))
             .groupBy("dealt").applyInArrow(_settled, TOTALS))
    for x in done:
        found = found.unionByName(x)
    return found


def _split(known: DataFrame, nodes: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state of large components without their centroids, and the centroids' totals."""
    path = F.col("weight") * 2 > F.col("all_weight")
    own = F.struct("id", "depth", "weight")
    chosen = written(known.where(path).groupBy("top").agg(F.max_by(own, "depth").alias("c"))
                     .select("top", F.col("c.id").alias("centroid"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")),
                     "centroids")
    with_centroid = join_small(known, chosen, "top")
    # which child of the centroid stands on the way to a node: asked once for each conversation, on its prefixes
    asked = with_centroid.where(F.col("depth") > F.col("c_depth")).select(
        "top", "conv_id", "centroid", (F.col("c_depth") + 1).alias("depth")).distinct()
    ways = asked.join(prefixes.select("conv_id", *NODE), ["conv_id", "depth"]).join(
        nodes.select(*NODE, F.col("id").alias("new_top"), "parent"), NODE).where(F.col("parent") == F.col("centroid"))
    moved = with_centroid.join(ways.select("top", "conv_id", "new_top"), ["top", "conv_id"], "left")
    below = (F.col("depth") > F.col("c_depth")) & F.col("new_top").isNotNull()
    cut = written(moved.select(*[c for c in known.columns if c != "top"], "top", "centroid", "c_weight",
                               F.when(below, F.col("new_top")).otherwise(F.col("top")).alias("new_top")), "cut")
    above = cut.where((F.col("new_top") == F.col("top")) & (F.col("id") != F.col("centroid"))).groupBy("top").agg(
        F.sum("leaf").alias("above_leaves"), F.sum("saved").alias("above_saved"))
    zero = F.lit(0)
    part = lambda name: F.col(f"all_{name}") - F.coalesce(f"above_{name}", zero)
    summed = join_small(cut, above, "top", "left").select("*", part("leaves").alias("part_leaves"), part("saved").alias("part_saved"))
    on_path = path & (F.col("id") != F.col("centroid"))
    added = lambda name: (F.col(f"{name}_below") + F.when(on_path, F.col(f"part_{name}")).otherwise(zero)).alias(f"{name}_below")
    state = summed.where(F.col("id") != F.col("centroid")).select(
        "id", "parent", "depth", "conv_id", (F.col("weight") - F.when(on_path, F.col("c_weight")).otherwise(zero)).alias("weight"),
        F.col("new_top").alias("top"), "leaf", "saved", added("leaves"), added("saved"))
    centroids = summed.where(F.col("id") == F.col("centroid")).select(
        "id", (F.col("leaves_below") + F.col("part_leaves")).alias("n_leaves"),
        (F.col("saved_below") + F.col("part_saved")).alias("saved_tokens"))
    return state, centroids


def _settled(nodes: pa.Table) -> pa.Table:
    """The rounds of ``totals`` for whole components that one task holds."""
    nodes = nodes.sort_by("depth")
    ids, parents, weight, leaf, saved, leaves_below, saved_below = (nodes[x].to_pylist() for x in (
        "id", "parent", "weight", "leaf", "saved", "leaves_below", "saved_below"))
    place = {x: i for i, x in enumerate(ids)}
    parent = [place.get(x, -1) for x in parents]
    top = [place[x] for x in nodes["top"].to_pylist()]
    active, out = range(len(ids)), []
    while active:
        all_weight = {t: weight[t] for t in {top[i] for i in active}}
        path = {t: [] for t in all_weight}
        for i in active:  # in order of depth, so the last of a path is the centroid
            if 2 * weight[i] > all_weight[top[i]]:
                path[top[i]].append(i)
        centroid = {t: found[-1] for t, found in path.items()}
        part_leaves, part_saved, new_top = dict.fromkeys(path, 0), dict.fromkeys(path, 0), {}
        for i in active:
            t = top[i]
            if i == centroid[t]:
                new_top[i] = -1
            elif i == t:
                new_top[i] = t
            else:
                new_top[i] = i if parent[i] == centroid[t] else new_top[parent[i]]
            if new_top[i] != t:
                part_leaves[t] += leaf[i]
                part_saved[t] += saved[i]
        for t, found in path.items():
            for i in found:
                leaves_below[i] += part_leaves[t]
                saved_below[i] += part_saved[t]
            c = found[-1]
            out.append((ids[c], leaves_below[c], saved_below[c]))
            for i in found[:-1]:
                weight[i] -= weight[c]
        active = [i for i in active if new_top[i] >= 0]
        for i in active:
            top[i] = new_top[i]
    return pa.Table.from_batches([_columns(TOTALS, out)])


ENDS = [*NODE, "conv_id"]
PIECES = "depth bigint, k1 bigint, k2 bigint, conv_id bigint, piece string"


def _pieces(batches):
    """Consecutive ids of a node, joined by commas, under the first of them."""
    schema = pa.schema([(x, pa.int64()) for x in ENDS] + [("piece", pa.string())])
    for batch in batches:
        rows = []
        for node, members in groupby(zip(*(batch[x].to_pylist() for x in ENDS), strict=True), key=lambda x: x[:3]):
            members = [x[3] for x in members]
            for at in range(0, len(members), PIECE // 16):
                some = members[at:at + PIECE // 16]
                rows.append((*node, some[0], ",".join(map(str, some))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip(list(zip(*rows, strict=True)) or [[]] * 5, schema, strict=True)], schema=schema)


HASHED = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"


def _hashed(batches):
    """Hash of each node's pieces, which follow one another; no more than a piece is held."""
    schema = pa.schema([(x, pa.int64()) for x in NODE] + [("ends_sha256", pa.string())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip(list(zip(*rows, strict=True)) or [[]] * 4, schema, strict=True)], schema=schema)

    last, state = None, None
    for batch in batches:
        rows = []
        for *node, piece in zip(*(batch[x].to_pylist() for x in (*NODE, "piece")), strict=True):
            if node == last:
                state.update(b",")
            else:
                if last:
                    rows.append((*last, state.hexdigest()))
                last, state = node, hashlib.sha256()
            state.update(piece.encode())
        yield batch_of(rows)
    if last:
        yield batch_of([(*last, state.hexdigest())])


def ends(prefixes: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes at which conversations end. A node may be the end of any share of them:
    its ids are sorted and joined in all partitions, only the hash itself is taken in one."""
    partitions = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = prefixes.where("depth = length").select(*ENDS)
    pieces = last.repartitionByRange(partitions, *ENDS).sortWithinPartitions(*ENDS).mapInArrow(_pieces, PIECES)
    return pieces.repartition(partitions, *NODE).sortWithinPartitions(*ENDS).mapInArrow(_hashed, HASHED)


def trie(messages: DataFrame, family: int = 5, most_turns: int = 8, component: int = COMPONENT) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = occurrences(messages, family, most_turns)
    nodes = nodes_of(prefixes)
    rolled = totals(nodes, prefixes, component)
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return (nodes.join(rolled, "id").join(ends(prefixes), NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", none).alias("ends_sha256")))
