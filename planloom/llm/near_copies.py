"""Near copies by exact shingle similarity, found by SimHash and MinHash (operator 1 as the pipeline needs it).

A text is the set of its five-word shingles (64-bit hashes of lower-cased words; a text of fewer words
is one shingle). Two texts are near copies where the sets' Jaccard similarity is at least 0.8, which
is computed on the whole sets, in whole numbers. Equal sets are one node.

Candidates come from multi-index hashing of the sets' fingerprints (``simhash.links``: three bits at most), which is
what near copies with a word or two exchanged differ in, and from BANDS bands of ROWS minima each for the others:
a pair at 0.8 shares no band with probability (1 - 0.8 ** 4) ** 25, about two in a million.

Of a bucket (one value of one band) all nodes are compared with two of them first, and the links found make groups.
Buckets whose nodes are then of several groups are compared whole, each in a task that emits no more than one link for each
node (``_whole``). A bucket of more than WHOLE nodes is split for that by further minima, and by chance where these are all alike. It may
part near copies, so buckets that were split come again with other minima until a round finds no link. What then still has
several groups is compared in full, block by block (``_blocks``): every node outside a bucket's largest group with all others.

Defined results: texts without a word are copies of each other and of nothing else; for the rest see ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm import simhash
from planloom.llm.components import components
from planloom.llm.simhash import SEED, shingles_of, smallest_of_each
from planloom.session import cut_lineage, forget, shuffles_freed, written

SHINGLE = 5
#: At least NEAR[0] / NEAR[1] of the two sets' union is in both.
NEAR = (4, 5)
BANDS = 25
ROWS = 4
#: Nodes of a bucket that one task compares with each other.
WHOLE = 1024
#: Different shingles that are counted at once there.
_COLUMNS = 1 << 12

#: Shingles whose minima are taken at once, which bounds the memory of a long text.
_BLOCK = 1 << 12
_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def hashes_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; of a text without a word, none."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p, SEED) for p in shingles_of(text, shingle)), np.dtype("<u8")))


def minima_of(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of 32 bits; of a text without a word, none."""
    if not len(hashes):
        return np.zeros(0, np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        mixed = hashes[at:at + _BLOCK] * _FACTORS + _TERMS
        least = np.minimum(least, (mixed >> np.uint64(32)).min(axis=1))
    return least.astype(np.uint32)


def bands_of(minima: np.ndarray) -> list[int]:
    """A signed 64-bit key of each band."""
    keys = [xxhash.xxh64_intdigest(x.tobytes(), n) for n, x in enumerate(minima.astype("<u8").reshape(-1, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the different hashes, as a signed number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at:at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


#: Texts whose sets are in Python's memory at a time.
_TEXTS_AT_ONCE = 200


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
            yield batch.slice(at, _TEXTS_AT_ONCE)


def _lists(arrays: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(arrays).view(kind))


def _sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column without nulls, not copied."""
    found = []
    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        ends, values = x.offsets.to_numpy(), x.values.to_numpy()
        found += [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return found


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key and the signatures of each text."""
    for part in _parts(batches):
        nodes, prints, bands = [], [], []
        for text in part["text"]:  # one text at a time becomes a Python object
            some = hashes_of(text.as_py())
            nodes.append(xxhash.xxh64_intdigest(some.tobytes(), SEED))
            prints.append(fingerprint_of(some))
            bands.append(bands_of(minima_of(some)))
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], part["text_key"], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.int64()),
             pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "node", "fingerprint", "bands"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        made = _lists([hashes_of(text.as_py()) for text in part["text"]], np.dtype("<i8"))
        yield pa.RecordBatch.from_arrays([part["node"], made], names=["node", "hashes"])


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        made = _lists([minima_of(x.view(np.uint64)) for x in _sets(part["hashes"])], np.dtype("<i4"))
        yield pa.RecordBatch.from_arrays([part["node"], made], names=["node", "minima"])


def _shared(nodes: DataFrame) -> DataFrame:
    """(key, node, ends): the buckets of ``nodes`` (node, bands) that have several nodes, each with two of them."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    place = F.struct(F.xxhash64("node", "key").alias("order"), "node")
    ends = (rows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
            .where("first <> last").select("key", F.array("first.node", "last.node").alias("ends")))
    return written(rows.join(ends, "key").select("key", "node", "ends"))


def candidates(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(u, v), u < v: pairs of ``nodes`` (node, fingerprint, bands) that are to be compared first, each once."""
    met = shared.select("node", F.explode("ends").alias("end")).where("node <> end")
    met = met.select(F.least("node", "end").alias("u"), F.greatest("node", "end").alias("v"))
    # nodes of one fingerprint meet one of them, different fingerprints meet through theirs
    prints = written(nodes.where(F.size("bands") > 0).groupBy("fingerprint").agg(F.min("node").alias("lead")))
    same = nodes.join(prints, "fingerprint").where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    lead = lambda name: prints.select(F.col("fingerprint").alias(name), F.col("lead").alias(f"{name}_lead"))
    close = (simhash.links(prints.select("fingerprint")).join(lead("u"), "u").join(lead("v"), "v")
             .select(F.least("u_lead", "v_lead").alias("u"), F.greatest("u_lead", "v_lead").alias("v")))
    return met.unionByName(same).unionByName(close).distinct()


def _near(common, size, other):
    """Whether sets of ``size`` and ``other`` with ``common`` members are near copies."""
    return common * NEAR[1] >= (size + other - common) * NEAR[0]


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of ``sets`` have in common."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    total = np.diag([len(s) for s in sets]).astype(np.int64)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = n[column] > 1
    row, values = row[several], column[several]
    _, column = np.unique(values, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    np.fill_diagonal(total, total.diagonal() - np.bincount(row, minlength=len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[row[a:b], column[a:b] - at] = 1
        total += (held @ held.T).astype(np.int64)
    return total


def _whole(bucket: pa.Table) -> pa.Table:
    """Links that join the groups of a bucket whose members are near copies: one less than the groups at most."""
    nodes, roots = bucket["node"].to_pylist(), bucket["root"].to_pylist()
    if len(set(roots)) < 2:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    sets = _sets(bucket["hashes"])
    size = np.array([len(s) for s in sets], np.int64)
    group = {r: r for r in roots}

    def find(r):
        while group[r] != r:
            group[r] = r = group[group[r]]
        return r

    made = []
    for i, j in np.argwhere(np.triu(_near(_common(sets), size[:, None], size[None, :]), 1)).tolist():
        a, b = find(roots[i]), find(roots[j])
        if a != b:
            group[a] = b
            made.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return pa.table({"u": pa.array([u for u, _ in made], pa.int64()), "v": pa.array([v for _, v in made], pa.int64())})


def _parted(buckets: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """``buckets`` (key, node, root) split until none has more than WHOLE nodes or no minimum is left;
    ``split`` tells whether it was. Every turn takes the minima in another order."""
    small, large, step = [], buckets.withColumn("split", F.lit(False)), 0
    while True:
        sizes = written(large.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("key"))
        if sizes.isEmpty():
            small.append(large.drop("minima"))
            break
        small.append(large.join(sizes, "key", "left_anti").drop("minima"))
        if not step:
            large = large.join(sizes, "key", "left_semi")
            minima = sets.join(large.select("node").distinct(), "node").select("node", "hashes").mapInArrow(
                _least, "node long, minima array<int>")
            large = large.join(written(minima), "node")
        # one minimum more, then two, four ...: copies that differ in most places are parted in a few steps
        take = [(turn * 37 + i * 13) % (BANDS * ROWS) for i in range(2 ** step - 1, 2 ** (step + 1) - 1)]
        own = [F.get("minima", F.lit(i)) for i in take] if 2 ** (step + 1) <= BANDS * ROWS else [F.xxhash64("node")]
        large = written(large.join(sizes, "key").withColumn("key", F.xxhash64("key", *own)).withColumn("split", F.lit(True)))
        step += 1
    out = small[0]
    for x in small[1:]:
        out = out.unionByName(x)
    return out


def _blocks(buckets: DataFrame) -> DataFrame:
    """``buckets`` (key, node, root) dealt out to pairs of blocks (key, one, other) of about WHOLE nodes together, so that
    each node outside a bucket's largest group meets every other node of the bucket."""
    groups = written(buckets.groupBy("key", "root").agg(F.count("*").alias("n")))
    half = max(WHOLE // 2, 1)
    most = F.max(F.struct("n", "root"))
    of_key = groups.groupBy("key").agg(most["root"].alias("lead"), F.ceil(most["n"] / half).alias("n_lead"),
                                       F.ceil((F.sum("n") - most["n"]) / half).alias("n_rest"))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1)))
    led, last = F.col("root") == F.col("lead"), F.col("n_lead") + F.col("n_rest") - 1
    own = F.when(led, dealt(F.col("n_lead"))).otherwise(F.col("n_lead") + dealt(F.col("n_rest")))
    rows = buckets.join(written(of_key), "key").withColumn("block", own).withColumn(
        "with", F.explode(F.sequence(F.when(led, F.col("n_lead")).otherwise(F.lit(0).cast("bigint")), last)))
    return rows.select("key", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "node", "root")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v): near copies among the nodes of ``rows`` (doc_id, text_key, node, fingerprint, bands), as many as join
    all that are linked directly or through others."""
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = cut_lineage(rows.groupBy("node").agg(F.min(at).alias("at"), *[F.first(c).alias(c) for c in ("fingerprint", "bands")]))

    def sets_of(asked: DataFrame) -> DataFrame:
        held = written(nodes.join(asked, "node").select(
            "node", F.col("at.doc_id").alias("_doc_id"), F.col("at.text_key").alias("_text_key")))
        texts = docs.select("doc_id", "text").join(held, F.col("doc_id").eqNullSafe(F.col("_doc_id"))
                                                   & (F.xxhash64("text") == F.col("_text_key")))
        return cut_lineage(texts.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(
            _hashed, "node long, hashes array<bigint>"))

    shared = _shared(nodes)
    pairs = written(candidates(nodes, shared))
    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"{name}_hashes"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("u_hashes", "v_hashes")).cast("long")
    found = written(both.where(_near(common, F.size("u_hashes"), F.size("v_hashes"))).select("u", "v"))
    forget(pairs)

    turn = 0
    while True:
        roots = components(found)
        placed = written(shared.select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        several = written(placed.join(mixed, "key"))
        forget(placed)
        parted = written(_parted(several, sets, turn))
        # a part of one group has nothing to find
        open_parts = parted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        todo = written(parted.join(open_parts, "key").select("key", "node", "root", "split"))
        more = written(todo.join(sets, "node").select("key", "node", "root", "hashes").groupBy("key")
                       .applyInArrow(_whole, "u bigint, v bigint").distinct())
        forget(todo)
        last = parted.where("split").isEmpty()
        forget(parted)
        if last:
            break
        if more.isEmpty():
            split = several.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("key")
            rest = _blocks(written(several.join(split, "key"))).join(sets, "node")
            more = written(rest.select("key", "one", "other", "node", "root", "hashes").groupBy("key", "one", "other")
                           .applyInArrow(_whole, "u bigint, v bigint").distinct())
            break
        found, turn = written(found.unionByName(more)), turn + 1
    for done in (shared, several):
        forget(done)
    return found.unionByName(more)


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies (linked directly or through others), as
    ``simhash.keep_one`` has it."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    with shuffles_freed(docs.sparkSession):
        rows = cut_lineage(keyed.mapInArrow(_signed, f"doc_id {kind}, text_key long, node long, fingerprint long, bands array<bigint>"))
        roots = written(components(links(docs, rows)))
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return smallest_of_each(docs, rooted)
