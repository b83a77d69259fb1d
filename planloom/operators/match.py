"""Overlap pairs, one-to-one matching, protected regions, coverage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import geometry as G
from planloom.functions.flags import flag
from planloom.operators.spatial import BLOCK, BLOCKS, CELL, apart, box_pairs, boxes_hit, points_join
from planloom.session import forget, join_small, written

#: A sheet, or a block that no box leaves, is matched by one fold while truths x detections stay below this.
PAIR_LIMIT = 250_000


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def overlap_pairs(left: DataFrame, right: DataFrame, on: list[str], cell: float = CELL) -> DataFrame:
    """Intersecting box pairs with inter, iou, containment and coverage.

    Columns of ``right`` get the prefix ``r_``. Pairs that do not intersect
    have 0 for every measure and are not listed.
    """
    a, b = G.box_of(), G.box_of("r_")
    return (box_pairs(left, prefixed(right, "r_", on), on, ["r_" + c for c in G.BOX], cell=cell)
            .withColumn("inter", G.intersection(a, b)).withColumn("iou", G.iou(a, b))
            .withColumn("containment", G.containment(a, b))
            .withColumn("coverage", G.coverage(a, b)))


def match_one_to_one(truth: DataFrame, dets: DataFrame, on: tuple[str, ...] = ("sheet_id",),
                     min_iou: float = K.MATCH_MIN_IOU, ties: str = "first",
                     pair_limit: int = PAIR_LIMIT, cell: float = CELL) -> DataFrame:
    """Greedy best-first matching by overlap: (on..., truth_idx, det_idx, iou).

    ``ties="first"`` prefers lower truth then lower detection numbers among
    equal overlaps, ``ties="last"`` prefers higher ones.
    """
    if ties not in ("first", "last"):
        raise ValueError("ties must be 'first' or 'last'")
    on = list(on)
    t = truth.select(*on, "truth_idx", *G.BOX)
    d = dets.select(*on, "det_idx", *[F.col(c).alias("d_" + c) for c in G.BOX])

    crowded = _crowded(t, d, on, pair_limit)
    if crowded is None:
        return _match_by_fold(_candidates(t, d, on, min_iou, cell), on, ties)
    out = _match_by_fold(_candidates(join_small(t, crowded, on, "left_anti"), d, on, min_iou, cell), on, ties)
    for part in _match_dense(join_small(t, crowded, on, "left_semi"), join_small(d, crowded, on, "left_semi"),
                             on, min_iou, ties, pair_limit, cell):
        out = out.unionByName(part)
    return out


def _crowded(t, d, on, pair_limit) -> DataFrame | None:
    """Keys with more pairs than the limit, or None when there are none."""
    sides = (t.select(*on, F.lit(1).alias("_t"), F.lit(0).alias("_d"))
             .unionByName(d.select(*on, F.lit(0).alias("_t"), F.lit(1).alias("_d"))))
    crowded = (sides.groupBy(*on).agg(F.sum("_t").alias("n_t"), F.sum("_d").alias("n_d"))
               .where(F.col("n_t") * F.col("n_d") > pair_limit).select(*on))
    return None if crowded.isEmpty() else written(crowded)


def _match_dense(t, d, on, min_iou, ties, pair_limit, cell) -> list[DataFrame]:
    """Blocks that no box leaves, folded after one join on the block; what lies in larger or crossed blocks, in rounds."""
    dbox = ["d_" + c for c in G.BOX]
    out, left = [], []
    for side, offset in BLOCKS:
        (t_alone, t), (d_alone, d) = apart([(t, list(G.BOX)), (d, dbox)], on, side, offset)
        key = [*on, *BLOCK]
        crowded = _crowded(t_alone, d_alone, key, pair_limit)
        if crowded is not None:
            left.append([join_small(df, crowded, key, "left_semi").drop(*BLOCK) for df in (t_alone, d_alone)])
            t_alone = join_small(t_alone, crowded, key, "left_anti")
        pairs = t_alone.join(d_alone, key).withColumn("iou", G.iou(G.box_of(), G.box_of("d_"))).where(F.col("iou") >= min_iou)
        out.append(_match_by_fold(pairs.select(*key, "truth_idx", "det_idx", "iou"), key, ties).drop(*BLOCK))
        if t is None:
            break
    if t is not None:
        left.append([t, d])
    if left:
        t, d = (reduce(DataFrame.unionByName, some) for some in zip(*left))
        out.append(_match_in_rounds(t, d, on, min_iou, ties, cell))
    return out


def _candidates(t, d, on, min_iou, cell) -> DataFrame:
    return (box_pairs(t, d, on, ["d_" + c for c in G.BOX], cell=cell)
            .withColumn("iou", G.iou(G.box_of(), G.box_of("d_")))
            .where(F.col("iou") >= min_iou).select(*on, "truth_idx", "det_idx", "iou"))


def _preference(ties: str, iou, t, d):
    if ties == "first":
        return F.struct((-iou).alias("i"), t.alias("t"), d.alias("d"))
    return F.struct((-iou).alias("i"), (-t).alias("t"), (-d).alias("d"))


def _match_by_fold(pairs, on, ties) -> DataFrame:
    row = F.struct(_preference(ties, F.col("iou"), F.col("truth_idx"), F.col("det_idx")).alias("p"),
                   "truth_idx", "det_idx", "iou")

    def step(taken, c):
        clash = F.exists(taken, lambda m: (m["truth_idx"] == c["truth_idx"])
                         | (m["det_idx"] == c["det_idx"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(c)))

    listed = pairs.groupBy(*on).agg(F.array_sort(F.collect_list(row)).alias("c"))
    taken = F.aggregate("c", F.filter("c", lambda r: F.lit(False)), step)
    return listed.select(*on, F.explode(taken).alias("m")).select(
        *on, "m.truth_idx", "m.det_idx", "m.iou")


def _with_class(df: DataFrame, on, idx: str, box, ties: str, out: str):
    """Split rows into distinct boxes and, per box, a queue of row numbers.

    Copies of one box are interchangeable up to their number, so they are
    matched as a queue: lowest (or highest) number first.
    """
    from planloom.operators.ranking import rank_within

    classes = df.groupBy(*on, *box).agg(F.count("*").alias(f"{out}_n"),
                                        F.min(idx).alias(f"{out}_id"))
    order = F.col(idx) if ties == "first" else -F.col(idx)
    queued = rank_within(df.withColumn("_o", order), [*on, *box], ["_o"], f"{out}_rank")
    items = (queued.join(classes.select(*on, *box, f"{out}_id"), [*on, *box])
             .select(*on, f"{out}_id", f"{out}_rank", F.col(idx)))
    return written(classes), written(items)


def _match_in_rounds(t, d, on, min_iou, ties, cell) -> DataFrame:
    """Greedy matching of crowded sheets, between distinct boxes.

    A pair of boxes that are each other's best remaining partner is matched
    head of queue to head of queue; when neither has an equally good partner,
    their whole queues are matched rank to rank at once.
    """
    dbox = ["d_" + c for c in G.BOX]
    tc, t_items = _with_class(t, on, "truth_idx", list(G.BOX), ties, "t")
    dc, d_items = _with_class(d, on, "det_idx", dbox, ties, "d")
    pairs = (box_pairs(tc, dc, on, dbox, cell=cell)
             .withColumn("iou", G.iou(G.box_of(), G.box_of("d_")))
             .where(F.col("iou") >= min_iou)
             .select(*on, "t_id", "t_n", "d_id", "d_n", "iou",
                     F.lit(0).cast("long").alias("t_used"), F.lit(0).cast("long").alias("d_used")))
    pairs = written(pairs)
    found = []
    while not pairs.isEmpty():
        heads = (pairs
                 .join(t_items.select(*on, "t_id", (F.col("t_rank") - 1).alias("t_used"),
                                      "truth_idx"), [*on, "t_id", "t_used"])
                 .join(d_items.select(*on, "d_id", (F.col("d_rank") - 1).alias("d_used"),
                                      "det_idx"), [*on, "d_id", "d_used"])
                 .withColumn("p", _preference(ties, F.col("iou"), F.col("truth_idx"),
                                              F.col("det_idx"))))
        heads = written(heads)

        def best(side):
            top = heads.groupBy(*on, side).agg(F.min("p").alias("p"), F.max("iou").alias("top"))
            equal = (heads.join(top.select(*on, side, "top"), [*on, side])
                     .where(F.col("iou") == F.col("top"))
                     .groupBy(*on, side).agg(F.count("*").alias(f"{side}_equal")))
            return top.select(*on, side, "p").join(equal, [*on, side])

        mutual = (heads.join(best("t_id"), [*on, "t_id", "p"]).join(best("d_id"), [*on, "d_id", "p"])
                  .withColumn("take", F.when(
                      (F.col("t_id_equal") == 1) & (F.col("d_id_equal") == 1),
                      F.least(F.col("t_n") - F.col("t_used"), F.col("d_n") - F.col("d_used")))
                      .otherwise(F.lit(1).cast("long"))))
        mutual = written(mutual.select(*on, "t_id", "d_id", "t_used", "d_used", "take", "iou"))
        left = (mutual.join(t_items, [*on, "t_id"])
                .where((F.col("t_rank") > F.col("t_used"))
                       & (F.col("t_rank") <= F.col("t_used") + F.col("take")))
                .select(*on, "t_id", "d_id", "iou", "truth_idx",
                        (F.col("t_rank") - F.col("t_used")).alias("k")))
        right = (mutual.join(d_items, [*on, "d_id"])
                 .where((F.col("d_rank") > F.col("d_used"))
                        & (F.col("d_rank") <= F.col("d_used") + F.col("take")))
                 .select(*on, "t_id", "d_id", "det_idx",
                         (F.col("d_rank") - F.col("d_used")).alias("k")))
        new = left.join(right, [*on, "t_id", "d_id", "k"]).select(*on, "truth_idx", "det_idx", "iou")
        found.append(written(new))
        t_take = mutual.select(*on, "t_id", F.col("take").alias("t_take"))
        d_take = mutual.select(*on, "d_id", F.col("take").alias("d_take"))
        before, pairs = pairs, written(
            pairs.join(t_take, [*on, "t_id"], "left").join(d_take, [*on, "d_id"], "left")
            .withColumn("t_used", F.col("t_used") + F.coalesce("t_take", F.lit(0)))
            .withColumn("d_used", F.col("d_used") + F.coalesce("d_take", F.lit(0)))
            .where((F.col("t_used") < F.col("t_n")) & (F.col("d_used") < F.col("d_n")))
            .drop("t_take", "d_take"))
        for old in (before, heads, mutual):
            forget(old)
    if not found:
        return t.join(d.select(*on, "det_idx"), on).select(
            *on, "truth_idx", "det_idx", F.lit(None).cast("double").alias("iou")).limit(0)
    matched = found[0]
    for some in found[1:]:
        matched = matched.unionByName(some)
    return matched


def score_runs(truth: DataFrame, dets: DataFrame, on: tuple[str, ...] = ("sheet_id",),
               corrections: DataFrame | None = None, matches: DataFrame | None = None,
               min_iou: float = K.MATCH_MIN_IOU) -> DataFrame:
    """One row per truth run; unmatched runs keep NULL detection columns.

    ``corrections`` (on..., det_idx, corrected) overrides the detected text.
    """
    on = list(on)
    if matches is None:
        matches = match_one_to_one(truth, dets, tuple(on), min_iou)
    seen = dets.select(*on, "det_idx", F.col("text").alias("detected"), "conf",
                       F.col("angle_deg").alias("angle_detected"),
                       *[F.col(c).alias("d_" + c) for c in G.BOX])
    if corrections is not None:
        seen = (seen.join(corrections.select(*on, "det_idx", "corrected"), [*on, "det_idx"], "left")
                .withColumn("corrected", F.coalesce("corrected", "detected")))
    else:
        seen = seen.withColumn("corrected", F.col("detected"))
    tx, ty = G.box_center(G.box_of())
    dx, dy = G.box_center(G.box_of("d_"))
    # Matches join the detections first: both are keyed by (sheet, det_idx).
    found = matches.join(seen, [*on, "det_idx"])
    return (truth.withColumnRenamed("text", "truth").withColumnRenamed("angle_deg", "angle_truth")
            .join(found, [*on, "truth_idx"], "left")
            .withColumn("iou", F.coalesce("iou", F.lit(0.0)))
            .withColumn("anchor_error_px", F.hypot(tx - dx, ty - dy))
            .drop(*["d_" + c for c in G.BOX]))


# --- regions ------------------------------------------------------------------

def _by_region(df, regions, on, how, cell):
    cx, cy = G.box_center(G.box_of())
    areas = prefixed(regions.select(*on, *G.BOX), "g_", on)
    return points_join(df.withColumns({"_px": cx, "_py": cy}), areas, on, how, ["g_" + c for c in G.BOX],
                       ("_px", "_py"), cell=cell).drop("_px", "_py")


def outside_protected(df, regions, on=("sheet_id",), cell: float = CELL) -> DataFrame:
    """Runs whose centre lies in no protected region (closed bounds)."""
    return _by_region(df, regions, list(on), "left_anti", cell)


def inside_protected(df, regions, on=("sheet_id",), cell: float = CELL) -> DataFrame:
    return _by_region(df, regions, list(on), "left_semi", cell)


def missed_text(dropped: DataFrame, kept: DataFrame, on=("sheet_id",), ids=("det_idx",),
                cell: float = CELL) -> DataFrame:
    """Confident dropped reads that no single kept box covers by more than half.

    Returns the dropped rows with a ``flag`` column.
    """
    on, ids = list(on), list(ids)
    key = list(dict.fromkeys([*on, *ids]))
    notable = dropped.where((F.length("text") >= K.MISSED_TEXT_MIN_LEN)
                            & (F.col("conf") >= K.LOW_CONFIDENCE))
    boxes = prefixed(kept.select(*on, *G.BOX), "k_", on)
    covered = boxes_hit(notable, boxes, on, key, ["k_" + c for c in G.BOX], cell=cell,
                        extra=G.coverage(G.box_of(), G.box_of("k_")) > K.MISSED_TEXT_COVER)
    cx, cy = G.box_center(G.box_of())
    message = F.format_string(
        "Dropped read without a kept run over it: '%s', confidence %.2f, centre (%.0f, %.0f).",
        "text", "conf", cx, cy)
    return (notable.join(covered, key, "left_anti")
            .withColumn("flag", flag("possible-missed-text", message, "warn")))


# --- wording of the output --------------------------------------------------------

def check_wording(expected: DataFrame, observed: DataFrame, on: tuple[str, ...] = ("sheet_id",),
                  vocab=None, source_conf: bool = False) -> DataFrame:
    """Issues with the wording of a drawn sheet: (on..., run_id, issue, message).

    ``expected`` has run_id, text and box, ``observed`` det_idx, text, conf and
    box. A run nobody reads back is unconfirmed; one read back as something
    else, or without confidence, needs review.
    """
    from planloom.operators.vocab import Vocabulary, snap_text

    on = list(on)
    pairs = match_one_to_one(expected.withColumnRenamed("run_id", "truth_idx"), observed, tuple(on), ties="last")
    read = snap_text(observed, vocab=vocab or Vocabulary())
    read = read.select(*on, "det_idx", F.col("snap.text").alias("read"), F.col("conf").alias("read_conf"))
    seen = (pairs.withColumnRenamed("truth_idx", "run_id").join(read, [*on, "det_idx"])
            .select(*on, "run_id", "read", "read_conf"))
    both = expected.join(seen, [*on, "run_id"], "left")
    issue = (F.when(F.col("read").isNull(), "unconfirmed")
             .when((F.col("read") != F.col("text")) | (F.col("read_conf") < K.LOW_CONFIDENCE), "differs"))
    message = (F.when(F.col("read").isNull(), F.format_string(
        "'%s' was not read back from the output; wording unconfirmed.", "text"))
        .otherwise(F.format_string("'%s' was read back as '%s' at %.2f; review required.", "text", "read", "read_conf")))
    out = (both.withColumn("issue", issue).where(F.col("issue").isNotNull())
           .select(*on, "run_id", "issue", message.alias("message")))
    if source_conf:
        unsure = expected.where(F.col("conf") < K.LOW_CONFIDENCE).select(
            *on, "run_id", F.lit("source-confidence").alias("issue"), F.format_string(
                "'%s' was read on the source at %.2f; review required.", "source_text", "conf").alias("message"))
        out = out.unionByName(unsure)
    return out
