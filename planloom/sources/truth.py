"""Ground truth: reading, building from spans, writing; and the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import geometry as G, text as T
from planloom.operators.ranking import rank_within
from planloom.operators.vocab import MAX_WORDS, Vocabulary

TRUTH_SCHEMA = ("image string, dpi int, zoom double, width_px int, height_px int, runs array<struct<"
                "index:bigint,text:string,bbox_px:array<double>,angle_deg:double,kind:string,cap_height_px:double>>")
LEXICON_SCHEMA = ("rooms array<string>, abbreviations map<string,string>, annotations array<string>")


def read_truth(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per truth run; truth_idx is the ``index`` written with it, or its position in the list without one.

    A file is one sheet (``one_per_file``), or has a sheet in each line, as
    ``write_truth`` leaves them.
    """
    raw = spark.read.schema(TRUTH_SCHEMA).json(path, multiLine=one_per_file)
    runs = raw.select("image", "dpi", "zoom", "width_px", "height_px",
                      F.posexplode("runs").alias("truth_idx", "r"))
    box = [F.col("r.bbox_px")[i].alias(n) for i, n in enumerate(G.BOX)]
    return runs.select("image", "dpi", "zoom", "width_px", "height_px",
                       F.coalesce("r.index", "truth_idx").alias("truth_idx"), F.col("r.text").alias("text"),
                       *box, F.col("r.angle_deg").alias("angle_deg"), F.col("r.kind").alias("kind"),
                       F.col("r.cap_height_px").alias("cap_height_px"))


def lexicon_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rooms with position, folded abbreviations, annotations)."""
    raw = spark.read.schema(LEXICON_SCHEMA).json(path, multiLine=True)
    rooms = raw.select(F.posexplode("rooms").alias("ord", "word"))
    short = raw.select(F.explode("abbreviations").alias("raw", "word")).withColumn(
        "folded", T.fold_text(F.col("raw")))
    return rooms, short, raw.select(F.explode("annotations").alias("word"))


def read_lexicon(spark: SparkSession, path: str) -> Vocabulary:
    """The closed vocabulary as literals (at most MAX_WORDS words are fetched)."""
    rooms, short, notes = lexicon_tables(spark, path)

    # the order of the rooms decides between words that fit equally well
    rooms = rooms.orderBy("ord")

    def words(df, *cols):
        rows = df.select(*cols).limit(MAX_WORDS + 1).collect()
        return tuple(tuple(r) if len(cols) > 1 else r[0] for r in rows)

    return Vocabulary(words(rooms, "word"), words(short, "raw", "word"), words(notes, "word"))


def truth_angle(dx: Column, dy: Column) -> Column:
    return F.when(F.abs(dx) > F.abs(dy), 0.0).otherwise(90.0)


def build_truth(spans: DataFrame, placements: DataFrame, zoom: float) -> DataFrame:
    """Truth rows of spans: pixel box, angle, cap height and kind of the text.

    ``placements`` (ord, text, kind) names kinds; the first placement wins.
    """
    kinds = placements.groupBy("text").agg(F.min_by("kind", "ord").alias("kind"))
    work = spans.withColumn("text", T.strip(F.col("text"))).join(kinds, "text", "left")
    return (work.withColumn("cap_height_px", F.bround((F.col("y1") - F.col("y0")) * zoom * K.CAP_SHARE, 1))
            .withColumns({c: F.bround(F.col(c) * zoom, 2) for c in G.BOX})
            .withColumn("angle_deg", truth_angle(F.col("dx"), F.col("dy")))
            .withColumn("kind", F.coalesce("kind", F.lit("unknown"))))


def truth_payload(truth: DataFrame, sheets: DataFrame, part_runs: int = 10_000) -> DataFrame:
    """Nested payload per sheet: image, dpi, zoom (4 digits), size, runs[].

    A sheet with more than ``part_runs`` runs is written as several numbered
    parts in run order, so no list grows with the data. Each run has its index
    in the sheet, so parts may be read in any order.
    """
    numbered = rank_within(truth, ["sheet_id"], ["truth_idx"], "_n")
    run = F.struct("_n", "text", F.array(*[F.col(c) for c in G.BOX]).alias("bbox_px"), "angle_deg",
                   "kind", "cap_height_px")
    parts = (numbered.withColumn("part", F.floor((F.col("_n") - 1) / part_runs))
             .groupBy("sheet_id", "part").agg(F.array_sort(F.collect_list(run)).alias("_runs")))
    runs = F.transform("_runs", lambda r: F.struct(
        (r["_n"] - 1).alias("index"), r["text"].alias("text"), r["bbox_px"].alias("bbox_px"), r["angle_deg"].alias("angle_deg"),
        r["kind"].alias("kind"), r["cap_height_px"].alias("cap_height_px")))
    return (sheets.withColumn("zoom", F.bround("zoom", 4)).join(parts, "sheet_id", "left")
            .withColumn("runs", runs).withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
            .drop("_runs"))


def write_truth(payload: DataFrame, path: str, mode: str = "errorifexists") -> None:
    payload.write.mode(mode).json(path)
