"""Small cases: sources, sizes, gate moves, records, regions, streams, hooks."""

import json
import os
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import geometry as G, text as T
from planloom.operators import batch, detect, gate, hooks, pixels, sizes
from planloom.operators.detect import corroborate_tilts
from planloom.plans import reading
from planloom.sources import files, truth
from planloom.streaming import intake


def test_mirror_twice_and_vertical_text(spark):
    df = spark.createDataFrame([(0.0,), (90.0,), (-90.0,), (37.0,), (180.0,)], "a double")
    for axis in ("v", "h", "both"):
        out = df.select("a", G.mirror_angle(F.col("a"), axis).alias("m"),
                        G.mirror_angle(G.mirror_angle(F.col("a"), axis), axis).alias("mm")).collect()
        assert all(-90 < r.m <= 90 for r in out)              # never right to left
        assert all(abs(r.mm - r.a) < 1e-9 for r in out if -90 < r.a <= 90)
    assert df.where("a = 90").select(G.mirror_angle(F.col("a"), "v").alias("m")).first().m == 90.0


def test_quad_angle(spark):
    quads = [[(100, 200), (112, 290), (70, 295), (58, 205)], [(300, 400), (420, 400), (420, 450), (300, 450)]]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in q],) for q in quads],
                               "quad array<struct<x:double,y:double>>")
    a, b = [r.a for r in df.select(G.quad_angle("quad", F.lit(0.0)).alias("a")).collect()]
    assert 90 < a < 100 and b == 0


def test_tilts_against_pairs(spark):
    rng = random.Random(5)
    rows = [(i % 9, i, rng.choice([-90., 0., 90.]) + round(rng.uniform(-25, 25), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "sheet_id long, det_idx long, angle_deg double")
    got = {r.det_idx: r.angle_deg for r in corroborate_tilts(df).collect()}

    def near(a):
        best = (0.0, a)
        for c in (-180., -90., 0., 90., 180.):
            d = (a - c + 180) % 360 - 180
            if abs(d) < abs(best[1]):
                best = (c, d)
        return best

    for s, i, a in rows:
        c, d = near(a)
        lone = 3 <= abs(d) < 20 and not any(
            t == s and j != i and near(b)[0] == c and 3 <= abs(near(b)[1]) < 20 and abs(near(b)[1] - d) <= 1.0
            for t, j, b in rows)
        assert got[i] == (c if lone else a)


def test_size_clusters(spark):
    rows = [(1, "room", 45), (1, "room", 42), (1, "room", 45), (2, "room", 45), (2, "room", 20),
            (3, "annotation", 30), (3, "annotation", 31), (4, "dimension", 25), (4, "dimension", 27), (4, "dimension", 30)]
    df = spark.createDataFrame(rows, "sheet_id long, kind string, px_size int")
    got = {(r.sheet_id, r.px_size): r.median for r in sizes.size_clusters(df).collect()}
    assert got == {(1, 42): 45, (1, 45): 45, (4, 25): 27, (4, 27): 27, (4, 30): 27}


def test_names(spark):
    cases = {"PLAN-77-0310-K02-S-V03-B01.pdf": ("PLAN-77-0310-K02-R-V03-B01.pdf", False),
             "PLAN-K02-V31-R07.pdf": ("PLAN-K02-V31-R07_mirrored.pdf", True),
             "A-R-V1-S-V2.pdf": ("A-S-V1-S-V2.pdf", False)}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r.n: (r.c.name, r.c.naming_warning) for r in df.select("n", batch.counterpart_name(F.col("n")).alias("c")).collect()}
    assert got == cases


def test_export_names_across_bases(spark):
    exports = spark.createDataFrame([(1, "a", 0, 1), (2, "a", 0, 1), (3, "a_2", 0, 1), (4, "b", 0, 2), (5, "b", 120, 200)],
                                    "seq long, stem string, page_index int, page_count int")
    taken = spark.createDataFrame([("b_p01",)], "name string")
    got = {r.seq: r.export_name for r in batch.export_names(exports, taken, ["seq"]).collect()}
    assert got == {1: "a.jpg", 2: "a_2.jpg", 3: "a_2_2.jpg", 4: "b_p01_2.jpg", 5: "b_p121.jpg"}


def test_job_records_in_parts(spark):
    pages = spark.createDataFrame([(1, p, 10., 10., 3) for p in range(3)],
                                  "doc_id long, page_index int, width double, height double, text_runs_mirrored int")
    flags = spark.createDataFrame([(1, 0, "c", f"m{i % 40}", "warn") for i in range(100)] + [(1, 1, "c", "x", "info")],
                                  "doc_id long, page_index int, code string, message string, severity string")
    jobs = spark.createDataFrame([(1, "v")], "doc_id long, axis string")
    whole = batch.job_records(jobs, pages, flags).collect()
    assert len(whole) == 1 and [len(p.flags) for p in whole[0].pages] == [100, 1, 0]
    parts = batch.job_records(jobs, pages, flags, part_flags=20).collect()
    assert len(parts) > 3 and len({r.part for r in parts}) == len(parts)
    assert sum(len(p.flags) for r in parts for p in r.pages) == 101


def test_place_clear_takes_least_overlap(spark):
    cols = ("sheet_id long, run_id long, text string, kind string, cx_out double, cy_out double, angle_out double, "
            "target_along double, target_across double, ink_width double, ink_height double, hidden double")
    rows = [(1, 1, "Bad", "room", 100., 100., 0., 40., 10., 40., 10., .3),
            (1, 2, "2900", "dimension", 300., 300., 0., 40., 10., 40., 10., .3),
            (2, 1, "Bad", "room", 100., 100., 0., 40., 10., 40., 10., .3),
            (2, 2, "Stue", "room", 100., 60., 0., 40., 10., 40., 10., 0.)]
    wall = spark.createDataFrame([(1, 60., 104., 140., 108.), (2, 60., 104., 140., 108.)],
                                 "sheet_id long, x0 double, y0 double, x1 double, y1 double")
    for cell in (128.0, 16.0):
        got = {(r.sheet_id, r.run_id): r for r in gate.place_clear(spark.createDataFrame(rows, cols), wall, cell).collect()}
        up = got[(1, 1)]
        assert up.moved and up.hidden == 0 and (up.cx_out, up.cy_out) == (100., 96.)
        assert not got[(1, 2)].moved            # not a room
        other = got[(2, 1)]                      # still clear of the label above
        assert other.moved and other.cy_out >= 90


def test_regions_against_flood_fill(spark):
    rng = random.Random(2)
    pts = {(s, rng.randrange(30), rng.randrange(30)) for s in range(3) for _ in range(300)}
    df = spark.createDataFrame([tuple(p) for p in pts], "sheet_id long, y int, x int")
    for diagonal in (True, False):
        want, left = set(), set(pts)
        while left:
            todo, seen = [left.pop()], []
            while todo:
                s, y, x = todo.pop()
                seen.append((s, y, x))
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (diagonal or abs(dx) + abs(dy) == 1) and (s, y + dy, x + dx) in left:
                            left.remove((s, y + dy, x + dx))
                            todo.append((s, y + dy, x + dx))
            ys, xs = [p[1] for p in seen], [p[2] for p in seen]
            want.add((seen[0][0], min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(seen)))
        got = {(r.sheet_id, r.x0, r.y0, r.x1, r.y1, r.area) for r in pixels.diff_regions(df, diagonal, cell=8.0).collect()}
        assert got == want


def png(path, rows):
    """A small RGB picture file."""
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\x00" + b"".join(bytes(p) for p in row) for row in rows)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_routes_and_pixels(spark, tmp_path):
    png(tmp_path / "a.png", [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (9, 8, 7)]])
    (tmp_path / "b.pdf").write_bytes(b"anything")
    (tmp_path / "c").write_bytes(b"junk %PDF-1.4")
    (tmp_path / "d.dat").write_bytes(b"hello")
    ok, bad = files.read_routes(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.route for r in ok.collect()} == {"a.png": "raster", "b.pdf": "vector", "c": "vector"}
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["d.dat"]
    (tmp_path / "img").mkdir()
    png(tmp_path / "img" / "a.png", [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (9, 8, 7)]])
    (tmp_path / "img" / "x.png").write_bytes(b"broken")
    px, unreadable = files.read_pixels(spark, str(tmp_path / "img"))
    assert {(r.y, r.x, r.b, r.g, r.r) for r in px.collect()} == {
        (0, 0, 0, 0, 255), (0, 1, 0, 255, 0), (1, 0, 255, 0, 0), (1, 1, 7, 8, 9)}
    assert unreadable.count() == 1


def test_truth_round_trip(spark, tmp_path):
    payload = {"image": "p.png", "dpi": 150, "zoom": 2.0833, "width_px": 1269, "height_px": 1314, "runs": [
        {"text": "Køkken", "bbox_px": [289.79, 303.96, 431.04, 361.21], "angle_deg": 0, "kind": "room", "cap_height_px": 41.2},
        {"text": "3200", "bbox_px": [474.08, 322.2, 508.43, 377.8], "angle_deg": 90, "kind": "dimension", "cap_height_px": 40.0}]}
    (tmp_path / "t.json").write_text(json.dumps(payload), encoding="utf-8")
    runs = truth.read_truth(spark, str(tmp_path / "t.json")).withColumn("sheet_id", F.lit(1))
    assert [(r.truth_idx, r.text, r.x1, r.angle_deg) for r in runs.orderBy("truth_idx").collect()] == [
        (0, "Køkken", 431.04, 0.0), (1, "3200", 508.43, 90.0)]
    sheets = runs.select("sheet_id", "image", "dpi", "zoom", "width_px", "height_px").distinct()
    truth.write_truth(truth.truth_payload(runs, sheets), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back.zoom == 2.0833 and [r.text for r in back.runs] == ["Køkken", "3200"]
    many = spark.range(25).select(F.lit(1).alias("sheet_id"), (F.col("id") * 7).alias("truth_idx"), F.lit("t").alias("text"), *[
        F.col("id").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(0.0).alias("angle_deg"), F.lit("room").alias("kind"),
        F.lit(1.0).alias("cap_height_px"))
    truth.write_truth(truth.truth_payload(many, sheets, part_runs=10), str(tmp_path / "parts"))
    again = truth.read_truth(spark, str(tmp_path / "parts"), one_per_file=False)
    assert sorted((r.truth_idx, r.x0) for r in again.collect()) == [(i, float(i)) for i in range(25)]
    lex = {"rooms": ["Stue"], "abbreviations": {"St": "Stue"}, "annotations": ["T"]}
    (tmp_path / "lex.json").write_text(json.dumps(lex), encoding="utf-8")
    v = truth.read_lexicon(spark, str(tmp_path / "lex.json"))
    assert v.rooms == ("Stue",) and v.abbreviations == (("St", "Stue"),)


def test_stream_intake_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "T04-R-V1.pdf").write_bytes(b"%PDF-1.4")
    (folder / "b.png").write_bytes(b"x")
    for _ in range(2):
        intake.run_available(intake.stream_intake(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state"))
        (folder / "c.bin").write_bytes(b"nothing known")
    got = {(r.mirrored_name, r.route) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("T04-S-V1.pdf", "vector"), ("b_mirrored.png", "raster"), ("c_mirrored.bin", None)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_recogniser_errors_are_rows(spark):
    def reader(row):
        if row["sheet_id"] == 2:
            raise OSError("no picture")
        return [([(0, 0), (1, 0), (1, 1), (0, 1)], " a ", 0.5), ([(0, 0)] * 4, "  ", 0.9)]

    df = spark.createDataFrame([(1, 0), (2, 0)], "sheet_id long, pass_id int")
    found, errors = hooks.recognise(df, reader)
    assert [(r.sheet_id, r.text, len(r.quad)) for r in found.collect()] == [(1, "a", 4)]
    assert [(r.sheet_id, r.error) for r in errors.collect()] == [(2, "OSError: no picture")]


def test_clean_path_at_any_depth(spark):
    cases = {"/a/b/c/d/e/f/../../../../../x.pdf": "/a/x.pdf", "/a/../../x.pdf": "/x.pdf", "a//b/./c/../x": "a/b/x",
             "../x": "../x", "a/../../x": "../x", "/": "/", "x": "x", "/a/b/": "/a/b/"}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    got = {r.path: r.clean for r in df.select("path", batch.clean_path(F.col("path")).alias("clean")).collect()}
    assert got == cases


def test_passes_beyond_the_known_angles_are_refused(spark):
    frame = spark.createDataFrame([(1,)], "sheet_id int")
    with pytest.raises(ValueError):
        detect.union_passes(*[frame] * (len(K.PASS_ANGLES) + 1))


def test_reads_in_are_reads_out(spark):
    quad = [(10.0, 10.0), (60.0, 10.0), (60.0, 20.0), (10.0, 20.0)]
    flat = [(5.0, 5.0)] * 4
    far = [(300.0, 300.0), (360.0, 300.0), (360.0, 320.0), (300.0, 320.0)]
    wide = [(0.0, 0.0), (1e12, 0.0), (1e12, 9.0), (0.0, 9.0)]
    passes = spark.createDataFrame(
        [(1, 0, 0, quad, "3470", 0.9), (1, 1, 9, quad, "x", 0.9), (2, 2, 0, quad, "3470", 0.9), (1, 3, 0, flat, "y", 0.9), (1, 4, 0, wide, "z", 0.9), (1, 5, 0, far, None, 0.9)],
        "sheet_id int, det_idx int, pass_id int, quad array<struct<x:double,y:double>>, text string, conf double")
    sheets = spark.createDataFrame([(1, 800.0, 600.0)], "sheet_id int, width double, height double")
    placed = reading.place_candidates(passes, sheets)
    assert {r.det_idx: r.error for r in placed.collect()} == {
        0: None, 1: "pass without an angle", 2: "sheet without a size", 3: "box without an area",
        4: "box far outside its sheet", 5: None}
    out = reading.read_runs(passes, sheets)
    assert out.runs.count() + out.dropped.count() + out.errors.count() == 6


def test_no_break_space_in_numbers(spark):
    df = spark.createDataFrame([("12,4 m²",), ("Room 1",)], "s string")
    rows = df.select(T.is_area(F.col("s")).alias("area"), F.regexp_extract("s", T.NUMBER_TAIL_PATTERN, 1).alias("n")).collect()
    assert rows[0].area is True and rows[1].n == "1"


def test_intake_takes_old_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "new.pdf").write_bytes(b"%PDF-1.4")
    run = lambda: intake.run_available(
        intake.stream_intake(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    old = time.time() - 30 * 86400
    for name in ("old.pdf", "old2.pdf"):
        (folder / name).write_bytes(b"%PDF-1.4")
        os.utime(folder / name, (old, old))
    run()
    run()
    paths = sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert paths == ["new.pdf", "old.pdf", "old2.pdf"]


def test_hidden_share_counts_crossing_rectangles_once(spark):
    box = "sheet_id int, run_id int, x0 double, y0 double, x1 double, y1 double"
    boxes = spark.createDataFrame([(1, 0, 0., 0., 10., 10.), (1, 1, 50., 50., 60., 60.), (2, 0, 0., 0., 10., 10.)], box)
    rng = random.Random(3)
    rects = [(1, 0., 0., 4., 10.), (1, 0., 0., 4., 10.), (1, 0., 3., 10., 5.), (1, 100., 0., 101., 1.)]
    many = [(2, *sorted(rng.sample(range(-2, 13), 2)), *sorted(rng.sample(range(-2, 13), 2))) for _ in range(9)]
    rects += [(s, float(a), float(c), float(b), float(d)) for s, a, b, c, d in many]
    occupied = spark.createDataFrame(rects, "sheet_id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.sheet_id, r.run_id): r.overlap for r in gate.hidden_share(boxes, occupied, ["run_id"]).collect()}
    cells = sum(any(a <= x < b and c <= y < d for _, a, b, c, d in many) for x in range(10) for y in range(10))
    assert got[1, 1] == 0 and abs(got[1, 0] - 0.52) < 1e-9 and abs(got[2, 0] - cells / 100) < 1e-9


def test_fonts_fit_by_their_different_characters(spark):
    glyphs = spark.createDataFrame([("A", ord(c), 0.5) for c in "abc￿"] + [("B", ord(c), 0.5) for c in "abcd"], "font string, cp int, em double")
    choices = spark.createDataFrame([(False, "none", 0), (False, "A", 1), (False, "B", 2), (True, "B", 1)], "bold boolean, font string, priority int")
    rows = [(0, "abba", False, "A"), (1, "a d", False, "A"), (2, "  ", False, "A"), (3, "xyz", False, "B"), (4, "a￿", False, "B"),
            (5, "abc", True, "A"), (6, "", True, "no"), (7, "a", None, None)]
    runs = spark.createDataFrame(rows, "run_id int, text string, bold boolean, font string")
    for fonts in (glyphs, sizes.font_tables(glyphs)):
        picked = {r.run_id: r.new_font for r in gate.pick_font(runs, choices, fonts).collect()}
        assert picked == {0: "A", 1: "B", 2: "A", 3: None, 4: "A", 5: "B", 6: "B", 7: None}
        missing = {r.run_id: r.m for r in gate.with_missing(runs, fonts, "m").collect()}
        assert missing == {0: "", 1: "d", 2: "", 3: "xyz", 4: "￿", 5: "", 6: "", 7: "a"}
