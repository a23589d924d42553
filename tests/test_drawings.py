import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake import storage
from draftlake.functions.style import palette_colour
from draftlake.operators import annotations, curves, expand, extents, hatch, inventory, running, segments, sheets
from draftlake.plans import documents, export
from draftlake.sources import dxf, schemas

INSERTS = "drawing_id long, block_name string, entity_seq long, type string, layer string, visible boolean, ref_block string, ins_x double, ins_y double, scale_x double, scale_y double, rot_deg double"


def test_palette():
    assert [palette_colour(i) for i in (1, 7, 10, 11, 20, 21, 33, 35, 49, 245, 250, 255, -1, 256)] == [(255, 0, 0), (0, 0, 0), (255, 0, 0), (255, 127, 127), (255, 63, 0), (255, 159, 127), (165, 124, 82), (127, 95, 63), (38, 33, 19), (127, 63, 79), (84,) * 3, (255,) * 3, (0, 0, 0), (0, 0, 0)]


def test_nearest_is_round_without_decimal_text(spark):
    from draftlake.functions.geometry import nearest, round6

    rng = random.Random(5)
    values = [s * v for s in (1, -1) for v in (0.0, 0.4, 0.5, 1.5, 2.5, 0.49999999999999994, 4503599627370495.5, 1e300, *(rng.uniform(0, 1e6) for _ in range(500)), *(rng.randrange(10**6) + 0.5 for _ in range(500)))] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", nearest(F.col("v")).alias("got"), F.round("v").alias("want"), round6(F.col("v") / 1e6).alias("six"))
    assert all(str(r.got) == str(r.want) and str(r.six) != "-0.0" for r in rows.collect())
    plan = rows.select("got")._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan.replace("rint(", "").lower()


def test_expansion(spark):
    drawings = spark.createDataFrame([(1,)], "drawing_id long")
    blocks = spark.createDataFrame([(1, 0, "A", 9.0, 9.0), (1, 1, "A", 1.0, 0.0), (1, 2, "B", 0.0, 0.0), (1, 3, "LOOP", 0.0, 0.0)], schemas.BLOCKS)
    rows = [
        (1, "", 1, "INSERT", "0", True, "A", 10.0, 0.0, 2.0, 1.0, 90.0), (1, "A", 1, "INSERT", "X", True, "B", 3.0, 1.0, -1.0, 1.0, 0.0),
        (1, "", 2, "INSERT", "0", True, "MISSING", 0.0, 0.0, 1.0, 1.0, 0.0), (1, "", 3, "INSERT", "0", False, "B", 0.0, 0.0, 1.0, 1.0, 0.0),
        (1, "B", 1, "DIMENSION", "0", True, "LOOP", None, None, None, None, None), (1, "", 4, "INSERT", "0", True, "LOOP", 0.0, 0.0, 1.0, 1.0, 0.0), (1, "LOOP", 1, "INSERT", "0", True, "LOOP", 1.0, 0.0, 1.0, 1.0, 0.0),
    ]
    inserts = spark.createDataFrame(rows, INSERTS)
    found = expand.instances(drawings, inserts, blocks).collect()
    b = next(r for r in found if r.block_name == "B")
    # (3 - 1) * 2 and 1 * 1, turned by 90 degrees, moved
    assert (round(b.at_x, 9), round(b.at_y, 9), b.scale_x, b.scale_y, b.turn) == (9.0, 4.0, -2.0, 1.0, 90.0)
    assert {r.block_name for r in found} == {"", "A", "B", "LOOP"} and max(r.depth for r in found) == 10
    assert all(r.bypass and r.scale_x == 1 for r in found if r.path.startswith("/1/1/1"))
    assert not [r for r in expand.instances(drawings, inserts, blocks, ["0"], dimensions="skip").collect() if r.block_name == "B"]


def test_extents_and_inventory(spark):
    rows = [("LINE", 0.0, 0.0, 4.0, 2.0, None, None, None), ("CIRCLE", None, None, None, None, 10.0, 10.0, 3.0), ("TEXT", -5.0, 1.0, None, None, None, None, None), ("HATCH", 99.0, 99.0, None, None, None, None, None)]
    entities = spark.createDataFrame([(1, "", i, t, "L", True, *x) for i, (t, *x) in enumerate(rows)], "drawing_id long, block_name string, entity_seq long, type string, layer string, visible boolean, x1 double, y1 double, x2 double, y2 double, cx double, cy double, radius double")
    entities = schemas.with_columns_of(entities, schemas.ENTITIES)
    drawings = spark.createDataFrame([(1, 6), (2, 0)], "drawing_id long, insunits int")
    boxes = export.drawing_boxes(drawings, entities, spark.createDataFrame([], schemas.BLOCKS))
    assert [tuple(r) for r in boxes.collect()] == [(1, -5.0, 0.0, 13.0, 13.0)]
    crops = spark.createDataFrame([(1, " 0, 1,2 ,3")], "drawing_id long, crop string")
    assert tuple(extents.cropped(boxes, crops).first()) == (1, 0.0, 1.0, 2.0, 3.0)
    layers = spark.createDataFrame([(1, 0, "L", -3, 1, 0), (1, 1, "M", 300, 0, 0)], schemas.LAYERS)
    assert [(r.name, r.r, r.g, r.b, r.visible, r.entity_count) for r in inventory.layer_info(layers, entities).orderBy("layer_seq").collect()] == [("L", 0, 255, 0, False, 4), ("M", 0, 0, 0, True, 0)]
    blocks = spark.createDataFrame([(1, 1, "b", 0.0, 0.0), (1, 0, "*Model", 0.0, 0.0), (1, 2, "a", 0.0, 0.0)], schemas.BLOCKS)
    info = inventory.drawing_info(drawings, boxes, entities, blocks).orderBy("drawing_id").collect()
    assert (info[0].unit_name, info[0].mm_per_unit, info[0].entity_count, info[0].block_names) == ("meters", 1000.0, 4, ["b", "a"])
    assert (info[1].unit_name, info[1].entity_count, info[1].min_x) == ("unitless", 0, None)


def test_edges_and_curves(spark):
    v = [{"x": float(x), "y": float(y), "bulge": b} for x, y, b in ((0, 0, 0.0), (2, 0, 1.0), (2, 2, 0.0))]
    poly = spark.createDataFrame([("LWPOLYLINE", True, v), ("LWPOLYLINE", False, v), ("POLYLINE", True, v), ("LWPOLYLINE", True, v[:1])], f"type string, closed boolean, vertices array<{schemas.VERTEX}>")
    edges = segments.polyline_edges(poly)
    assert edges.groupBy("type", "closed").count().orderBy("type", "closed").collect() == [("LWPOLYLINE", False, 2), ("LWPOLYLINE", True, 3), ("POLYLINE", True, 2)]
    arc = curves.bulge_arcs(edges.limit(2)).first()  # a half circle to the right of an upward edge
    assert (round(arc.cx, 9), round(arc.cy, 9), round(arc.radius, 9), round(arc.end_deg - arc.start_deg, 6)) == (2.0, 1.0, 1.0, 180.0)
    arcs = spark.createDataFrame([(0.0, 0.0, 1.0, 350.0, 15.0)], "cx double, cy double, radius double, start_deg double, end_deg double")
    chords = segments.arc_chords(arcs).orderBy("chord_no").collect()
    assert len(chords) == 3 and round(math.degrees(math.atan2(chords[-1].y2, chords[-1].x2)), 6) == 15.0
    knots, points = [0, 0, 0, 0, 1, 2, 2, 2, 2], [(0, 0), (1, 2), (3, 2), (4, 0), (6, 1)]

    def value(i, p, t):
        if p == 0:
            return 1.0 if knots[i] <= t < knots[i + 1] else 0.0
        a = (t - knots[i]) / (knots[i + p] - knots[i]) * value(i, p - 1, t) if knots[i + p] > knots[i] else 0
        b = (knots[i + p + 1] - t) / (knots[i + p + 1] - knots[i + 1]) * value(i + 1, p - 1, t) if knots[i + p + 1] > knots[i + 1] else 0
        return a + b

    splines = spark.createDataFrame([(1, 3, [{"x": float(x), "y": float(y)} for x, y in points], [float(k) for k in knots]), (2, 3, [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}], [0.0]), (3, 3, [{"x": 1.0, "y": 2.0}], [0.0]), (4, 3, None, None)], f"id int, degree int, control_points array<{schemas.POINT}>, knots array<double>")
    got = curves.spline_points(splines).orderBy("id", "point_no").collect()
    assert [r.id for r in got] == [1] * 50 + [2] * 2 and (got[50].x, got[51].y) == (1.0, 4.0)
    for r in got[:49]:
        t = 2 * r.point_no / 49
        assert abs(r.x - sum(value(i, 3, t) * x for i, (x, _) in enumerate(points))) < 1e-9
    assert (got[49].x, got[49].y) == (6.0, 1.0)


def test_hatch(spark):
    square = [[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))]]
    line = {"angle": 0.0, "base_x": 0.0, "base_y": 1.0, "offset_x": 0.0, "offset_y": 4.0, "dashes": []}
    rows = [(1, False, 0.0, square, [line]), (2, True, 1.0, square, [line]), (3, False, 1.0, square, [line | {"offset_y": 0.0}]), (4, False, 1.0, square, [line | {"dashes": [3.0, -2.0, 0.0]}]), (5, False, 1.0, [square[0][:2]], [line])]
    hatches = spark.createDataFrame(rows, f"hatch_id int, solid_fill boolean, pattern_scale double, paths array<array<{schemas.POINT}>>, pattern_lines array<{schemas.PATTERN_LINE}>")
    got = hatch.hatch_segments(hatches).orderBy("hatch_id", "line_no", "dash_no").collect()
    one = [(r.x1, r.y1, r.x2, r.y2) for r in got if r.hatch_id == 1]
    assert sorted(min(a, c) for a, _, c, _ in one) == [0, 0, 0] and [r[1] for r in one] == [1, 5, 9]
    dashed = [(round(min(r.x1, r.x2), 6), round(max(r.x1, r.x2), 6)) for r in got if r.hatch_id == 4 and r.line_no == 0]
    assert dashed == [(0.0, 3.0), (5.0, 5.1), (5.1, 8.1)]  # drawn, gap, dot, drawn, gap to the end
    assert {r.hatch_id for r in got} == {1, 4}


def plain_clip(path, lines):
    """Every line against every edge, as the rule says it."""
    out = {}
    for no, (px, py, dx, dy) in lines.items():
        found = []
        for (ax, ay), (bx, by) in zip(path, path[1:] + path[:1], strict=True):
            ex, ey = bx - ax, by - ay
            den = dx * ey - dy * ex
            if abs(den) >= 1e-12 and -1e-10 <= ((ax - px) * dy - (ay - py) * dx) / den <= 1 + 1e-10:
                found.append(((ax - px) * ey - (ay - py) * ex) / den)
        found.sort()
        for i in range(0, len(found) - 1, 2):
            if found[i + 1] - found[i] >= 1e-10:
                out[no, i // 2] = (found[i], found[i + 1])
    return out


def test_clip_equals_every_line_with_every_edge(spark):
    """Random paths, some with vertices on lines, edges along them, and lines far from the origin."""
    rng = random.Random(6)
    rows, paths = [], {}
    for i in range(60):
        shift = rng.choice([0, 0, 1e6])
        path = [(rng.randrange(0, 40) + shift, rng.randrange(0, 40) + shift) for _ in range(rng.randrange(3, 14))]
        if i % 3 == 0:
            path = [(rng.random() * 40 + shift, rng.random() * 40) for _ in range(200)]
        patterns = [{"angle": rng.choice([0.0, 90.0, 45.0, 30.0, -77.5]), "base_x": rng.choice([0.0, 0.5]), "base_y": 0.0, "offset_x": 0.0, "offset_y": rng.choice([1.0, 0.37, 5.0]), "dashes": []} for _ in range(2)]
        rows.append((i, i % 2, False, rng.choice([1.0, 0.5]), [[{"x": float(x), "y": float(y)} for x, y in path]] * 2, patterns))
        paths[i] = path
    hatches = spark.createDataFrame(rows, f"hatch_id int, drawing_id int, solid_fill boolean, pattern_scale double, paths array<array<{schemas.POINT}>>, pattern_lines array<{schemas.PATTERN_LINE}>")
    lines = {}
    for r in hatch.pattern_lines(hatches).collect():
        lines.setdefault((r.hatch_id, r.path_no, r.pattern_no), {})[r.line_no] = (r.px, r.py, r.dir_x, r.dir_y)
    want = {(*k, *n): v for k, own in lines.items() for n, v in plain_clip(paths[k[0]], own).items()}
    got = {}
    for r in hatch.clip(hatches, ["drawing_id", "hatch_id"]).collect():
        px, py, dx, dy = lines[r.hatch_id, r.path_no, r.pattern_no][r.line_no]
        got[r.hatch_id, r.path_no, r.pattern_no, r.line_no, r.part_no] = ((r.x1 - px) * dx + (r.y1 - py) * dy, (r.x2 - px) * dx + (r.y2 - py) * dy)
    assert len(want) > 5000 and got.keys() == want.keys()
    assert all(abs(a - b) < 1e-6 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_clip_of_many_edges_is_linear(spark):
    """A wavy ring of 10,000 edges under 2,000 lines: crossings, not lines x edges."""
    n = 10_000
    ring = [{"x": (100 + 3 * math.sin(a * 41)) * math.cos(a), "y": (100 + 3 * math.sin(a * 41)) * math.sin(a)} for a in (2 * math.pi * i / n for i in range(n))]
    pattern = {"angle": 17.0, "base_x": 0.0, "base_y": 0.0, "offset_x": 0.0, "offset_y": 0.1, "dashes": []}
    hatches = spark.createDataFrame([(1, False, 1.0, [ring], [pattern])], f"hatch_id int, solid_fill boolean, pattern_scale double, paths array<array<{schemas.POINT}>>, pattern_lines array<{schemas.PATTERN_LINE}>")
    hatch.clip(hatches.limit(0)).count()
    began = time.time()
    parts = hatch.clip(hatches).agg(F.count("*").alias("n"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length")).first()
    assert time.time() - began < 5
    area = abs(sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    assert parts.n > 2000 and abs(parts.length * 0.1 * math.cos(math.radians(17)) - area) < 0.001 * area
    plan = hatch.crossings(hatches)._jdf.queryExecution().optimizedPlan().toString()
    assert "vertices" not in plan.splitlines()[0] and plan.count("RepartitionByExpression") == 1


def test_splines_of_all_shapes_in_one_batch(spark):
    """Splines are solved together by shape; each is as if it were alone."""
    rng = random.Random(3)
    rows = []
    for i in range(80):
        degree, n = rng.randrange(1, 4), rng.randrange(2, 7)
        inner = sorted(rng.random() for _ in range(max(0, n - degree - 1)))
        knots = [0.0] * (degree + 1) + inner + [1.0] * (degree + 1)
        rows.append((i, degree, [{"x": rng.random(), "y": rng.random()} for _ in range(n)], knots[: len(knots) if n > degree else 2]))
    splines = spark.createDataFrame(rows, f"id int, degree int, control_points array<{schemas.POINT}>, knots array<double>").coalesce(1)
    alone = {}
    for i, degree, points, knots in rows:
        xy = np.array([[(p["x"], p["y"]) for p in points]])
        alone[i] = curves.spline_curves(xy, degree, np.array([knots]))[0]
    for r in curves.spline_lines(splines).collect():
        got = np.array([(p.x, p.y) for p in r.points])
        assert got.shape == alone[r.id].shape and np.allclose(got, alone[r.id], atol=1e-12)
        assert np.allclose(got[[0, -1]], [[p["x"], p["y"]] for p in (rows[r.id][2][0], rows[r.id][2][-1])])
    assert len(alone) == curves.spline_lines(splines).count()


def test_sheets(spark):
    names = spark.createDataFrame([(s,) for s in ("A4", "a4", "A0", "400x300", "100.5x200.5", "bad", "0x100", "x")], "paper string")
    w, h = sheets.paper_size("paper")
    assert [tuple(r) for r in names.select(w, h).collect()] == [(210, 297), (210, 297), (841, 1189), (400, 300), (100.5, 200.5), (None, None), (None, None), (None, None)]
    scales = spark.createDataFrame([(s,) for s in ("1:100", "2:1", " 1 : 50", "bad", "0:100", "1:0", "1")], "scale string")
    assert [r[0] for r in scales.select(sheets.ratio("scale")).collect()] == [0.01, 2.0, 0.02, None, None, None, None]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10000.0, 5000.0)], "drawing_id long, min_x double, min_y double, max_x double, max_y double")
    units = boxes.select("drawing_id", F.lit(1.0).alias("mm_per_unit"))
    plan, _ = sheets.sheet_plan(boxes, units, spark.createDataFrame([(1, "A4", "1:10", 10.0, "center", False, True)], "sheet_id int, paper string, scale string, margin double, align string, auto_paper boolean, tile boolean"))
    p = plan.first()
    assert (p.landscape, p.cols, p.rows, p.pages) == (True, 4, 3, 12)
    tiles = sheets.sheet_tiles(plan).orderBy("page").collect()
    assert len(tiles) == 12 and (tiles[0].tile_min_x, tiles[0].tile_max_y) == (0.0, 5000.0) and round(tiles[1].tile_min_x, 6) == 2770.0
    lines = spark.createDataFrame([(1, 7, 0.0, 0.0, 10000.0, 5000.0), (1, 8, 20000.0, 0.0, 20001.0, 1.0)], "drawing_id long, seg_id long, min_x double, min_y double, max_x double, max_y double")
    assert sheets.tile_assignment(lines, plan).groupBy("seg_id").count().collect() == [(7, 12)]


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("Hello", "Hello"), (r"{\fArial;Hello}", "Hello"), (r"Line1\PLine2", "Line1 Line2"), (r"{\fArial|b1;Bold}", "Bold"), (r"al Narrow|b0|i0|c238|p0;text", "text"), (r"tail} \{kept\}", " {kept}"),
        ("%%c50 %%d%%P%%%", "Ø50 °±%"), (r"\S1/2; \S3#4; \Sa ^ b;", "1/2 3/4 ab"), (r"a\~b\\c\zd", r"a b\c\zd"), ("one^Jtwo", "one two"), (r"\Pfirst", "first"), (r"\A1;\Q30;\T2;\pxi1;x\Xy", "xy"), ("", ""), ("{", ""), (r"\H2", ""),
    ],
)
def test_plain_text(text, plain):
    said = ""
    for run, new_line, _ in annotations.parse_runs(text):
        said += " " if new_line and said else run
    assert said == plain


def test_runs(spark):
    runs = [(t, n, s) for t, n, s in annotations.parse_runs(r"a{\fArial|b1|i1;B\H2;C\H0.5x;D}\C1;e\c255;f\Lg\lh\W0.8x;i\Pj") if not n]
    assert [t for t, _, _ in runs] == ["a", "B", "C", "D", "e", "f", "g", "hi", "j"]
    style = {t: s for t, _, s in runs}
    assert style["B"].bold and style["B"].italic and style["B"].font == "Arial" and not style["a"].bold and not style["e"].bold
    assert style["C"].height == 2 and (style["D"].height, style["D"].relative_height) == (0, 0.5) and style["e"].height == 0
    assert (style["e"].r, style["f"].b, style["g"].underline, style["hi"].underline, style["hi"].width_factor) == (255, 255, True, False, 0.8)
    texts = spark.createDataFrame([(1, r"\P\Pa\Pb", None), (2, None, None), (3, "x", ["y", "z"])], "id int, text string, text_ext array<string>")
    assert sorted(map(tuple, annotations.plain_texts(annotations.full_text(texts)).collect())) == [(1, "a b"), (2, ""), (3, "xyz")]


FILE = """  0
SECTION
  2
HEADER
  9
$DWGCODEPAGE
  3
{page}
  9
$INSUNITS
 70
     6
  0
ENDSEC
  0
SECTION
  2
TABLES
  0
LAYER
  2
Fal
 70
1
 62
-3
  0
ENDSEC
  0
SECTION
  2
BLOCKS
  0
BLOCK
  2
B1
 10
5
 20
6
  0
LINE
  8
Fal
 10
0
 20
0
 11
1
 21
2
  0
ENDBLK
  0
ENDSEC
  0
SECTION
  2
ENTITIES
  0
INSERT
  8
0
  2
B1
 10
7
 41
2
 50
90
  0
LWPOLYLINE
  8
Fal
 70
1
 10
0
 20
0
 42
0.5
 10
3
 20
0
  0
POLYLINE
  8
Fal
  0
VERTEX
 10
1
 20
1
  0
VERTEX
 10
2
 20
2
 42
1
  0
SEQEND
  0
SPLINE
 71
2
 40
0
 40
1
 10
1
 20
2
 10
3
 20
4
  0
MTEXT
  8
Ajtó
  3
abc
  1
tő
 10
1
 20
1
 60
1
  0
HATCH
  8
Fal
 70
0
 91
1
 92
2
 93
3
 10
0
 20
0
 10
4
 20
0
 10
4
 20
4
 75
0
 41
1.5
 53
45
 43
1
 44
2
 45
0
 46
3
 79
2
 49
5
 49
-1
 98
0
  0
ENDSEC
  0
EOF
"""


def test_ingest(spark):
    old = FILE.format(page="ANSI_1250").encode("cp1250")
    files = spark.createDataFrame([("a.dxf", bytearray(old)), ("b.dxf", bytearray(FILE.format(page="ANSI_1252").replace("\n", "\r\n").encode())), ("c.dxf", bytearray(b"")), ("d.dxf", bytearray(b"junk"))], "path string, content binary")
    assert dxf.detect_codec(old) == "cp1250" and dxf.detect_codec(FILE.encode()) is None and dxf.detect_codec(b"plain") is None
    assert dxf.detect_codec("fő c238".encode("cp1250")) == "cp1250" and dxf.detect_codec(b"\xf5") is None
    t = {k: v.cache() for k, v in dxf.tables(files).items()}
    ids = {r.path: r.drawing_id for r in t["drawings"].collect()}
    assert len(ids) == 4 and {r.insunits for r in t["drawings"].where(F.col("path").isin("a.dxf", "b.dxf")).collect()} == {6}
    for path in ("a.dxf", "b.dxf"):
        mine = {r.type: r for r in t["entities"].where(F.col("drawing_id") == ids[path]).collect()}
        assert mine["LINE"].block_name == "B1" and (mine["LINE"].x2, mine["LINE"].y2) == (1.0, 2.0)
        assert mine["INSERT"].block_name == "" and (mine["INSERT"].ref_block, mine["INSERT"].ins_x, mine["INSERT"].scale_x, mine["INSERT"].scale_y, mine["INSERT"].rot_deg) == ("B1", 7.0, 2.0, 1.0, 90.0)
        assert mine["LWPOLYLINE"].closed and [tuple(v) for v in mine["LWPOLYLINE"].vertices] == [(0.0, 0.0, 0.5), (3.0, 0.0, 0.0)]
        assert [tuple(v) for v in mine["POLYLINE"].vertices] == [(1.0, 1.0, 0.0), (2.0, 2.0, 1.0)]
        assert mine["SPLINE"].knots == [0.0, 1.0] and len(mine["SPLINE"].control_points) == 2 and mine["SPLINE"].degree == 2
        assert (mine["MTEXT"].text, mine["MTEXT"].text_ext, mine["MTEXT"].layer, mine["MTEXT"].visible) == ("tő", ["abc"], "Ajtó", False)
        h = mine["HATCH"]
        assert not h.solid_fill and h.pattern_scale == 1.5 and [len(p) for p in h.paths] == [3] and (h.pattern_lines[0].angle, h.pattern_lines[0].offset_y, h.pattern_lines[0].dashes) == (45.0, 3.0, [5.0, -1.0])
        layer = t["layers"].where(F.col("drawing_id") == ids[path]).first()
        assert (layer.name, layer.color, layer.flags) == ("Fal", -3, 1)
        assert [(r.name, r.base_x, r.base_y) for r in t["blocks"].where(F.col("drawing_id") == ids[path]).collect()] == [("B1", 5.0, 6.0)]


def test_ingest_in_splits(spark, tmp_path):
    """Files that many tasks read piece by piece give the tables that they give as rows, whatever the code page and the ends of lines."""
    rng = random.Random(1)
    entities = "".join(f"  0\nLINE\n  8\nréteg {i % 3}\n 10\n{rng.random()}\n 20\n{i}\n 11\n1.5\n 21\n2\n" if i % 4 else f"  0\nPOLYLINE\n  8\nő\n 70\n1\n" + "".join(f"  0\nVERTEX\n 10\n{k}\n 20\n{i}\n" for k in range(i % 7)) + "  0\nSEQEND\n" for i in range(1500))
    large = FILE.format(page="ANSI_1250").replace("  0\nEOF\n", "").rstrip("\n") + "\n  0\nSECTION\n  2\nENTITIES\n" + entities + "  0\nENDSEC\n  0\nEOF\n"
    contents = {"a.dxf": large.encode("cp1250"), "b.DXF": large.replace("\n", "\r\n").encode(), "c.dxf": FILE.format(page="ANSI_1250").encode("cp1250"), "d.dxf": b"junk", "e.dxf": "  0\nSECTION\n  2\nENTITIES\n  0\nTEXT\n  1\nfő c238\n".encode("cp1250"), "f.dxf": b"\xf5\n", "g.txt": b"no drawing"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    assert max(map(len, contents.values())) > 60_000
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert dxf.read_lines(spark, str(tmp_path)).where(F.endswith("path", F.lit("a.dxf"))).count() == large.count("\n")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
        got = dxf.read_tables(spark, str(tmp_path), block=100)
        kinds = {r.path.rsplit("/")[-1]: r.codec for r in dxf.codecs(dxf.read_lines(spark, str(tmp_path))).collect()}
        got = {k: v.collect() for k, v in got.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert kinds == {k: dxf.detect_codec(v) for k, v in contents.items() if k != "g.txt"}
    want = {k: v.collect() for k, v in dxf.tables(dxf.read_files(spark, str(tmp_path))).items()}
    assert len(want["drawings"]) == 6 and len(want["entities"]) > 3000
    for k in want:
        assert sorted(map(str, got[k])) == sorted(map(str, want[k])), k


def test_small_files_are_read_whole(spark, tmp_path, monkeypatch):
    """In one pass, with the tables that they have when they are read in splits, or some of them."""
    text = FILE.format(page="ANSI_1250")
    contents = {"a.dxf": text.encode("cp1250"), "b.dxf": b"\xef\xbb\xbf" + text.encode(), "c.dxf": text.replace("\n", "\r\n").encode() + b"  0", "d.dxf": (text + "  0\n").encode("cp1250"), "e.dxf": b"", "f.dxf": b"\xf5\n", "g.dxf": text.encode("cp1250") * 2}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = {}
    for most in (0, 10, len(contents["a.dxf"]), 4 << 20):
        monkeypatch.setattr(dxf, "WHOLE_FILE", most)
        if most == 4 << 20:
            monkeypatch.setattr(dxf, "read_groups", None)
        found[most] = {k: sorted(map(str, v.collect())) for k, v in dxf.read_tables(spark, str(tmp_path)).items()}
    assert len(found[0]["drawings"]) == 6 and len(found[0]["entities"]) > 20
    assert all(v == found[0] for v in found.values())


def test_tile_lengths_are_those_of_the_pieces(spark):
    """Lines, curves and single points on tiled sheets and others; what is filled or no number does not count."""
    plan = spark.createDataFrame([(1, 1, 10.0, 100.0, 80.0, 4, 3), (1, 2, 5.0, 400.0, 300.0, 1, 1), (2, 1, 10.0, 100.0, 80.0, 2, 2)], "drawing_id long, sheet_id int, margin double, print_w double, print_h double, cols int, rows int")
    rng = random.Random(3)
    point = lambda: {"x": rng.choice([10.0, 110.0, rng.uniform(-50, 500)]), "y": rng.choice([10.0, 90.0, rng.uniform(-50, 300)])}
    rows = [(rng.choice([1, 1, 2, 3]), rng.choice([1, 2]), rng.choice(["line", "arc"]), [point() for _ in range(rng.choice([0, 1, 2, 2, 5]))], False) for _ in range(300)]
    rows += [(1, 1, "line", [{"x": 10.0, "y": 20.0}, {"x": 410.0, "y": 20.0}], False), (1, 1, "solid", [point() for _ in range(4)], True), (1, 1, "line", None, False), (1, 1, "gone", [{"x": None, "y": 1.0}, point()], False)]
    linework = spark.createDataFrame(rows, "drawing_id long, sheet_id int, kind string, points array<struct<x: double, y: double>>, filled boolean")
    a, b = (F.get("points", F.lit(i)) for i in (0, 1))
    pieces = sheets.tile_linework(linework, plan).where("NOT filled").groupBy("drawing_id", "sheet_id", "page", "kind").agg(F.count("*").alias("pieces"), F.sum(F.hypot(b["x"] - a["x"], b["y"] - a["y"])).alias("length"))
    key = lambda df: sorted((*r[:4], r.pieces, round(r.length, 6)) for r in df.select("drawing_id", "sheet_id", "page", "kind", "pieces", "length").collect())
    found = sheets.tile_lengths(linework, plan)
    assert key(found) == key(pieces) and len(key(found)) > 20
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no piece becomes a row


def test_instances_without_checkpoints(spark, monkeypatch):
    """Levels are stored; inserts of the drawings meet the first level only, but for a block that is named as drawings are."""
    monkeypatch.setattr(expand, "cut_lineage", None)
    drawings = spark.createDataFrame([(1,), (2,)], "drawing_id long")
    names = "drawing_id long, block_name string, entity_seq long, type string, layer string, visible boolean, ref_block string, ins_x double, ins_y double, scale_x double, scale_y double, rot_deg double"
    inserts = spark.createDataFrame([(d, b, n, "INSERT", "0", True, r, 10.0, 0.0, 1.0, 1.0, 0.0) for d, b, n, r in ((1, "", 1, "A"), (1, "", 2, "B"), (1, "A", 3, "B"), (2, "", 1, "A"), (2, "", 2, "C"))], names)
    blocks = [(1, 0, "A", 0.0, 0.0), (1, 1, "B", 0.0, 0.0), (2, 0, "A", 0.0, 0.0)]
    found = lambda rows: sorted((r.drawing_id, r.path, r.at_x) for r in expand.instances(drawings, inserts, spark.createDataFrame(rows, schemas.BLOCKS)).collect())
    assert found(blocks) == [(1, "", 0.0), (1, "/1", 10.0), (1, "/1/3", 20.0), (1, "/2", 10.0), (2, "", 0.0), (2, "/1", 10.0)]
    inserts = inserts.union(spark.createDataFrame([(2, "A", 9, "INSERT", "0", True, "", 10.0, 0.0, 1.0, 1.0, 0.0)], names))
    looped = [p for d, p, _ in found([*blocks, (2, 1, "", 0.0, 0.0)]) if d == 2]
    assert looped == ["" if not k else "/1" + "/9/1" * (k // 2) if k % 2 else "/1" + "/9/1" * (k // 2 - 1) + "/9" for k in range(11)]


def test_records_leave_a_task_whole(spark):
    """Tags are not shuffled to become records, and only polylines meet their vertices by a join."""
    files = spark.createDataFrame([("a.dxf", bytearray(FILE.format(page="ANSI_1252").encode()))], "path string, content binary")
    entities = dxf.tables(files)["entities"]
    assert entities.count() > 3
    plan = dxf._records(files.selectExpr("1L AS drawing_id", "array(content) AS pieces", "CAST(NULL AS STRING) AS codec", "0L AS base", "CAST(NULL AS STRING) AS section", "CAST(NULL AS STRING) AS block_name", "CAST(NULL AS LONG) AS owner"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.where("type = 'LINE'").first().block_name == "B1"


def test_running_totals_and_values(spark):
    rng = random.Random(2)
    rows = [(k, i * 3 + k, rng.randrange(5), rng.choice([None, None, "a", "b"])) for k, n in ((0, 500), (1, 1), (2, 77)) for i in range(n)]
    got = running.running(spark.createDataFrame(rows, "k int, i long, v long, w string").repartition(5), ["k"], "i", ["v"], ["w"], block=16)
    total, last, want = {}, {}, []
    for k, i, v, w in rows:
        total[k], last[k] = total.get(k, 0) + v, w or last.get(k)
        want.append((k, i, total[k], last[k]))
    assert sorted(map(str, map(tuple, got.select("k", "i", "v", "w").collect()))) == sorted(map(str, want))
    before = running.running(spark.createDataFrame(rows, "k int, i long, v long, w string"), ["k"], "i", maxima=["v"], block=16).collect()
    assert {(r.k, r.i): r.v for r in before} == {(k, i): max((v for a, j, v, _ in rows if a == k and j < i), default=None) for k, i, *_ in rows}


def test_tiles_of_linework(spark):
    """Pieces on tiles, put together again, are the lines; no piece leaves its page; a long diagonal crosses tiles in proportion to its length."""
    rng = random.Random(8)
    kinds = "drawing_id long, sheet_id int, entity_seq long, kind string, filled boolean, points array<struct<x: double, y: double>>"
    rows = []
    for i in range(200):
        points = [(rng.uniform(-30, 330), rng.uniform(-30, 240)) for _ in range(rng.randrange(2, 5))]
        rows.append((1, 1, i, "line", False, [{"x": x, "y": y} for x, y in points]))
    rows += [(1, 1, 900, "line", False, [{"x": 15.0, "y": 20.0}, {"x": 15.0, "y": 200.0}]), (1, 1, 901, "line", False, [{"x": 60.0, "y": 50.0}, {"x": 60.0, "y": 50.0}]), (1, 1, 902, "point", True, [{"x": 10.0, "y": 10.0}]), (1, 1, 903, "solid", True, [{"x": x, "y": y} for x, y in ((12.0, 12.0), (150.0, 12.0), (12.0, 89.0), (150.0, 89.0))]), (1, 1, 904, "line", False, [{"x": -5.0, "y": 5.0}, {"x": 300.0, "y": 5.0}])]
    plan = spark.createDataFrame([(1, 1, 10.0, 50.0, 40.0, 6, 5)], "drawing_id long, sheet_id int, margin double, print_w double, print_h double, cols int, rows int")
    got = {}
    for r in sheets.tile_linework(spark.createDataFrame(rows, kinds), plan).collect():
        assert r.page == r.row * 6 + r.col + 1 and 0 <= r.col < 6 and 0 <= r.row < 5
        if not r.filled:
            assert all(10 - 1e-6 <= p.x <= 60 + 1e-6 and 10 - 1e-6 <= p.y <= 50 + 1e-6 for p in r.points)
        got.setdefault(r.entity_seq, []).append(r)
    inside = lambda a, b, steps=4000: sum(10 <= a["x"] + t * (b["x"] - a["x"]) < 310 and 10 <= a["y"] + t * (b["y"] - a["y"]) < 210 for t in ((k + 0.5) / steps for k in range(steps))) / steps * math.hypot(b["x"] - a["x"], b["y"] - a["y"])
    for _, _, i, _, filled, points in rows:
        if not filled and i < 901:
            length = sum(math.dist(r.points[0], r.points[1]) for r in got.get(i, []))
            assert abs(length - sum(inside(a, b) for a, b in zip(points, points[1:], strict=False))) < 0.3, i
            back = {(r.piece_no, round(p.x + 50 * r.col, 6), round(p.y + 40 * r.row, 6)) for r in got.get(i, []) for p in r.points}
            for k, p in enumerate(points):
                if 10 < p["x"] < 310 and 10 < p["y"] < 210:
                    assert (min(k, len(points) - 2), round(p["x"], 6), round(p["y"], 6)) in back
    assert len(got[900]) == 5 and [(r.col, r.row, tuple(r.points[0])) for r in got[901]] == [(1, 1, (10.0, 10.0))] and len(got[902]) == 1 and len(got[903]) == 3 * 2 and 904 not in got
    far = spark.createDataFrame([(1, 1, 0.0, 0.0, 1e5, 1e5)], "drawing_id long, sheet_id int, x1 double, y1 double, x2 double, y2 double")
    huge = spark.createDataFrame([(1, 1, 0.0, 10.0, 10.0, 10_000, 10_000)], "drawing_id long, sheet_id int, margin double, print_w double, print_h double, cols int, rows int")
    assert 10_000 <= sheets.tile_lines(far, huge).count() <= 20_000


def test_blocks_that_insert_themselves_are_counted_first(spark):
    """Drawing 1 has a block of ten inserts of itself: ten to the tenth instances. Counts equal the rows of the expansion where there is one."""
    def insert(d, block, k, ref, kind="INSERT", layer="L", visible=True):
        return d, block, k, kind, layer, visible, ref, 1.0, 0.0, 1.0, 1.0, 0.0

    rows = [insert(1, "", 0, "A"), *[insert(1, "A", k, "A") for k in range(10)]]
    rows += [insert(2, "", 0, "A"), insert(2, "", 1, "A", layer="M"), insert(2, "", 2, "D", "DIMENSION"), insert(2, "A", 0, "B"), insert(2, "A", 1, "B", visible=False), insert(2, "D", 0, "A", layer="M"), insert(2, "B", 0, "none"), insert(2, "B", 1, "B")]
    inserts = spark.createDataFrame(rows, INSERTS)
    blocks = spark.createDataFrame([(d, i, n, 0.0, 0.0) for d in (1, 2) for i, n in enumerate("AABD")], schemas.BLOCKS)
    drawings = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "drawing_id long, insunits int")
    began = time.time()
    counts = {r.drawing_id: r.instances for r in expand.instance_counts(drawings.select("drawing_id"), inserts, blocks).collect()}
    assert counts[1] == 1 + sum(10.0**k for k in range(10)) and counts[3] == 1
    good, large = expand.split_large(drawings, inserts, blocks)
    assert {r.drawing_id for r in good.collect()} == {2, 3} and [(r.drawing_id, r.reason) for r in large.collect()] == [(1, "too many block instances: 1111111112")]
    assert time.time() - began < 180  # seconds, on a busy machine; the expansion would have a billion rows
    for layers, dimensions in ((None, "identity"), (["L"], "identity"), (["L"], "skip"), (None, "skip")):
        rest = drawings.where("drawing_id > 1").select("drawing_id")
        want = {r.drawing_id: r["count"] for r in expand.instances(rest, inserts, blocks, layers, dimensions).groupBy("drawing_id").count().collect()}
        assert {r.drawing_id: r.instances for r in expand.instance_counts(rest, inserts, blocks, layers, dimensions).collect()} == want


def test_export_files_and_placement(spark, tmp_path):
    rows = [(1, "", k, "LINE", "WALL", True, 256, -2, 0.0, y, 4000.0, y) for k, y in enumerate((0.0, 300.0))]
    entities = schemas.with_columns_of(spark.createDataFrame(rows, "drawing_id long, block_name string, entity_seq long, type string, layer string, visible boolean, color int, lineweight int, x1 double, y1 double, x2 double, y2 double"), schemas.ENTITIES)
    drawings = spark.createDataFrame([(1, 4)], "drawing_id long, insunits int")
    out = export.wall_export({"drawings": drawings, "entities": entities, "layers": spark.createDataFrame([], schemas.LAYERS), "blocks": spark.createDataFrame([], schemas.BLOCKS)})
    export.write_export(out, str(tmp_path / "out"), buckets=4, xml=True)
    back = spark.read.parquet(str(tmp_path / "out/walls")).first()
    assert (back.thickness, back.length, back.y1) == (0.3, 4.0, 0.15)
    assert documents.read_documents(spark, str(tmp_path / "out/documents"))["walls"].first().thickness == 0.3
    meta = spark.read.parquet(str(tmp_path / "out/drawing_meta")).first()
    assert (meta.scene_width_m, meta.scene_height_m, meta.source_units, meta.px_per_metre) == (4.0, 0.3, "millimeters", round(0.01 * 300 * 1000 / 25.4, 6))
    texts = spark.createDataFrame([(1, 5, "MTEXT", 10.0, 20.0, 2.0, math.pi / 2), (1, 6, "TEXT", 0.0, 0.0, 0.001, 30.0)], "drawing_id long, entity_seq long, type string, x1 double, y1 double, text_height double, text_rot_deg double")
    texts = texts.withColumns({k: F.lit(v) for k, v in expand.IDENTITY.items()})
    plan = spark.createDataFrame([(1, 1, 2.0, 0.0, 100.0, 10.0, 1.0, 3.0)], "drawing_id long, sheet_id int, page_scale double, min_x double, max_y double, margin double, offset_x double, offset_y double")
    a, b = annotations.text_placement(texts, plan).orderBy("entity_seq").collect()
    assert (a.x, a.y, a.height_mm, round(a.turn_deg, 9)) == (31.0, 173.0, 4.0, 90.0) and (b.height_mm, b.turn_deg) == (0.5, 30.0)


def test_linework_kinds(spark):
    point = lambda x, y: {"x": float(x), "y": float(y)}
    base = {"drawing_id": 1, "block_name": "", "layer": "L", "visible": True, "color": 1, "lineweight": 50}
    square = [point(0, 0), point(10, 0), point(10, 10), point(0, 10)]
    own = [
        {"type": "LINE", "x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 10.0}, {"type": "CIRCLE", "cx": 5.0, "cy": 5.0, "radius": 2.0}, {"type": "ARC", "cx": 5.0, "cy": 5.0, "radius": 2.0, "start_deg": 350.0, "end_deg": 9.0},
        {"type": "ELLIPSE", "cx": 5.0, "cy": 5.0, "major_x": 2.0, "major_y": 0.0, "minor_ratio": 0.5, "start_rad": 0.0, "end_rad": 0.0}, {"type": "SOLID", "corners": square}, {"type": "POINT", "x1": 1.0, "y1": 2.0},
        {"type": "LWPOLYLINE", "closed": True, "vertices": [{**point(0, 0), "bulge": 0.0}, {**point(4, 0), "bulge": 1.0}]}, {"type": "SPLINE", "degree": 1, "control_points": square[:2], "knots": [0.0, 0.0, 1.0, 1.0]},
        {"type": "HATCH", "solid_fill": False, "pattern_scale": 1.0, "paths": [square], "pattern_lines": [{"angle": 0.0, "base_x": 0.0, "base_y": 1.0, "offset_x": 0.0, "offset_y": 4.0, "dashes": []}]},
    ]
    names = [c.split()[0] for c in ("drawing_id block_name entity_seq").split()]
    schema = spark.createDataFrame([], schemas.ENTITIES).schema
    assert names == schema.names[:3]
    entities = spark.createDataFrame([tuple({**base, "entity_seq": i, **e}.get(n) for n in schema.names) for i, e in enumerate(own)], schema)
    tables = {"drawings": spark.createDataFrame([(1, 4)], "drawing_id long, insunits int"), "entities": entities, "layers": spark.createDataFrame([], schemas.LAYERS), "blocks": spark.createDataFrame([], schemas.BLOCKS)}
    plan = spark.createDataFrame([(1, 1, 2.0, 0.0, 10.0, 10.0, 0.0, 0.0)], "drawing_id long, sheet_id int, page_scale double, min_x double, max_y double, margin double, offset_x double, offset_y double")
    got = {}
    for r in export.linework(tables, plan).collect():
        got.setdefault((r.entity_seq, r.kind), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {(0, "line"): 1, (1, "arc"): 1, (2, "arc"): 1, (3, "ellipse"): 1, (4, "solid"): 1, (5, "point"): 1, (6, "line"): 1, (6, "arc"): 1, (7, "spline"): 1, (8, "hatch"): 3}
    line = got[0, "line"][0]
    assert [tuple(p) for p in line.points] == [(10.0, 30.0), (30.0, 10.0)] and (line.r, line.g, line.b, line.width_mm) == (255, 0, 0, 0.5)
    assert len(got[1, "arc"][0].points) == 181 and len(got[2, "arc"][0].points) == 11 and len(got[3, "ellipse"][0].points) == 182
    assert [tuple(p) for p in got[4, "solid"][0].points] == [(10.0, 30.0), (30.0, 30.0), (10.0, 10.0), (30.0, 10.0)] and got[4, "solid"][0].filled
    assert got[8, "hatch"][0].width_mm == 0.05


def _dealt(df):
    """What the rows of a plan's exchanges are dealt by, with joins that only hints make broadcasts."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return re.findall(r"Exchange (?:hash|range)partitioning\(([^\n]*)", df._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_linework_deals_and_stores_no_lines(spark, monkeypatch):
    """Only what stands in blocks meets instances; styles and sheets come to the entities, and only they are stored."""
    names = []
    for module in (export, storage):
        monkeypatch.setattr(module, "stored", lambda df, name, real=storage.stored: names.append((name, df.count())) or real(df, name))
    rows = [(d, "", k, "LINE", "A", True, 256, -2, 0.0, float(k), 9.0, float(k), None, None, None, None, None, None) for d in (1, 2) for k in range(300)]
    rows += [(1, "B", 0, "LINE", "A", True, 1, 50, 0.0, 0.0, 1.0, 0.0, None, None, None, None, None, None), (1, "", 300, "INSERT", "A", True, None, None, None, None, None, None, "B", 5.0, 5.0, 2.0, 2.0, 0.0)]
    own = spark.createDataFrame(rows, "drawing_id long, block_name string, entity_seq long, type string, layer string, visible boolean, color int, lineweight int, x1 double, y1 double, x2 double, y2 double, ref_block string, ins_x double, ins_y double, scale_x double, scale_y double, rot_deg double")
    tables = {"drawings": spark.createDataFrame([(1, 4), (2, 4)], "drawing_id long, insunits int"), "entities": schemas.with_columns_of(own, schemas.ENTITIES), "layers": spark.createDataFrame([(1, 0, "A", 1, 0, 13)], schemas.LAYERS), "blocks": spark.createDataFrame([(1, 0, "B", 0.0, 0.0)], schemas.BLOCKS)}
    plan = spark.createDataFrame([(d, s, 2.0, 0.0, 10.0, 10.0, 0.0, 0.0) for d in (1, 2) for s in (1, 2, 3)], "drawing_id long, sheet_id int, page_scale double, min_x double, max_y double, margin double, offset_x double, offset_y double")
    out = export.linework(tables, plan)
    assert names and all(n <= 2 for _, n in names), names
    dealt = [keys for keys in _dealt(out) if "hatch_id" not in keys and "path_no" not in keys]
    assert dealt and all("block_name" in keys for keys in dealt), dealt
    got = out.collect()
    assert len(got) == 3 * 601 and len({(r.drawing_id, r.sheet_id, r.path, r.entity_seq) for r in got}) == len(got)
    nested = next(r for r in got if r.path)
    assert (nested.path, nested.draw_order, [tuple(p) for p in nested.points], nested.width_mm) == ("/300", [300, 0, 0], [(20.0, 20.0), (24.0, 20.0)], 0.5)
    assert {(r.drawing_id, r.r, r.width_mm) for r in got if not r.path} == {(1, 255, 0.13), (2, 0, 0.25)}


def test_entities_of_drawings_meet_no_instances(spark):
    """What `split_top` parts is what `placed` places, also with a block that is named as drawings are."""
    rng = random.Random(4)
    inserts = spark.createDataFrame([(d, b, k, "INSERT", rng.choice("LM"), True, r, 1.0, float(k), 2.0, 1.0, 30.0) for d in (1, 2) for b, k, r in (("", 0, "A"), ("A", 1, "B"), ("", 2, "B"), ("B", 3, ""))][:7], INSERTS)
    entities = spark.createDataFrame([(d, b, k, rng.choice("LM"), k % 5 > 0) for d in (1, 2, 3) for b in ("", "A", "B") for k in range(6)], "drawing_id long, block_name string, entity_seq long, layer string, visible boolean")
    entities = entities.withColumns({k: F.lit(None).cast("double") for k in ("ref_block", "ins_x", "ins_y", "scale_x", "scale_y", "rot_deg")})
    drawings = spark.createDataFrame([(1,), (2,)], "drawing_id long")
    for names in ("AB", ["A", "B", ""]):
        blocks = spark.createDataFrame([(d, i, n, 0.0, 0.0) for d in (1, 2) for i, n in enumerate(names)], schemas.BLOCKS)
        where = expand.instances(drawings, inserts, blocks)
        columns = ["drawing_id", "block_name", "entity_seq", "path", "draw_order", *expand.IDENTITY]
        own, nested, there = expand.split_top(entities, where, blocks)
        got = own.join(drawings, "drawing_id").select(columns).unionByName(expand.placed(nested, there).select(columns))
        assert sorted(map(str, got.collect())) == sorted(map(str, expand.placed(entities, where).select(columns).collect()))


def test_points_on_sheets(spark):
    """Each row on each of its sheets; nulls stay, and so many points that they are moved in several turns."""
    point = lambda x, y: {"x": x, "y": y}
    rows = [(1, [point(1.0, 2.0), point(None, 3.0), None], [(7, 2.0, 10.0, 20.0), (8, 1.0, 0.0, 0.0)]), (2, None, [(7, 2.0, 10.0, 20.0)]), (3, [], [(9, 1.0, 0.0, 0.0)]), (4, [point(1.0, 1.0)], [])]
    schema = "k long, points array<struct<x: double, y: double>>, sheets array<struct<sheet_id: int, scale: double, x: double, y: double>>"
    got = {(r.k, r.sheet_id): r.points and [tuple(p) for p in r.points] for r in sheets.on_sheets(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 7): [(12.0, 16.0), (None, 14.0), (None, None)], (1, 8): [(1.0, -2.0), (None, -3.0), (None, None)], (2, 7): None, (3, 9): []}
    many = spark.range(3, numPartitions=1).selectExpr("id AS k", "transform(sequence(1, 300000), i -> named_struct('x', double(i + id), 'y', 1d)) AS points", "array(named_struct('sheet_id', 1, 'scale', 1d, 'x', 0d, 'y', 0d), named_struct('sheet_id', 2, 'scale', 2d, 'x', 5d, 'y', 1d)) AS sheets")
    sums = sheets.on_sheets(many).selectExpr("k", "sheet_id", "size(points) AS n", "points[299999].x AS last", "aggregate(points.x, 0d, (a, b) -> a + b) AS total").collect()
    assert sorted(map(tuple, sums)) == [(k, s, 300000, s * (300000.0 + k) + 5 * (s - 1), s * (300000 * 300001 / 2 + 300000 * k) + 5 * (s - 1) * 300000) for k in range(3) for s in (1, 2)]


def test_tiles_deal_no_lines(spark):
    points = "array(named_struct('x', double(id), 'y', 0d), named_struct('x', double(id), 'y', 90d))"
    lines = spark.range(1000).selectExpr("1L AS drawing_id", "1 AS sheet_id", "'line' AS kind", "id % 2 = 0 AS filled", f"{points} AS points")
    plan = spark.createDataFrame([(1, 1, 0.0, 100.0, 50.0, 10, 2)], "drawing_id long, sheet_id int, margin double, print_w double, print_h double, cols int, rows int")
    out = sheets.tile_linework(lines, plan)
    assert _dealt(out) == [] and out.count() == 2000
