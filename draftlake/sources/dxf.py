"""Reads text DXF files into the tables of a corpus.

A file is a list of pairs of lines, a group code and a value. Code 0 begins a record; records make sections, blocks and
entities.

Files of WHOLE_FILE bytes at most are read whole, some to a task, and parsed in one pass. Larger ones are read in splits, so that one large file is work for many tasks: the lines of a split become pieces, counts by piece say which of their
lines are codes, and what stands before a piece's first record goes to the group of the piece before. So groups hold whole records, and what holds before
them (section, block, polyline, number of records) is carried from group to group in small tables. No row holds a large file, and no
window its lines. `tables` takes files that are rows instead.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlake.operators.running import BLOCK
from draftlake.sources import schemas
from draftlake.storage import stored

#: Python's codec for each $DWGCODEPAGE that is decoded; files of other code pages stay as they are.
CODEPAGES = {f"ANSI_{n}": f"cp{n}" for n in range(1250, 1258)}
#: Bytes of a file that is read whole at most.
WHOLE_FILE = 4 << 20
#: A mark of central European fonts in annotations.
CENTRAL_EUROPE = b"c238"
DECLARED = b"$DWGCODEPAGE"
SPACES = "".join(map(chr, range(33)))
CODE, ZERO = re.compile(r"[\x00-\x20]*[+-]?[0-9]+[\x00-\x20]*"), re.compile(rb"[\x00-\x20]*[+-]?0+[\x00-\x20]*")


def detect_codec(data: bytes) -> str | None:
    """The codec of a file: none for UTF-8 that is not plain ASCII (some writers declare another), else that of the declared code page, else
    Windows-1250 if there are high bytes and fonts with its mark."""
    plain = data.isascii()
    if not plain:
        try:
            data.decode()
            return None
        except UnicodeDecodeError:
            pass
    at = data.find(b"$DWGCODEPAGE")
    if at >= 0:
        lines = data[at : at + 1000].split(b"\n")
        if len(lines) > 2 and (codec := CODEPAGES.get(lines[2].strip().decode("ascii", "replace"))):
            return codec
    return "cp1250" if not plain and CENTRAL_EUROPE in data else None


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][xX][fF]").load(folder).select("path", "content")


def _read_text(spark: SparkSession, folder: str, pattern: str, beyond: int = 0) -> DataFrame:
    """The lines of files of more than `beyond` bytes."""
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder)
    at = F.col("_metadata")
    return text.where(at["file_size"] > beyond).select(at["file_path"].alias("path"), at["file_block_start"].alias("_split"), F.col("value").cast("binary").alias("line"))


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.[dD][xX][fF]") -> DataFrame:
    """(path, line_no, line: its bytes) of the files of a folder, read in splits as large as Spark's settings say."""
    lines = _read_text(spark, folder, pattern).select("path", "_split", F.monotonically_increasing_id().alias("_id"), "line")
    lines = stored(lines, "lines")  # a split's ids are one range, in its order; stored, they stay
    splits = lines.groupBy("path", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(splits.drop("_n"), ["path", "_split"]).select("path", (F.col("_base") + F.col("_id") - F.col("_first")).alias("line_no"), "line")


def codecs(lines: DataFrame) -> DataFrame:
    """(path, codec) of files as lines: what `detect_codec` finds in a whole file."""
    text = F.col("line").cast("string")
    valid = F.is_valid_utf8(text)
    seen = lines.groupBy("path").agg(
        F.bool_and(valid).alias("_valid"), F.bool_and(valid & (F.char_length(text) == F.octet_length("line"))).alias("_plain"), F.bool_or(F.contains(text, F.lit(CENTRAL_EUROPE.decode()))).alias("_mark"),
        F.min(F.when(F.contains(text, F.lit(DECLARED.decode())), F.col("line_no"))).alias("_at"),
    )
    return _codecs(seen, lines)


def _codecs(seen: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, codec) of files by what was seen in them (_valid, _plain, _mark, _at) and the lines that may name a code page."""
    named = lines.select("path", F.col("line_no").alias("_named_at"), F.trim(F.btrim(F.col("line").cast("string"), F.lit(" \t\r"))).alias("_name"))
    rows = seen.withColumn("_named_at", F.col("_at") + 2).join(named, ["path", "_named_at"], "left")
    declared = F.lit(None).cast("string")
    for name, codec in CODEPAGES.items():
        declared = F.when(F.col("_name") == name, codec).otherwise(declared)
    mark = F.when(~F.col("_plain") & F.col("_mark"), "cp1250")
    return rows.select("path", F.when(F.col("_plain") | ~F.col("_valid"), F.coalesce(declared, mark)).alias("codec"))


def _pieces(text: DataFrame) -> DataFrame:
    """Lines (path, split, line) in their order as pieces of one split each: n lines, their content, where in it the first record begins if its first
    line is a code (start_0) or a value (start_1), and what says how the file is encoded: clues are lines by number in the piece."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        piece = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            path, split, lines = batch.column("path"), batch.column("split"), batch.column("line").to_pylist()
            cut = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(split[1:], split[:-1])).to_numpy(zero_copy_only=False)
            cuts, rows = [0, *(np.flatnonzero(cut) + 1).tolist(), len(lines)], []
            for first, end in zip(cuts, cuts[1:]):  # noqa: B905
                mine, starts, piece = lines[first:end], [None, None], piece + 1
                for i, x in enumerate(mine):
                    if starts[i % 2] is None and b"0" in x and ZERO.fullmatch(x):
                        starts[i % 2] = sum(map(len, mine[:i])) + i
                        if None not in starts:
                            break
                content = b"\n".join(mine)
                plain = content.isascii()
                try:
                    valid = plain or bool(content.decode())
                except UnicodeDecodeError:
                    valid = False
                at = next((i for i, x in enumerate(mine) if DECLARED in x), None) if DECLARED in content else None
                clues = {i: mine[i][:100] for i in (0, 1, *([] if at is None else [at + 2])) if i < len(mine)}
                rows.append((path[first].as_py(), split[first].as_py(), piece, len(mine), content, *starts, plain, valid, CENTRAL_EUROPE in content, at, list(clues.items())))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

    import pyarrow as pa

    clue = pa.map_(pa.int32(), pa.binary())
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), clue]
    schema = "path string, split long, piece long, n long, content binary, start_0 int, start_1 int, plain boolean, valid boolean, mark boolean, at int, clues map<int, binary>"
    names = ["path", "split", "piece", "n", "content", "start_0", "start_1", "plain", "valid", "mark", "at", "clues"]
    return text.select("path", "split", "line").mapInArrow(run, schema)


def read_groups(spark: SparkSession, folder: str, pattern: str, beyond: int = 0) -> tuple[DataFrame, DataFrame]:
    """(path of files of more than `beyond` bytes, their content as groups of whole records: drawing_id, at, pieces, codec). A piece's lines before its first record go to the group before."""
    text = _read_text(spark, folder, pattern, beyond).select("path", F.col("_split").alias("split"), "line")
    pieces = stored(_pieces(text).withColumn("drawing_id", F.xxhash64("path")), "pieces")
    c = F.col
    before = Window.partitionBy("drawing_id").orderBy("split", "piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.drop("content").withColumn("at_line", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.withColumn("start", F.when(c("at_line") % 2 == 0, c("start_0")).otherwise(c("start_1")))
    rows = rows.withColumn("owner", F.coalesce(F.last(F.when(c("start").isNotNull(), c("at_line")), ignorenulls=True).over(before), F.lit(-1)))
    rows = stored(rows, "places")
    seen = rows.groupBy("path").agg(F.bool_and("valid").alias("_valid"), F.bool_and("plain").alias("_plain"), F.bool_or("mark").alias("_mark"), F.min(c("at_line") + c("at")).alias("_at"))
    clues = rows.select("path", "at_line", F.explode("clues").alias("_i", "line")).select("path", (c("at_line") + c("_i")).alias("line_no"), "line")
    kinds = stored(_codecs(seen, clues), "codecs")
    places = stored(rows.join(kinds, "path").select("drawing_id", "split", "piece", "at_line", "start", "owner", "codec"), "places")
    lead = F.when(c("start").isNull(), c("content")).when(c("start") > 0, F.substring("content", F.lit(1), c("start") - 1))
    body = F.when(c("start").isNotNull(), F.substring("content", c("start") + 1, F.octet_length("content")))
    part = lambda owner, content: F.struct(owner.alias("at"), c("at_line"), content.alias("content"))
    parts = pieces.select("drawing_id", "split", "piece", "content").join(places, ["drawing_id", "split", "piece"])
    parts = parts.select("drawing_id", "codec", F.inline(F.array(part(c("owner"), lead), part(c("at_line"), body)))).where("content IS NOT NULL")
    groups = parts.groupBy("drawing_id", "at").agg(F.first("codec").alias("codec"), F.array_sort(F.collect_list(F.struct("at_line", "content"))).alias("pieces"))
    return kinds.select("path"), stored(groups.select("drawing_id", "at", "codec", F.col("pieces.content").alias("pieces")), "groups")


def _split_records(pieces: list[bytes], codec: str | None, known: dict[str, int | None]):
    """The records of content that begins at one: (codes, values, where each record begins in them; tags before the first record are a record 0)."""
    text = b"\n".join(pieces).decode(codec or "utf-8", "replace")
    lines = text.split("\n")
    values = lines[1::2]
    if "\r" in text:
        lines, values = [x.rstrip("\r") for x in lines], [x.rstrip("\r") for x in values]
    codes = []
    for x in lines[: 2 * len(values) : 2]:
        if x not in known:
            if len(known) > 10_000:
                known.clear()
            known[x] = int(x.strip(SPACES)) if CODE.fullmatch(x) and abs(int(x.strip(SPACES))) < 1 << 31 else None
        codes.append(known[x])
    if None in codes:
        codes, values = [[y for y, k in zip(of, codes, strict=True) if k is not None] for of in (codes, values)]
    return codes, values, [i for i, k in enumerate(codes) if k == 0]


def _walk(codes, values, starts, section, block, owner, base):
    """(section, block_name, owner) of each record, from what holds before the first one on."""
    out = []
    for k, (i, end) in enumerate(zip(starts, [*starts, len(codes)][1:], strict=True)):
        kind = values[i].strip(" ")
        if kind in ("SECTION", "BLOCK"):
            name = next((values[j] for j in range(i, end) if codes[j] == 2), None)
            if kind == "SECTION":
                section, block = section if name is None else name.strip(" "), ""
            elif section == "BLOCKS" and name is not None:
                block = name
        elif kind == "ENDSEC":
            section = ""
        elif kind == "ENDBLK":
            block = ""
        owner = base + k + 1 if kind == "POLYLINE" else owner if kind == "VERTEX" else -1
        out.append((section, block, owner))
    return out


STATE = "base long, section string, block_name string, owner long"


def _states(groups: DataFrame) -> DataFrame:
    """What holds before each group (drawing_id, at): records so far, section, block and the polyline that vertices belong to."""
    schema = "drawing_id long, at long, n long, section string, in_blocks string, elsewhere string, owner long"

    def run(batches):
        import pyarrow as pa

        known: dict[str, int | None] = {}
        for batch in batches:
            rows = []
            for drawing, at, pieces, codec in zip(*[batch.column(k).to_pylist() for k in ("drawing_id", "at", "pieces", "codec")], strict=True):
                codes, values, starts = _split_records(pieces, codec, known)
                # a block's name counts in the section of blocks only: both ways, as the section may be one that began earlier
                ways = [(_walk(codes, values, starts, s, None, None, 0) or [(s, None, None)])[-1] for s in ("BLOCKS", None)]
                rows.append((drawing, at, len(starts), ways[1][0], ways[0][1], ways[1][1], ways[1][2]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]
    c = F.col
    before = Window.partitionBy("drawing_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda v: F.last(v, ignorenulls=True).over(before)
    rows = groups.select("drawing_id", "at", "pieces", "codec").mapInArrow(run, schema)
    rows = rows.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "before": last(c("section"))})
    rows = rows.withColumns({"_block": F.when(c("before") == "BLOCKS", c("in_blocks")).otherwise(c("elsewhere")), "_owner": F.when(c("owner") > 0, c("base") + c("owner")).otherwise(c("owner"))})
    return rows.select("drawing_id", "at", "base", c("before").alias("section"), last(c("_block")).alias("block_name"), last(c("_owner")).alias("owner"))


def _as_lines(content: bytes) -> bytes:
    """A whole file as what a reader of lines makes of it."""
    return content.removeprefix(b"\xef\xbb\xbf").removesuffix(b"\n")


def _records(groups: DataFrame, whole: bool = False) -> DataFrame:
    """One row for each record of groups (drawing_id, pieces, codec, and what holds before them): its type, tags in order, the section and block that it is in.
    whole: groups are whole files, and their codec is what they say.

    Python on purpose: a task cuts the text of its groups into pairs of lines, and nothing but whole records leaves it.
    """
    schema = "drawing_id long, record_no long, type string, name string, tags array<struct<tag_no: int, code: int, value: string>>, section string, block_name string, owner long"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known: dict[str, int | None] = {}
        for batch in batches:
            for drawing, pieces, codec, base, *state in zip(*[batch.column(k).to_pylist() for k in ("drawing_id", "pieces", "codec", "base", "section", "block_name", "owner")], strict=True):
                if whole:
                    pieces = [_as_lines(x) for x in pieces]
                    codec = detect_codec(pieces[0])
                codes, values, starts = _split_records(pieces, codec, known)
                states = _walk(codes, values, starts, *state, base)
                numbers = list(range(base + 1, base + 1 + len(starts)))
                types = [values[i].strip(" ") for i in starts]
                if codes and (not starts or starts[0]):
                    starts, states, numbers, types = [0, *starts], [tuple(state), *states], [base, *numbers], [None, *types]
                bounds = np.array([*starts, len(codes)], np.int32)
                for a in range(0, len(starts), 10_000):
                    b = min(a + 10_000, len(starts))
                    i, j = int(bounds[a]), int(bounds[b])
                    tags = pa.StructArray.from_arrays([pa.array(np.arange(i, j, dtype=np.int32)), pa.array(codes[i:j], pa.int32()), pa.array(values[i:j], pa.string())], ["tag_no", "code", "value"])
                    names = [next((values[k] for k in range(s, e) if codes[k] == 2), None) for s, e in zip(bounds[a:b].tolist(), bounds[a + 1 : b + 1].tolist(), strict=True)]
                    columns = [pa.array([drawing] * (b - a), pa.int64()), pa.array(numbers[a:b], pa.int64()), pa.array(types[a:b], pa.string()), pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(bounds[a : b + 1] - i), tags)]
                    section, block, owner = zip(*states[a:b], strict=True)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(section, pa.string()), pa.array(block, pa.string()), pa.array(owner, pa.int64())], ["drawing_id", "record_no", "type", "name", "tags", "section", "block_name", "owner"])

    return groups.select("drawing_id", "pieces", "codec", "base", "section", "block_name", "owner").mapInArrow(run, schema)


def _text(code: int) -> Column:
    """The first value of a code in a record."""
    return F.get(F.filter("tags", lambda t: t["code"] == code), F.lit(0))["value"]


def _number(code: int, default: float | None = None) -> Column:
    return F.coalesce(_text(code).try_cast("double"), F.lit(default).cast("double"))


def _whole(code: int, default: int | None = None) -> Column:
    return F.coalesce(F.trim(_text(code)).try_cast("int"), F.lit(default).cast("int"))


def _all(code: int, source: Column | str = "tags") -> Column:
    return F.transform(F.filter(source, lambda t: t["code"] == code), lambda t: F.trim(t["value"]).try_cast("double"))


def _starting(code: int, source: Column | str = "tags") -> Column:
    """The tags cut before each tag of a code: an array of arrays, without what comes before the first."""
    tags_ = F.col(source) if isinstance(source, str) else source
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tags_), F.lit(1))), lambda i: F.get(tags_, i - 1)["code"] == code)
    return F.transform(starts, lambda s, k: F.slice(tags_, s, F.coalesce(F.get(starts, k + 1), F.size(tags_) + 1) - s))


def _in(part: Column, code: int, default: float = 0.0) -> Column:
    return F.coalesce(F.get(_all(code, part), F.lit(0)), F.lit(default))


def _points(source: Column | str = "tags", bulge: bool = False) -> Column:
    def point(part):
        xy = [_in(part, 10).alias("x"), _in(part, 20).alias("y")]
        return F.struct(*xy, _in(part, 42).alias("bulge")) if bulge else F.struct(*xy)

    return F.transform(_starting(10, source), point)


def _between(first: int, until: list[int]) -> Column:
    """The tags from the first of a code on, up to one of those that end the part."""
    n = F.size("tags")
    at = F.coalesce(F.array_min(F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: F.get(F.col("tags"), i - 1)["code"] == first), lambda i: i)), n + 1)
    end = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), n), lambda i: (i > at) & F.get(F.col("tags"), i - 1)["code"].isin(until))), n + 1)
    return F.slice("tags", at, F.greatest(end - at, F.lit(0)))


def _entities(records: DataFrame) -> DataFrame:
    kind, c = F.col("type"), F.col
    here = records.where(c("section").isin("ENTITIES", "BLOCKS") & ~kind.isin("SECTION", "ENDSEC", "BLOCK", "ENDBLK", "VERTEX", "SEQEND", "EOF"))
    vertices = records.where((kind == "VERTEX") & (c("owner") >= 0)).groupBy("drawing_id", c("owner").alias("record_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(c("record_no").alias("n"), _number(10, 0).alias("x"), _number(20, 0).alias("y"), _number(42, 0).alias("bulge")))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["bulge"].alias("bulge"))).alias("_vertices")
    )
    # records that have no vertices of their own stay where they are
    own = here.where(kind == "POLYLINE").join(vertices, ["drawing_id", "record_no"], "left")
    rows = here.where(kind != "POLYLINE").withColumn("_vertices", F.lit(None).cast(f"array<{schemas.VERTEX}>")).unionByName(own)
    on = lambda types, value: F.when(kind.isin(*types), value)
    round_ = ("CIRCLE", "ARC", "ELLIPSE")
    placed = ("LINE", "TEXT", "MTEXT", "POINT")
    paths = F.filter(F.transform(_starting(92, _between(91, [75, 76])), lambda p: _points(p)), lambda p: F.size(p) > 0)
    patterns = F.transform(_starting(53), lambda p: F.struct(_in(p, 53).alias("angle"), _in(p, 43).alias("base_x"), _in(p, 44).alias("base_y"), _in(p, 45).alias("offset_x"), _in(p, 46).alias("offset_y"), _all(49, p).alias("dashes")))
    corners = F.array(*[F.struct(_number(10 + i, 0).alias("x"), _number(20 + i, 0).alias("y")) for i in range(4)])
    out = rows.select(
        "drawing_id", F.coalesce("block_name", F.lit("")).alias("block_name"), c("record_no").alias("entity_seq"), kind.alias("type"), F.coalesce(_text(8), F.lit("0")).alias("layer"),
        (_whole(60, 0) == 0).alias("visible"), _whole(62, 256).alias("color"), _whole(370, -2).alias("lineweight"),
        on(placed, _number(10, 0)).alias("x1"), on(placed, _number(20, 0)).alias("y1"), on(("LINE",), _number(11, 0)).alias("x2"), on(("LINE",), _number(21, 0)).alias("y2"),
        on(round_, _number(10, 0)).alias("cx"), on(round_, _number(20, 0)).alias("cy"), on(("CIRCLE", "ARC"), _number(40, 0)).alias("radius"),
        on(("ARC",), _number(50, 0)).alias("start_deg"), on(("ARC",), _number(51, 360)).alias("end_deg"),
        on(("ELLIPSE",), _number(11, 1)).alias("major_x"), on(("ELLIPSE",), _number(21, 0)).alias("major_y"), on(("ELLIPSE",), _number(40, 1)).alias("minor_ratio"), on(("ELLIPSE",), _number(41, 0)).alias("start_rad"), on(("ELLIPSE",), _number(42, 6.283185307179586)).alias("end_rad"),
        on(("LWPOLYLINE", "POLYLINE"), _whole(70, 0).bitwiseAND(1) == 1).alias("closed"),
        F.when(kind == "LWPOLYLINE", _points(bulge=True)).when(kind == "POLYLINE", F.coalesce("_vertices", F.array().cast(f"array<{schemas.VERTEX}>"))).alias("vertices"),
        on(("SPLINE",), _whole(71, 3)).alias("degree"), on(("SPLINE",), _points()).alias("control_points"), on(("SPLINE",), _all(40)).alias("knots"), on(("SOLID",), corners).alias("corners"),
        on(("INSERT", "DIMENSION"), _text(2)).alias("ref_block"), on(("INSERT",), _number(10, 0)).alias("ins_x"), on(("INSERT",), _number(20, 0)).alias("ins_y"), on(("INSERT",), _number(41, 1)).alias("scale_x"), on(("INSERT",), _number(42, 1)).alias("scale_y"), on(("INSERT",), _number(50, 0)).alias("rot_deg"),
        on(("TEXT", "MTEXT"), F.coalesce(_text(1), F.lit(""))).alias("text"), on(("MTEXT",), F.transform(F.filter("tags", lambda t: t["code"] == 3), lambda t: t["value"])).alias("text_ext"),
        on(("TEXT", "MTEXT"), _number(40, 1)).alias("text_height"), on(("TEXT", "MTEXT"), _number(50, 0)).alias("text_rot_deg"),
        on(("HATCH",), _whole(70, 0) == 1).alias("solid_fill"), on(("HATCH",), _number(41, 1)).alias("pattern_scale"), on(("HATCH",), paths).alias("paths"), on(("HATCH",), patterns).alias("pattern_lines"),
    )
    return schemas.with_columns_of(out, schemas.ENTITIES)


def _tables(files: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """The tables of files (path) and their records."""
    records = stored(records, "records")
    following = lambda names, codes: F.get(F.filter(F.transform("tags", lambda t, i: F.when((t["code"] == 9) & (F.trim(t["value"]) == names), F.get("tags", i + 1))), lambda t: t["code"].isin(codes)), F.lit(0))["value"]
    headers = records.where(F.exists("tags", lambda t: t["code"] == 9))
    heads = headers.groupBy("drawing_id").agg(F.min(F.trim(following("$INSUNITS", [70]))).try_cast("int").alias("insunits"), F.min(F.trim(following("$DWGCODEPAGE", [3]))).alias("codepage"))
    drawings = files.select(F.xxhash64("path").alias("drawing_id"), "path").join(heads, "drawing_id", "left").withColumn("insunits", F.coalesce("insunits", F.lit(0)))
    seq = F.row_number().over(Window.partitionBy("drawing_id").orderBy("record_no")) - 1
    layers = records.where("type = 'LAYER' AND section = 'TABLES'").select("drawing_id", seq.alias("layer_seq"), "name", _whole(62, 7).alias("color"), _whole(70, 0).alias("flags"), _whole(370, -3).alias("lineweight"))
    blocks = records.where("type = 'BLOCK' AND section = 'BLOCKS'").select("drawing_id", seq.alias("block_seq"), "name", _number(10, 0).alias("base_x"), _number(20, 0).alias("base_y"))
    return {"drawings": schemas.with_columns_of(drawings, schemas.DRAWINGS), "layers": schemas.with_columns_of(layers, schemas.LAYERS), "blocks": schemas.with_columns_of(blocks, schemas.BLOCKS), "entities": _entities(records)}


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """drawings, layers, blocks and entities of files that are rows (path, content)."""
    codec = F.udf(lambda data: detect_codec(data or b""), "string", useArrow=True)
    return _tables(files.select("path"), _records(_as_groups(files, codec("content"))))


def _as_groups(files: DataFrame, codec: Column) -> DataFrame:
    """Files (path, content) as one group each."""
    nothing = [F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in STATE.split(", ")[1:]]
    return files.select(F.xxhash64("path").alias("drawing_id"), F.array(F.coalesce("content", F.lit(b""))).alias("pieces"), codec.alias("codec"), F.lit(0).cast("long").alias("base"), *nothing)


def read_tables(spark: SparkSession, folder: str, pattern: str = "*.[dD][xX][fF]", block: int = BLOCK) -> dict[str, DataFrame]:
    """drawings, layers, blocks and entities of the files of a folder, whatever their size: see the module. Empty files have no drawing. `block` is not used any more."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    found = found.select(F.col("_metadata")["file_path"].alias("path"), "length", "content")
    small = found.where(F.col("length").between(1, WHOLE_FILE))
    records = _records(_as_groups(small, F.lit(None).cast("string")), whole=True)
    if found.where(F.col("length") > WHOLE_FILE).isEmpty():
        return _tables(small.select("path"), records)
    files, groups = read_groups(spark, folder, pattern, WHOLE_FILE)
    of_large = _records(groups.join(stored(_states(groups), "states"), ["drawing_id", "at"]))
    return _tables(small.select("path").union(files), records.union(of_large))
