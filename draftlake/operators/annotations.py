"""Annotation texts: styled runs, plain text, placement."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.functions.geometry import place
from draftlake.functions.style import palette_colour

#: What is left of a font code that was cut at a 255-byte boundary, at the start of a text (a fixed pattern).
FONT_TAIL = r"^[^;|\\]*\|[bi]\d\|[bi]\d\|c\d+\|p\d+;"
TOKENS = re.compile(
    r"(?P<open>\{)|(?P<close>\})|%%(?P<sign>[cCdDpP%])|(?P<line>\\[PN]|\^J)|\\(?P<code>[fFHWCcSpAQT])(?P<value>[^;]*);?"
    r"|\\(?P<switch>[LlOoKk])|(?P<nothing>\\X)|\\(?P<literal>[~\\{}])|(?P<plain>[^{}%\\^]+|.)",
    re.DOTALL,
)
SIGNS = {"c": "Ø", "d": "°", "p": "±", "%": "%"}
SWITCHES = {"l": "underline", "o": "overstrike", "k": "strikethrough"}
MIN_TEXT_MM, POINTS_PER_MM, LINE_FACTOR = 0.5, 2.83465, 1.4

RUN = T.StructType(
    [
        T.StructField("run_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("new_line", T.BooleanType()),
        T.StructField("font", T.StringType()),
        *[T.StructField(c, T.BooleanType()) for c in ("bold", "italic", "underline", "overstrike", "strikethrough")],
        *[T.StructField(c, T.DoubleType()) for c in ("height", "relative_height", "width_factor")],
        *[T.StructField(c, T.IntegerType()) for c in "rgb"],
    ]
)


@dataclass
class Style:
    font: str = ""
    bold: bool = False
    italic: bool = False
    underline: bool = False
    overstrike: bool = False
    strikethrough: bool = False
    height: float = 0.0  # 0: the default
    relative_height: float = 0.0
    width_factor: float = 1.0
    r: int = 0
    g: int = 0
    b: int = 0

    def set_font(self, spec: str) -> None:
        self.font, *marks = spec.split("|")
        for m in marks:
            if m[:1] in ("b", "i") and len(m) > 1:
                setattr(self, {"b": "bold", "i": "italic"}[m[0]], m[1] == "1")

    def set_height(self, value: str) -> None:
        relative = value.endswith("x")
        size = _positive(value.removesuffix("x"))
        if size:
            self.height, self.relative_height = (0.0, size) if relative else (size, 0.0)

    def set_width(self, value: str) -> None:
        self.width_factor = _positive(value.removesuffix("x")) or self.width_factor

    def set_index(self, value: str) -> None:
        if (index := _whole(value)) is not None:
            self.r, self.g, self.b = palette_colour((index + 0x8000) % 0x10000 - 0x8000)

    def set_rgb(self, value: str) -> None:
        if (c := _whole(value)) is not None:
            self.r, self.g, self.b = c >> 16 & 255, c >> 8 & 255, c & 255


#: Codes that change the style; the text before all but the last of them keeps the old one.
CODES = {"f": Style.set_font, "H": Style.set_height, "C": Style.set_index, "c": Style.set_rgb, "F": lambda s, v: None, "W": Style.set_width}


def _positive(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if value > 0 else None


def _whole(text: str) -> int | None:
    return int(text) if re.fullmatch(r"\s*[+-]?\d+\s*", text) else None


def stacked(value: str) -> str:
    """What a stack shows in one line: a^b as ab, a/b and a#b as a/b."""
    upper, caret, lower = value.partition("^")
    if caret:
        return upper.strip() + lower.strip()
    return value.replace("#", "/", 1) if "/" not in value else value


def mend(text: str) -> str:
    """The text without leftovers of a chunk cut off before it: a font tail, and all through a brace that nothing opened."""
    text = re.sub(FONT_TAIL, "", text)
    depth = 0
    for m in re.finditer(r"\\.|[{}]", text, re.DOTALL):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth < 0:
            return text[m.end() :]
    return text


def parse_runs(text: str) -> list[tuple[str, bool, Style]]:
    """(text, new line, style) of an annotation: a new line is a run of its own, without text."""
    runs: list[tuple[str, bool, Style]] = []
    style, saved, held = Style(), [], []

    def end() -> None:
        if said := "".join(held):
            runs.append((said, False, copy.copy(style)))
        held.clear()

    for m in TOKENS.finditer(mend(text)):
        kind, said = m.lastgroup, m[m.lastgroup]
        if kind == "value":
            code = m["code"]
            if code == "S":
                held.append(stacked(said))
            elif code in CODES:
                if code != "W":
                    end()
                CODES[code](style, said)
        elif kind == "open":
            saved.append(copy.copy(style))
        elif kind == "close":
            end()
            style = saved.pop() if saved else style
        elif kind == "line":
            end()
            runs.append(("", True, copy.copy(style)))
        elif kind == "switch":
            end()
            setattr(style, SWITCHES[said.lower()], said.isupper())
        elif kind == "sign":
            held.append(SIGNS[said.lower()])
        elif kind == "literal":
            held.append(" " if said == "~" else said)
        elif kind == "plain":
            held.append(said)
    end()
    return runs


def full_text(texts: DataFrame) -> DataFrame:
    """texts with `text` continued by the parts in text_ext."""
    return texts.withColumn("text", F.concat("text", F.coalesce(F.array_join("text_ext", ""), F.lit("")))).drop("text_ext")


def text_runs(texts: DataFrame) -> DataFrame:
    """One row for each styled run of each annotation (text); other columns stay. Null texts have no runs."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            owner, columns = [], {f.name: [] for f in RUN}
            for i, text in enumerate(batch.column("text").to_pylist()):
                for n, (said, new_line, style) in enumerate(parse_runs(text) if text is not None else ()):
                    owner.append(i)
                    for name, value in {"run_no": n, "text": said, "new_line": new_line, **vars(style)}.items():
                        columns[name].append(value)
            kept = batch.select(names).take(pa.array(owner, pa.int64()))
            kinds = {T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(columns[f.name], kinds[f.dataType]) for f in RUN]], [*names, *columns])

    return texts.select(*names, "text").mapInArrow(run, T.StructType([*[texts.schema[c] for c in names], *RUN]))


def plain_text(text: str | None) -> str:
    """All runs in order, a new line as one space unless nothing precedes it."""
    said, any_text = [], False
    for part, new_line, _ in parse_runs(text or ""):
        any_text = any_text or not new_line
        if any_text:
            said.append(" " if new_line else part)
    return "".join(said)


def plain_texts(texts: DataFrame) -> DataFrame:
    """texts with their `text` replaced by plain_text. Every row stays: one without runs (null, empty, nothing but codes) has an empty text."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            said = pa.array([plain_text(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, said], [*names, "plain_text"])

    return texts.mapInArrow(run, T.StructType([*[texts.schema[c] for c in names], T.StructField("plain_text", T.StringType())]))


def text_placement(texts: DataFrame, plans: DataFrame) -> DataFrame:
    """Where TEXT and MTEXT entities (x1, y1, text_height, text_rot_deg, a placement) stand on each sheet: x, y, height_mm (half a millimetre at
    least), font_points, line_mm, turn_deg. Turns of MTEXT are in radians in the files."""
    c = F.col
    x, y = place(c("x1"), c("y1"))
    rows = texts.where(c("type").isin("TEXT", "MTEXT")).withColumns({"_x": x, "_y": y})
    p = plans.select("drawing_id", "sheet_id", "page_scale", *[c(k).alias(f"_{k}") for k in ("min_x", "max_y", "margin", "offset_x", "offset_y")])
    rows = rows.join(p, "drawing_id")
    height = F.greatest(F.lit(MIN_TEXT_MM), c("text_height") * F.abs("scale_y") * c("page_scale"))
    own = F.when(c("type") == "MTEXT", F.degrees("text_rot_deg")).otherwise(c("text_rot_deg"))
    rows = rows.withColumns({"x": c("_margin") + c("_offset_x") + (c("_x") - c("_min_x")) * c("page_scale"), "y": c("_margin") + c("_offset_y") + (c("_max_y") - c("_y")) * c("page_scale"), "height_mm": height, "turn_deg": own + c("turn")})
    return rows.select("drawing_id", "sheet_id", "entity_seq", "type", "x", "y", "height_mm", (c("height_mm") * POINTS_PER_MM).alias("font_points"), (c("height_mm") * LINE_FACTOR).alias("line_mm"), "turn_deg")
