"""Tables of drawings derived from order tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region|nation|customer|supplier|part|orders|lineitem|events|documents"
SQL = {
    "segments": """SELECT drawing_id, seg_id, layer, 1e-3*x1 AS x1, 1e-3*y1 AS y1, 1e-3*x2 AS x2, 1e-3*y2 AS y2 FROM (
 SELECT drawing_id, seg_id, layer,
  CASE WHEN o BETWEEN 4 AND 6 THEN y0 ELSE x0 END AS x1, CASE WHEN o BETWEEN 4 AND 6 THEN x0 ELSE y0 END AS y1,
  CASE WHEN o BETWEEN 4 AND 6 THEN y0 WHEN o = 7 THEN x0+len*2 ELSE x0+len END AS x2,
  CASE WHEN o BETWEEN 4 AND 6 THEN x0+len WHEN o = 7 THEN y0+len ELSE y0 END AS y2
 FROM (SELECT l_suppkey AS drawing_id,
   CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,l_linenumber,l_partkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) AS BIGINT) AS seg_id,
   CASE l_returnflag WHEN 'A' THEN 'A-WALL' WHEN 'N' THEN CASE l_linestatus WHEN 'O' THEN 'EXTRA' ELSE 'Teherhordo fal' END ELSE 'A-DOOR' END AS layer,
   CAST((l_partkey % 24) * 1010 AS DOUBLE) AS x0, CAST((CAST(floor(l_orderkey / 8.0) AS BIGINT) % 97) * 170 AS DOUBLE) AS y0,
   CAST(507 + CAST(l_quantity AS BIGINT) * 97 AS DOUBLE) AS len, l_orderkey % 8 AS o
  FROM lineitem) f) g""",
    "drawings": "SELECT s_suppkey AS drawing_id, CAST(s_suppkey % 12 AS INT) AS insunits FROM supplier",
    "layers": """SELECT s_suppkey AS drawing_id, v.layer_seq, v.name, v.color, v.flags, v.lineweight
FROM supplier CROSS JOIN (VALUES (0,'A-WALL',1,0,-3),(1,'A-DOOR',-3,1,25),(2,'EXTRA',7,0,50),(3,'Teherhordo fal',300,0,-1),(4,'UNUSED',251,0,13)) AS v(layer_seq,name,color,flags,lineweight)""",
    # every part is a line of one of its drawing's ten blocks; of five blocks in a row each holds the next
    "block_lines": """SELECT p_partkey % (SELECT count(*) FROM supplier) AS drawing_id, concat('B', CAST(floor(p_partkey / (SELECT count(*) FROM supplier)) AS BIGINT) % 10) AS block_name,
  p_partkey AS entity_seq, CAST(p_size*100 AS DOUBLE) AS x1, CAST((p_partkey % 7)*50 AS DOUBLE) AS y1,
  CAST(p_size*100 + 500 AS DOUBLE) AS x2, CAST((p_partkey % 7)*50 + (p_partkey % 3)*200 AS DOUBLE) AS y2 FROM part""",
    "blocks": """SELECT drawing_id, CAST(k AS INT) AS block_seq, concat('B', k) AS name, CAST(k*10 + drawing_id % 3 AS DOUBLE) AS base_x, CAST(k*5 AS DOUBLE) AS base_y
FROM (SELECT DISTINCT p_partkey % (SELECT count(*) FROM supplier) AS drawing_id, CAST(floor(p_partkey / (SELECT count(*) FROM supplier)) AS BIGINT) % 10 AS k FROM part) numbered""",
    "block_inserts": """SELECT drawing_id, concat('B', k) AS block_name, concat('B', k+1) AS ref_block, 1000e0 AS ins_x, 0e0 AS ins_y,
  CASE WHEN k % 2 = 0 THEN 0.5e0 ELSE 1e0 END AS scale_x, 1e0 AS scale_y, CASE WHEN k % 2 = 0 THEN 90e0 ELSE 0e0 END AS rot_deg
FROM (SELECT DISTINCT p_partkey % (SELECT count(*) FROM supplier) AS drawing_id, CAST(floor(p_partkey / (SELECT count(*) FROM supplier)) AS BIGINT) % 10 AS k FROM part) numbered WHERE k % 5 < 4""",
    "top_inserts": """SELECT CAST(floor(o_orderkey/150) AS BIGINT) AS drawing_id, o_orderkey AS entity_seq, concat('B', o_custkey % 11) AS ref_block,
  CAST((o_orderkey % 150)*2000 AS DOUBLE) AS ins_x, CAST((o_custkey % 100)*1000 AS DOUBLE) AS ins_y,
  CASE o_orderkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN -1e0 ELSE 2e0 END AS scale_x, 1e0 AS scale_y,
  CASE WHEN o_orderkey % 5 = 0 THEN 37e0 ELSE CAST((o_orderkey % 4)*90 AS DOUBLE) END AS rot_deg FROM orders""",
    "hatches": """SELECT c_custkey AS hatch_id, CAST(1000 + (c_custkey % 7)*130 AS DOUBLE) AS a, CAST((c_custkey % 4)*45 AS DOUBLE) AS angle, 37e0 AS offset_x,
  CAST(100 + c_nationkey*3 AS DOUBLE) AS offset_y, CAST(c_custkey % 3 AS INT) AS dash_kind FROM customer""",
    "annotations": """SELECT doc_id AS entity_seq, concat('{', chr(92), 'fArial|b1|i0|c238|p0;', replace(text, chr(10), ' '), '}',
  chr(92), 'P', chr(92), 'H0.5x;%%c', n_chars, ' ', chr(92), 'S1/2;') AS text FROM documents""",
    # every order line as an arc, and as a bulged polyline
    "arcs": """SELECT l_suppkey AS drawing_id, l_orderkey AS entity_seq, l_linenumber AS part_no, CAST((l_partkey % 50)*100 AS DOUBLE) AS cx, CAST((l_partkey % 40)*90 AS DOUBLE) AS cy,
  CAST(100 + CAST(l_quantity AS BIGINT)*7 AS DOUBLE) AS radius, CAST((l_orderkey % 36)*10 + 3 AS DOUBLE) AS start_deg, CAST(((l_orderkey % 36)*10 + 10 + (l_partkey % 12)*5) % 360 AS DOUBLE) AS end_deg
FROM lineitem""",
    "polylines": """SELECT l_suppkey AS drawing_id, l_orderkey AS entity_seq, l_linenumber AS part_no, l_partkey % 2 = 0 AS closed, CAST((l_partkey % 50)*100 AS DOUBLE) AS x0, CAST((l_partkey % 40)*90 AS DOUBLE) AS y0,
  CAST(200 + CAST(l_quantity AS BIGINT)*10 AS DOUBLE) AS size, CASE l_orderkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 0.125e0 ELSE -0.0625e0 END AS bulge
FROM lineitem""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table. Order tables are read where the SQL names them, with only the columns that it uses."""
    return spark.sql(re.sub(rf"\bFROM ({TABLES})\b", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", SQL[name]))


def with_tables(names: list[str], query: str, recursive: bool = False) -> str:
    """A query for DuckDB in which the names stand for derived tables."""
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + f"{',' if query.lstrip().startswith('+') else ''} {query.lstrip().removeprefix('+')}"
