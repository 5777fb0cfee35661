"""Detection, track and attribute views over the star-schema tables.

One SQL text serves Spark and DuckDB.  An image is an order, so images stay small and their number
grows with the data.  All numbers are integers, so that both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from objectlens.session import table

_BOX = "l_partkey % 50 + {dx} AS x1, (l_suppkey % 10) * 5 AS y1, 10 + CAST(floor(l_quantity) AS BIGINT) % 20 AS w, 10 + l_linenumber * 3 AS h"
_KEY = "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))"

VIEWS = {
    "det": f"SELECT l_orderkey AS image_id, {_KEY} AS det_id, {_BOX.format(dx=0)}, CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS score, l_linenumber AS category_id FROM lineitem",
    "gt": f"SELECT l_orderkey AS image_id, {_KEY} AS gt_id, {_BOX.format(dx=1)}, l_linenumber AS category_id, l_linestatus AS status FROM lineitem WHERE l_returnflag = 'N'",
    "img": "SELECT o_orderkey AS image_id, o_orderkey % 5 <> 0 AS exhaustive, o_orderstatus AS phrase, 100 + o_custkey % 50 AS width, 90 + o_custkey % 40 AS height FROM orders",
    "trk": "SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type AS track, event_id, CAST(floor(value * 100) AS BIGINT) AS score FROM events",
    "attr": "SELECT p_partkey AS seq, p_type AS category, p_brand AS color, concat('m', CAST(p_size % 7 AS STRING)) AS material, p_name AS crop_path, p_partkey % 40 AS label FROM part",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
    "media": "SELECT page_id, url FROM pages",
}
_TABLE = {"det": "lineitem", "gt": "lineitem", "img": "orders", "trk": "events", "attr": "part", "turns": "conversations", "media": "pages"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = _TABLE[name]
    return spark.sql(VIEWS[name].replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))


def with_views(body: str, *names: str) -> str:
    """A query over some views as one SQL text for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + body
