"""Ten hand-written posts added to the given texts: cases the tables do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LITERAL_POSTS = [
    (-1, "@josé_1 I CAN'T\xa0wait!! http://x.y/é?q great #love  GREAT great, thanks", "src0", "positive"),
    (-2, "never late, lost late shan't won't \x1c", "src1", "negative"),
    (-3, "café ² ٣ naïve_x #tag", "src1", "neutral"),
    (-4, "   ", "src2", "neutral"),
    (-5, "@@a http www.z https", "src2", "negative"),
    (-6, "good bad good bad", "src3", "neutral"),
    (-7, "great flight", "src3", "positive"),
    (-8, None, "src4", None),
    (-9, 'He said "thanks, thank you"\nbest', "src4", "positive"),
    (-10, "NA", "src5", "neutral"),
]
COLUMNS = ("post_id", "text", "brand", "sentiment")


def literal_posts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LITERAL_POSTS, "post_id bigint, text string, brand string, sentiment string")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def literal_values() -> str:
    """The same rows as a SQL ``VALUES`` list."""
    return "VALUES " + ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in LITERAL_POSTS)
