"""Table schemas."""

from pyspark.sql import types as T

KEY = "comment_id"
FORUM = "subreddit"
TEXT = "text"

COMMENT_SCHEMA = T.StructType(
    [
        T.StructField("comment_id", T.StringType()),
        T.StructField("post_id", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("upvotes", T.LongType()),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("comment_id", T.StringType()),
        T.StructField("y_true", T.StringType()),
        T.StructField("y_pred", T.StringType()),
        T.StructField("is_correct", T.IntegerType()),
    ]
)
