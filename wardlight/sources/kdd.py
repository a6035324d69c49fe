"""NSL-KDD connection records: 41 features, label, difficulty, no header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: column names of the public data set, in file order
FEATURES = (
    "duration protocol_type service flag src_bytes dst_bytes land wrong_fragment urgent hot "
    "num_failed_logins logged_in num_compromised root_shell su_attempted num_root "
    "num_file_creations num_shells num_access_files num_outbound_cmds is_host_login "
    "is_guest_login count srv_count serror_rate srv_serror_rate rerror_rate srv_rerror_rate "
    "same_srv_rate diff_srv_rate srv_diff_host_rate dst_host_count dst_host_srv_count "
    "dst_host_same_srv_rate dst_host_diff_srv_rate dst_host_same_src_port_rate "
    "dst_host_srv_diff_host_rate dst_host_serror_rate dst_host_srv_serror_rate "
    "dst_host_rerror_rate dst_host_srv_rerror_rate"
).split()
CATEGORIES = ["protocol_type", "service", "flag"]
NUMBERS = [f for f in FEATURES if f not in CATEGORIES]
SCHEMA = ", ".join(
    [f"`{f}` {'string' if f in CATEGORIES else 'double'}" for f in FEATURES]
    + ["label string", "difficulty int"]
)
NORMAL = "normal"


def read_kdd(spark: SparkSession, path: str) -> DataFrame:
    """Records with the binary target ``attack``."""
    return spark.read.schema(SCHEMA).csv(path, header=False).withColumn(
        "attack", (F.col("label") != NORMAL).cast("int")
    )
