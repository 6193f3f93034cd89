"""Token counts with a public byte-level BPE; the vocabulary file is named by its path and sent to the executors."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.tokens import encoding

#: Where the rank file lies on the driver unless a path is given.
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_counts(text: Column, path: str | None = None) -> Column:
    """Number of tokens of each text; 0 for null and for texts of white space only."""
    file = path or RANK_FILE
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.sparkContext.addFile(file)
    name = os.path.basename(file)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        return pa.array([len(encode(t)) if t and not t.isspace() else 0 for t in texts.to_pylist()], pa.int32())

    return count(text)
