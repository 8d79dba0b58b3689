"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolytics.session import checkpoint_dir

# Fixed value: a word is a run of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing,
    and rows keep the values they were written with. The folder name is new on
    every call; files live as long as the folder ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def raw_bytes(array: pa.Array) -> list:
    """The UTF-8 bytes of a string column (None for null) without decoding."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    return array.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def texts(array: pa.Array) -> list:
    """A string column as Python strings; bytes that are not UTF-8 become U+FFFD."""
    return [None if b is None else b.decode("utf-8", "replace") for b in raw_bytes(array)]


# A-Z become a-z, the other ASCII characters that are no digit or letter become
# spaces, bytes of longer code points stay: words are then what split() gives.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32)
              for b in range(256))


def fold_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.translate(_FOLD).split()


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound once to ``value``, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unsigned_hex(c: Column) -> Column:
    """A 64-bit integer as 16 lowercase hex digits of its two's complement."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def text_sha(text: Column) -> Column:
    """SHA-256 of a text (null as empty) as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def drop_marked(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` (all columns) that ``marks`` does not drop.

    ``marks`` (doc_id, sha, n_rows, stays) has one row per id and text that is
    decided on; all other rows stay. Of ``n_rows`` repeated rows that stay one
    is returned, the first by its JSON if other columns differ.
    """
    # Merged at every size: whether the marks fit a broadcast must not decide the plan.
    both = docs.alias("d").join(marks.alias("m").hint("merge"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("m.doc_id"))
                                & (text_sha(F.col(f"d.`{text_col}`")) == F.col("m.sha")), "left")
    marked = both.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("r"),
                         F.col("m.stays").alias("stays"), F.col("m.n_rows").alias("n_rows"),
                         F.col("m.doc_id").alias("k"), F.col("m.sha").alias("sha"))
    single = marked.where("stays is null or (stays and n_rows = 1)").select("r.*")
    twins = (marked.where("stays and n_rows > 1").groupBy("k", "sha")
             .agg(F.min_by("r", F.to_json("r")).alias("r")).select("r.*"))
    return single.unionByName(twins)
