"""Fingerprints of newly arrived images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frameloom.functions.signature import signature_text
from frameloom.operators import fingerprints as FP
from frameloom.streaming.state import PRINT_EVENTS, NewImage, append_available


def _key() -> Column:
    return F.sha2(signature_text(), 256).alias("signature_key")


def fingerprint_new_images(
    stream: DataFrame,
    index: DataFrame,
    stored: DataFrame,
    path: str,
    checkpoint: str,
    featurizer: FP.Featurizer = FP.grid_featurizer,
) -> StreamingQuery:
    """Featurise only images whose asset is in the index and has no valid fingerprint yet, and append the results to ``path``.

    The state of an asset is its signature and the one it was last printed with. It starts from ``index`` and ``stored``, which are read
    once; after that a micro-batch looks up its own assets only.
    """
    missing = FP.needs_analysis(index, stored, "similar").select("asset_id", F.lit(True).alias("is_missing"))
    known = index.select("asset_id", _key()).join(missing, "asset_id", "left")
    known = known.select("asset_id", "signature_key", F.when(F.col("is_missing").isNull(), F.col("signature_key")).alias("printed_key"))
    name = F.regexp_extract("image.origin", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("asset_id")
    images = stream.select(name, "image.height", "image.width", "image.nChannels", "image.data")
    prints = images.groupBy("asset_id").transformWithState(NewImage(featurizer), PRINT_EVENTS, "Append", "None", known.groupBy("asset_id"))
    return append_available(prints, path, checkpoint)


def read_prints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRINT_EVENTS).parquet(path)


def fingerprints_of(prints: DataFrame, index: DataFrame, analyzed_at: Column) -> DataFrame:
    """Store rows of what the stream printed: each asset's print, if it was made for the signature that the index has now."""
    current = prints.join(index.select("asset_id", _key()), ["asset_id", "signature_key"]).groupBy("asset_id")
    features = current.agg(F.first("dhash").alias("dhash"), F.first("feature_vector").alias("feature_vector"))
    return FP.fingerprint_rows(features, index, analyzed_at)
