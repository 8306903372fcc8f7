"""Incremental fingerprints: what is missing or stale, what can be reused, upsert, prune, featurise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.config import DUPLICATE_VIDEOS, DuplicateVideoRules
from frameloom.functions.signature import signature
from frameloom.operators.index import with_ids
from frameloom.schemas import FINGERPRINT_SCHEMA_VERSION
from frameloom.sources.store import current_fingerprints


def _has_hash_and_vector(rules: DuplicateVideoRules) -> Column:
    return F.col("dhash").isNotNull() & F.col("feature_vector").isNotNull()


def _has_frames(rules: DuplicateVideoRules) -> Column:
    return F.coalesce(F.size("frames") >= rules.min_frames, F.lit(False))


# variant -> (asset kind, payload that makes a row complete, payload that makes it reusable)
VARIANTS: dict[str, tuple[str, Callable[[DuplicateVideoRules], Column], Callable[[DuplicateVideoRules], Column]]] = {
    "duplicate": ("photo", _has_hash_and_vector, _has_hash_and_vector),
    "similar": ("photo", _has_hash_and_vector, lambda rules: F.col("feature_vector").isNotNull()),
    "video": ("video", _has_frames, _has_frames),
}


def _signed(index: DataFrame, variant: str) -> DataFrame:
    return index.filter(F.col("kind") == VARIANTS[variant][0]).withColumn("current_signature", signature())


def _fresh() -> Column:
    return (F.col("status") == "ready") & F.col("signature").eqNullSafe(F.col("current_signature"))


def needs_analysis(
    index: DataFrame, stored: DataFrame, variant: str, rules: DuplicateVideoRules = DUPLICATE_VIDEOS
) -> DataFrame:
    """Assets without a ready row of the same signature and full payload.

    Whether the payload is complete is decided before the join, so no vector is shuffled.
    """
    complete = VARIANTS[variant][1](rules)
    kept = current_fingerprints(stored).filter(complete).select("asset_id", "status", "signature")
    usable = F.coalesce(_fresh(), F.lit(False))
    return _signed(index, variant).join(kept, "asset_id", "left").filter(~usable).select(*index.columns)


def cache_hits(
    index: DataFrame, stored: DataFrame, variant: str, rules: DuplicateVideoRules = DUPLICATE_VIDEOS
) -> DataFrame:
    """Stored payloads that are still valid."""
    reusable = VARIANTS[variant][2](rules)
    payload = ["frames"] if variant == "video" else ["dhash", "feature_vector"]
    kept = current_fingerprints(stored).filter(reusable).select("asset_id", "status", "signature", *payload)
    current = _signed(index, variant).select("asset_id", "current_signature")
    return current.join(kept, "asset_id").filter(_fresh()).select("asset_id", *payload)


def fingerprint_states(
    index: DataFrame, stored_photos: DataFrame, stored_videos: DataFrame, rules: DuplicateVideoRules = DUPLICATE_VIDEOS
) -> DataFrame:
    """(variant, asset_id, is_missing, is_hit) for every asset and analysis of its kind, in one pass over index and prints.

    The same as ``needs_analysis`` and ``cache_hits`` of each variant, without payloads.
    """
    parts = []
    for kind, stored in (("photo", stored_photos), ("video", stored_videos)):
        variants = {name: v for name, v in VARIANTS.items() if v[0] == kind}
        # payloads are looked at before the join, so no vector is shuffled
        marks = [x for name, v in variants.items() for x in (v[1](rules).alias(f"full_{name}"), v[2](rules).alias(f"reusable_{name}"))]
        kept = current_fingerprints(stored).select("asset_id", "status", "signature", *marks)
        joined = _signed(index, next(iter(variants))).select("asset_id", "current_signature").join(kept, "asset_id", "left")
        fresh = F.coalesce(_fresh(), F.lit(False))
        states = [
            F.struct(
                F.lit(name).alias("variant"),
                (~(fresh & F.coalesce(f"full_{name}", F.lit(False)))).alias("is_missing"),
                (fresh & F.coalesce(f"reusable_{name}", F.lit(False))).alias("is_hit"),
            )
            for name in variants
        ]
        parts.append(joined.select("asset_id", F.explode(F.array(*states)).alias("s")).select("s.variant", "asset_id", "s.is_missing", "s.is_hit"))
    return parts[0].unionByName(parts[1])


def hits_and_recomputed(hits: DataFrame, recomputed: DataFrame) -> DataFrame:
    return hits.unionByName(recomputed.select(*hits.columns))


def upsert(stored: DataFrame, new: DataFrame, payload: list[str]) -> DataFrame:
    """New rows replace stored ones, signature included. A payload column the new row lacks is kept
    from the stored row while both describe the same state of the asset."""
    old = stored.select("asset_id", F.struct(*[c for c in stored.columns if c != "asset_id"]).alias("o"))
    fresh = new.select("asset_id", F.struct(*[c for c in new.columns if c != "asset_id"]).alias("n"))
    same = F.col("n.signature").eqNullSafe(F.col("o.signature"))

    def merged(name: str) -> Column:
        if name in payload:
            value = F.coalesce(F.col(f"n.{name}"), F.when(same, F.col(f"o.{name}")))
        else:
            value = F.col(f"n.{name}")
        return F.when(F.col("n").isNull(), F.col(f"o.{name}")).otherwise(value).alias(name)

    columns = [c for c in stored.columns if c != "asset_id"]
    return old.join(fresh, "asset_id", "full_outer").select("asset_id", *[merged(c) for c in columns])


def upsert_photos(stored: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(stored, new, ["dhash", "feature_vector"])


def upsert_videos(stored: DataFrame, new: DataFrame, rules: DuplicateVideoRules = DUPLICATE_VIDEOS) -> DataFrame:
    """Rows with too few frames are not stored."""
    return upsert(stored, new.filter(_has_frames(rules)), [])


def prune(stored: DataFrame, index: DataFrame) -> DataFrame:
    """Only fingerprints of assets still in the index."""
    return with_ids(stored, index)


# --- default featurizer ---------------------------------------------------------------------------

GRID_SHAPE = (8, 9)
# Luma weights in the blue, green, red order of the decoded images.
BGR_WEIGHTS = np.array([0.114, 0.587, 0.299])

Featurizer = Callable[[np.ndarray], tuple[int, np.ndarray] | None]


def _area_weights(out: int, size: int) -> np.ndarray:
    """Row i holds the share of every source cell that falls in output cell i."""
    edges = np.arange(out + 1) * (size / out)
    low = np.maximum(edges[:-1, None], np.arange(size)[None, :])
    high = np.minimum(edges[1:, None], np.arange(1, size + 1)[None, :])
    return np.clip(high - low, 0.0, None) / (size / out)


def grid_featurizer(pixels: np.ndarray) -> tuple[int, np.ndarray] | None:
    """(difference hash, unit vector) of the area-averaged grey grid; None for a flat image."""
    grey = pixels[..., 0] if pixels.shape[2] == 1 else pixels[..., :3] @ BGR_WEIGHTS
    grid = _area_weights(GRID_SHAPE[0], grey.shape[0]) @ grey @ _area_weights(GRID_SHAPE[1], grey.shape[1]).T
    levels = np.floor(grid + 0.5)
    bits = (levels[:, :-1] < levels[:, 1:]).ravel()
    value = int(np.packbits(bits).view(">u8")[0].astype(np.int64))
    centred = (grid - grid.mean()).ravel()
    norm = np.linalg.norm(centred)
    # rounding noise of the averaging is no content
    return (value, centred / norm) if norm > 1e-6 else None


def featurize(images: DataFrame, featurizer: Featurizer = grid_featurizer) -> DataFrame:
    """asset_id, dhash, feature_vector of decoded images; images the featurizer cannot use are skipped."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                shape = (row.height, row.width, row.nChannels)
                result = featurizer(np.frombuffer(row.data, np.uint8).reshape(shape).astype(np.float64))
                if result is not None:
                    rows.append((row.asset_id, result[0], result[1]))
            yield pd.DataFrame(rows, columns=["asset_id", "dhash", "feature_vector"])

    decoded = images.select(
        F.regexp_extract("image.origin", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("asset_id"),
        "image.height",
        "image.width",
        "image.nChannels",
        "image.data",
    )
    return decoded.mapInPandas(run, "asset_id string, dhash long, feature_vector array<double>")


def fingerprint_rows(features: DataFrame, index: DataFrame, analyzed_at: Column) -> DataFrame:
    """Store rows for freshly computed photo features."""
    signed = index.select("asset_id", signature().alias("signature"))
    return signed.join(features, "asset_id").select(
        "asset_id",
        "signature",
        F.lit("ready").alias("status"),
        "dhash",
        "feature_vector",
        analyzed_at.alias("analyzed_at"),
        F.lit(FINGERPRINT_SCHEMA_VERSION).alias("schema_version"),
    )
