"""Named queries: each takes (spark, folder of the benchmark tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import enums, media
from frameloom.functions import vectors as V
from frameloom.functions.signature import signature_text
from frameloom.operators import bin as B
from frameloom.operators import blocking, keyframes, ranges, ranking, report, sizes
from frameloom.operators import fingerprints as FP
from frameloom.operators import groups as G
from frameloom.operators import index as I
from frameloom.operators.components import connected_components
from frameloom.plans import photos as P
from frameloom.plans import videos as VD
from frameloom.schemas import PHOTO_FINGERPRINTS
from frameloom.session import cut_lineage, scratch_path
from frameloom.sources.derived import INDEXED_AT, NOW, DerivedLibrary, timestamp
from frameloom.sources.scan import scan_folder
from frameloom.sources.store import load_index, read_index, write_bucketed, write_index
from frameloom.streaming import changes as stream_changes
from frameloom.streaming import deletions as stream_deletions
from frameloom.streaming import fingerprints as stream_prints

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Micro-batches that the events come in.
STREAM_TURNS = 4


def _query(build: Callable[[DerivedLibrary], DataFrame]) -> Callable[[DerivedLibrary], DataFrame]:
    """Register under the function's name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(DerivedLibrary(spark, sf_dir))
    return build


def _now() -> Column:
    return timestamp(NOW)


def _plain_time(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


def _round(name: str) -> Column:
    return F.round(name, 6).alias(name)


def _scratch(lib: DerivedLibrary, name: str) -> str:
    return scratch_path(lib.spark, name)


# --- analyses shared by several queries -------------------------------------------------------------


def _frames(lib: DerivedLibrary) -> DataFrame:
    return keyframes.collect_frames(lib.frame_rows)


def _duplicate_photos(lib: DerivedLibrary) -> DataFrame:
    return P.duplicate_photo_groups(lib.assets, lib.photo_features, lib.resources)


def _similar_photos(lib: DerivedLibrary, excluded: DataFrame | None = None) -> DataFrame:
    if excluded is None:
        excluded = P.duplicate_photo_members(lib.assets, lib.photo_features)
    return P.similar_photo_groups(lib.assets, lib.photo_features, excluded, lib.resources)


def _duplicate_videos(lib: DerivedLibrary) -> DataFrame:
    return VD.duplicate_video_groups(lib.assets, _frames(lib), lib.resources)


def _large_videos(lib: DerivedLibrary) -> DataFrame:
    return VD.large_videos(lib.assets, lib.resources)


def _analyses(lib: DerivedLibrary) -> dict[str, DataFrame | None]:
    duplicates = cut_lineage(_duplicate_photos(lib))  # reported on and excluded from the similar photos
    return {
        "duplicatePhotos": duplicates,
        "duplicateVideos": _duplicate_videos(lib),
        "similarPhotos": _similar_photos(lib, G.member_ids(duplicates)),
    }


def _bin(lib: DerivedLibrary) -> DataFrame:
    return B.first_per_asset(lib.deletions, ["deleted_at", "sequence"]).drop("sequence")


# --- sources and sinks ------------------------------------------------------------------------------


@_query
def scan_assets_query(lib):
    """Picture files written from the tables, listed and opened as far as their headers, newest first."""
    folder = _scratch(lib, "files")
    lib.write_image_files(folder)
    return scan_folder(lib.spark, folder).select("asset_id", "path", "kind", "pixel_width", "pixel_height", "source")


QUERIES["scan_assets"] = QUERIES.pop("scan_assets_query")


@_query
def explode_resources(lib):
    return I.explode_resources(lib.library)


@_query
def index_records(lib):
    rows = I.index_records(lib.library, timestamp(INDEXED_AT))
    return rows.select(
        "asset_id",
        F.array_join("resource_types", ",").alias("resource_types"),
        F.array_join("uniform_type_identifiers", ",").alias("uniform_type_identifiers"),
        F.array_join("original_filenames", ",").alias("original_filenames"),
        "file_size",
        "processing_state",
        _plain_time("indexed_at"),
    )


@_query
def build_index(lib):
    """Scan, project, write the index, read it back."""
    folded = I.index_records(lib.library, timestamp(INDEXED_AT))
    drop = [c for c in folded.columns if c not in ("asset_id",)]
    path = _scratch(lib, "index")
    write_index(lib.assets.drop(*drop).join(folded, "asset_id"), path)
    return read_index(lib.spark, path).select(
        "asset_id",
        "kind",
        "pixel_width",
        "pixel_height",
        "duration",
        "is_screenshot",
        F.array_join("resource_types", ",").alias("resource_types"),
        "file_size",
        _plain_time("creation_date"),
        _plain_time("indexed_at"),
    )


@_query
def load_index_query(lib):
    """The stored table, written and read back."""
    path = _scratch(lib, "index")
    write_index(lib.assets, path)
    rows = load_index(read_index(lib.spark, path))
    return rows.select(
        "asset_id",
        "kind",
        F.col("location").isNull().alias("no_location"),
        F.round("location.latitude", 6).alias("latitude"),
        F.round("location.longitude", 6).alias("longitude"),
        "file_size",
        _plain_time("indexed_at"),
    )


QUERIES["load_index"] = QUERIES.pop("load_index_query")


@_query
def fingerprint_upsert(lib):
    """Recomputed fingerprints of everything not reusable, merged into the stored ones."""
    missing = FP.needs_analysis(lib.assets, lib.photo_fingerprints, "similar")
    features = lib.photo_features.withColumnRenamed("vec", "feature_vector")
    new = FP.fingerprint_rows(features, missing, _now())
    merged = FP.upsert_photos(lib.photo_fingerprints, new)
    return merged.select(
        "asset_id",
        "status",
        "dhash",
        F.size("feature_vector").alias("dims"),
        "schema_version",
        F.col("signature.modification_date").cast("timestamp_ntz").alias("modification_date"),
    )


@_query
def fingerprint_prune(lib):
    live = I.without_ids(lib.assets, lib.deleted_ids)
    return FP.prune(lib.photo_fingerprints, live).select("asset_id", "status", "schema_version")


@_query
def bin_add(lib):
    """Insert the assets of the deletion set and the deletion events into the bin, first entry wins."""
    existing = B.entries_from_assets(I.with_ids(lib.assets, lib.deleted_ids), _now())
    events = lib.deletions
    merged = B.add(existing, events, ["deleted_at", "sequence"])
    return merged.select("asset_id", "kind", "file_size", _plain_time("deleted_at"))


@_query
def bin_remove(lib):
    restored = _bin(lib).filter("file_size < 100000000").select("asset_id")
    return B.remove(_bin(lib), restored).select("asset_id", "kind", "file_size", _plain_time("deleted_at"))


@_query
def bin_purge(lib):
    return B.purge(_bin(lib), _now()).select("asset_id", "kind", "file_size", _plain_time("deleted_at"))


@_query
def delete_assets(lib):
    return I.without_ids(lib.assets, lib.deleted_ids).select("asset_id", "kind", "file_size")


@_query
def assets_exist(lib):
    asked = lib.deleted_ids.unionByName(lib.deletions.select("asset_id"))
    return I.existing_ids(asked, lib.assets)


# --- projections and scalar functions ---------------------------------------------------------------


@_query
def aspect_ratio(lib):
    width, height = F.col("pixel_width"), F.col("pixel_height")
    return lib.assets.select(
        "asset_id",
        F.round(media.photo_aspect_ratio(width, height), 6).alias("photo_ratio"),
        F.round(media.video_aspect_ratio(width, height), 6).alias("video_ratio"),
    )


@_query
def photo_tiers(lib):
    return P.photo_tiers(lib.assets)


@_query
def format_duration(lib):
    return lib.assets.select("asset_id", media.format_duration(F.col("duration")).alias("duration_text"))


@_query
def total_duration(lib):
    total = I.videos(lib.assets).agg(F.sum("duration").alias("seconds"))
    return total.select(media.format_total_duration(F.col("seconds")).alias("total_text"))


@_query
def format_bytes(lib):
    return lib.assets.select("asset_id", media.format_bytes(F.col("file_size")).alias("size_text"))


@_query
def resolution_label(lib):
    width, height = F.col("pixel_width"), F.col("pixel_height")
    return lib.assets.select(
        "asset_id",
        media.resolution_label(width, height).alias("label"),
        media.resolution_label(width, height, "×").alias("compact_label"),
    )


@_query
def resource_file_size(lib):
    return sizes.resource_sizes(lib.resources)


@_query
def resolve_size(lib):
    return sizes.resolve_sizes(lib.assets.select("asset_id", "file_size"), lib.resources)


@_query
def size_estimate(lib):
    return I.videos(lib.assets).select("asset_id", media.estimated_size(F.col("duration")).alias("estimated_size"))


@_query
def normalize_enums(lib):
    return lib.raw_codes.select(
        "asset_id",
        enums.kind_from_code(F.col("media_type")).alias("kind"),
        enums.source_from_flags(F.col("source_flags")).alias("source"),
        enums.resource_kind(F.col("resource_kind_raw")).alias("resource_kind"),
        enums.processing_state(F.col("state_raw")).alias("processing_state"),
        enums.bin_kind(F.col("bin_kind_raw")).alias("bin_kind"),
    )


def _copy_pairs(lib: DerivedLibrary) -> DataFrame:
    """Every photo copy against its original: one row per copy."""
    rows = lib.photo_features.join(lib.copies.select("asset_id", "vec_id", "copy"), "asset_id")
    original = rows.filter("copy = 0").select(
        "vec_id", F.col("dhash").alias("dhash_a"), F.col("vec").alias("vec_a")
    )
    return rows.filter("copy > 0").join(original, "vec_id")


@_query
def hamming_pairs(lib):
    return _copy_pairs(lib).select("asset_id", V.hamming(F.col("dhash_a"), F.col("dhash")).alias("hamming"))


@_query
def cosine_pairs(lib):
    cosine = V.cosine_similarity(F.col("vec_a"), F.col("vec"))
    return _copy_pairs(lib).select("asset_id", F.round(cosine, 6).alias("cosine"))


@_query
def feature_distance(lib):
    distance = V.feature_distance(F.col("vec_a"), F.col("vec"))
    return _copy_pairs(lib).select("asset_id", F.round(distance, 6).alias("distance"))


@_query
def classify_pairs(lib):
    measured = _copy_pairs(lib).select(
        "asset_id",
        V.feature_distance(F.col("vec_a"), F.col("vec")).alias("distance"),
        V.hamming(F.col("dhash_a"), F.col("dhash")).alias("bits"),
    )
    return measured.select("asset_id", V.classify_match(F.col("distance"), F.col("bits")).alias("match"))


@_query
def asset_signature(lib):
    return lib.assets.select("asset_id", F.sha2(signature_text(), 256).alias("signature"))


@_query
def bin_days_remaining(lib):
    left = media.days_remaining(F.col("deleted_at"), _now())
    return _bin(lib).select("asset_id", left.alias("days_remaining"), (left == 0).alias("is_expired"))


@_query
def dhash(lib):
    return lib.grids.select("asset_id", V.dhash(F.col("grid")).alias("dhash"))


@_query
def normalize_vectors(lib):
    rows = lib.raw_vectors.filter(V.is_usable(F.col("raw"))).select(
        "asset_id", V.l2_normalize(F.col("raw")).alias("vec")
    )
    return rows.select("asset_id", F.posexplode("vec").alias("dim", "x")).select(
        "asset_id", "dim", F.round("x", 6).alias("x")
    )


@_query
def top15_share(lib):
    totals = ranking.top_totals(VD.marked_videos(lib.assets, lib.resources))
    share = media.percent(F.col("top_bytes"), F.col("total_bytes"))
    return totals.select(F.round(F.when(F.col("videos") > 0, share).otherwise(F.lit(0.0)), 6).alias("top_percent"))


# --- filters ----------------------------------------------------------------------------------------


@_query
def videos_by_date(lib):
    return I.newest_first(I.videos(lib.assets)).select("asset_id", _plain_time("creation_date"))


@_query
def screenshots_by_date(lib):
    return I.newest_first(I.screenshots(lib.assets)).select("asset_id", _plain_time("creation_date"))


def _per_filter(rows: DataFrame, filters: dict, size: Column) -> DataFrame:
    """Every named filter over the rows in one pass: one row per filter a row passes."""
    names = F.array(*[F.when(media.size_matches(filters, n, size), F.lit(n)) for n in filters])
    return rows.select("asset_id", F.explode(F.array_compact(names)).alias("size_filter"))


@_query
def video_size_filter(lib):
    return _per_filter(I.videos(lib.assets), media.VIDEO_SIZE_FILTERS, F.col("file_size"))


@_query
def large_size_filter(lib):
    both = F.when(F.col("is_top"), F.array(F.lit("top15"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    rows = _large_videos(lib).withColumn("mode", F.explode(both))
    names = F.array(
        *[
            F.when(media.size_matches(media.LARGE_VIDEO_SIZE_FILTERS, n, F.col("file_size")), F.lit(n))
            for n in media.LARGE_VIDEO_SIZE_FILTERS
        ]
    )
    return rows.select("asset_id", "mode", F.explode(F.array_compact(names)).alias("size_filter"))


@_query
def dup_video_group_filter(lib):
    stored = G.group_storage(_duplicate_videos(lib))
    names = F.array(
        *[
            F.when(media.size_matches(media.GROUP_SIZE_FILTERS, n, F.col("largest_member")), F.lit(n))
            for n in media.GROUP_SIZE_FILTERS
        ]
    )
    return stored.select("group_id", "largest_member", F.explode(F.array_compact(names)).alias("size_filter"))


@_query
def exclude_ids(lib):
    kept = I.without_ids(I.photos(lib.assets), P.duplicate_photo_members(lib.assets, lib.photo_features))
    return kept.select("asset_id")


@_query
def bin_active(lib):
    return B.active(_bin(lib), _now()).select(
        "asset_id", "file_size", _plain_time("deleted_at"), "days_remaining", "is_urgent"
    )


def _fingerprint_states(lib: DerivedLibrary) -> DataFrame:
    return FP.fingerprint_states(lib.assets, lib.photo_fingerprints, lib.video_fingerprints)


@_query
def needs_analysis(lib):
    return _fingerprint_states(lib).filter("is_missing").select("variant", "asset_id")


@_query
def cache_hits(lib):
    return _fingerprint_states(lib).filter("is_hit").select("variant", "asset_id")


@_query
def stored_needs_analysis(lib):
    """What is missing, from an index and fingerprints that are stored in buckets of asset_id: joined where they lie."""
    tables = {"index": lib.assets, "photos": lib.photo_fingerprints, "videos": lib.video_fingerprints}
    stored = [write_bucketed(rows, _scratch(lib, name)) for name, rows in tables.items()]
    return FP.fingerprint_states(*stored).filter("is_missing").select("variant", "asset_id")


@_query
def bucket_candidates(lib):
    return blocking.bucket_candidates(P.photo_tiers(lib.assets))


# --- joins ------------------------------------------------------------------------------------------


@_query
def photo_candidate_pairs(lib):
    return blocking.candidate_hashes(P.photo_tiers(lib.assets), lib.photo_features)


@_query
def hamming_band_pairs(lib):
    return blocking.close_hashes(blocking.hash_counts(lib.photo_features), [])


@_query
def duplicate_photo_pairs(lib):
    rows = P.duplicate_matches(lib.assets, lib.photo_features)
    return rows.select("asset_id", "matches", _round("nearest_distance"), _round("mean_distance"))


@_query
def similar_photo_pairs(lib):
    rows = P.similar_matches(lib.assets, lib.photo_features)
    return rows.select("asset_id", "matches", _round("best_similarity"), _round("mean_similarity"))


@_query
def video_candidate_pairs(lib):
    rows = ranges.candidate_partners(I.videos(lib.assets))
    return rows.select(_round("duration"), _round("aspect"), "videos", "partners")


@_query
def duplicate_video_pairs(lib):
    rows = VD.duplicate_video_matches(lib.assets, _frames(lib))
    return rows.select("asset_id", "matches", _round("nearest_distance"), _round("mean_distance"))


@_query
def keyframe_sample(lib):
    rows = keyframes.sample_keyframes(I.videos(lib.assets), lib.frame_times)
    return rows.select("asset_id", "sample_idx", "frame_no", _round("gap"))


# --- components and groups --------------------------------------------------------------------------


@_query
def components(lib):
    """Components of the copy graph: every copy is linked to the one before it."""
    copies = lib.copies.select("vec_id", "copy", "asset_id")
    before = copies.select("vec_id", (F.col("copy") + 1).alias("copy"), F.col("asset_id").alias("previous"))
    edges = copies.join(before, ["vec_id", "copy"]).select("asset_id", "previous")
    same_order = lib.table("orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("asset_id"), F.concat(F.lit("c"), "o_custkey").alias("previous")
    )
    return connected_components(edges.unionByName(same_order), "asset_id", "previous")


@_query
def video_components(lib):
    """Stage 1 of duplicate videos: size of each video's candidate component, named by its first video."""
    rows = VD.video_candidates(lib.assets)
    named = rows.groupBy("component").agg(F.min("asset_id").alias("first_id"), F.count("*").alias("members"))
    return rows.join(named, "component").select("asset_id", "first_id", "members")


def _group_columns(groups: DataFrame, *extra: Column) -> DataFrame:
    return G.largest_storage_first(groups).select(
        "group_id", "member_rank", "asset_id", "file_size", "pixels", "total_storage", *extra
    )


@_query
def duplicate_photo_groups(lib):
    return _group_columns(_duplicate_photos(lib))


@_query
def incremental_photo_groups(lib):
    """Duplicate groups from stored fingerprints where they are valid, recomputed ones elsewhere."""
    groups = P.incremental_duplicate_groups(lib.assets, lib.photo_fingerprints, lib.photo_features, lib.resources)
    return _group_columns(groups)


@_query
def delta_photo_groups(lib):
    """Duplicate groups of an earlier state of the library, brought up to date by what was added, edited and deleted since."""
    state = P.duplicate_match_state(*lib.earlier)
    changed, deleted = lib.since_earlier
    features = I.with_ids(lib.photo_features, changed)
    state = P.updated_match_state(state, changed, features, deleted)
    return _group_columns(P.duplicate_groups_of(state, lib.assets, lib.resources))


@_query
def similar_photo_groups(lib):
    groups = _similar_photos(lib)
    return _group_columns(groups, _round("average_similarity"))


@_query
def duplicate_video_groups(lib):
    return _group_columns(_duplicate_videos(lib))


@_query
def group_storage(lib):
    return G.group_storage(_duplicate_photos(lib))


@_query
def best_copy(lib):
    return G.representatives(_duplicate_photos(lib)).select("group_id", "asset_id", "file_size", "pixels")


@_query
def deletion_candidates(lib):
    return G.deletion_candidates(_duplicate_videos(lib)).select("group_id", "member_rank", "asset_id", "file_size")


@_query
def groups_removing(lib):
    left = G.remove_from_groups(_duplicate_photos(lib), lib.deleted_ids)
    return left.select("group_id", "member_rank", "asset_id", "file_size", "total_storage")


@_query
def group_similarity(lib):
    groups = _similar_photos(lib).filter("member_rank = 1")
    return groups.select(
        "group_id",
        _round("average_similarity"),
        F.round(F.col("average_similarity") * 100, 4).alias("percent"),
    )


# --- aggregates and reports -------------------------------------------------------------------------


@_query
def index_summary(lib):
    return I.summary(lib.assets)


@_query
def latest_index(lib):
    return I.latest_index(lib.assets).select(_plain_time("latest_indexed_at"))


@_query
def dup_rollup(lib):
    kinds = {"photo": ("duplicatePhotos", "similarPhotos"), "video": ("duplicateVideos",)}
    rolled = report.analysis_rollups(_analyses(lib))
    kind = F.when(F.col("category").isin(*kinds["video"]), F.lit("video")).otherwise(F.lit("photo"))
    of_kind = lib.assets.groupBy("kind").agg(F.count("*").alias("of_kind"))
    # similar photos are analysed after the duplicates are taken out; the window runs over three rows
    excluded = F.max(F.when(F.col("category") == "duplicatePhotos", F.col("member_count"))).over(Window.partitionBy())
    less = F.when(F.col("category") == "similarPhotos", excluded).otherwise(F.lit(0))
    return (
        rolled.withColumn("kind", kind)
        .withColumn("less", less)
        .join(of_kind, "kind")
        .select(
            "category",
            "group_count",
            "member_count",
            "deletable_copies",
            "reclaimable_bytes",
            (F.col("of_kind") - F.col("less")).alias("analyzed"),
        )
    )


@_query
def total_cleanable(lib):
    return report.total_cleanable(report.analysis_rollups(_analyses(lib)))


@_query
def large_video_totals(lib):
    return ranking.top_totals(VD.marked_videos(lib.assets, lib.resources))


@_query
def bin_totals(lib):
    return B.totals(_bin(lib), _now())


@_query
def dashboard_snapshot(lib):
    rows = report.dashboard_snapshot(lib.assets, _analyses(lib), B.totals(_bin(lib), _now()))
    return rows.select("ordinal", "category", "state", "count")


@_query
def category_share(lib):
    return report.category_shares(lib.assets, _analyses(lib)).select("category", "count", _round("share"))


@_query
def preview_top3(lib):
    return report.preview_ids(lib.assets, _analyses(lib))


@_query
def analysis_key(lib):
    photo = report.input_digest(lib.assets, "photo", lib.deleted_ids).select(F.lit("photo").alias("kind"), "*")
    video = report.input_digest(lib.assets, "video").select(F.lit("video").alias("kind"), "*")
    return photo.unionByName(video)


# --- ranking ----------------------------------------------------------------------------------------


@_query
def video_rank(lib):
    sized = sizes.resolve_or_estimate(I.videos(lib.assets).select("asset_id", "duration", "file_size"), lib.resources)
    return ranking.rank_by_size(sized).select("asset_id", "file_size", "rank")


@_query
def large_videos_top15(lib):
    return VD.filter_large(_large_videos(lib), "top15", "all").select("asset_id", "file_size", "rank")


@_query
def large_videos_removing(lib):
    left = ranking.without_and_reranked(_large_videos(lib), lib.deleted_ids)
    return left.select("asset_id", "file_size", "rank", "is_top")


# --- streaming and featurizer -----------------------------------------------------------------------


def _in_turn(rows: DataFrame, by: Column, key: str, root: str, turns: int = STREAM_TURNS) -> DataFrame:
    """``rows`` as a stream of ``turns`` micro-batches of several files each: those with by = 0 come first, and so on."""
    files = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(turns):
        rows.filter(by == turn).repartition(files, key).write.mode("append").parquet(root)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(root)


def _event_stream(lib: DerivedLibrary, root: str) -> DataFrame:
    """The events in order of time, in equal spans of it."""
    events = lib.table("events")
    lo, hi = events.select(F.min("ts").cast("timestamp").cast("double"), F.max("ts").cast("timestamp").cast("double")).first()
    share = (F.col("ts").cast("timestamp").cast("double") - (lo or 0.0)) / max((hi or 0.0) - (lo or 0.0), 1.0)
    return _in_turn(events, F.least(F.floor(share * STREAM_TURNS), F.lit(STREAM_TURNS - 1)), "event_id", f"{root}/events")


@_query
def stream_index(lib):
    root = _scratch(lib, "changes")
    feed = lib.change_rows(_event_stream(lib, root))
    index = cut_lineage(lib.assets)
    stream_changes.maintain_index(feed, index, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    current = stream_changes.apply_changes(index, stream_changes.read_changes(lib.spark, f"{root}/log"))
    return current.select("asset_id", "kind", _plain_time("modification_date"))


@_query
def stream_bin(lib):
    root = _scratch(lib, "bin")
    feed = lib.deletion_rows(_event_stream(lib, root))
    stream_deletions.fill_bin(feed, f"{root}/events-of-bin", f"{root}/checkpoint").awaitTermination()
    entries = stream_deletions.bin_entries(stream_deletions.read_events(lib.spark, f"{root}/events-of-bin"))
    return B.active(entries, _now()).select("asset_id", "file_size", _plain_time("deleted_at"), "days_remaining")


@_query
def stream_fingerprints(lib):
    """Fingerprints of a feed of images of which every third comes twice."""
    root = _scratch(lib, "fingerprints")
    number = F.regexp_extract("image.origin", r"a(\d+)_", 1).cast("long")
    again = lib.images.filter(number % 3 == 0).withColumn("turn", F.lit(3))
    images = lib.images.withColumn("turn", (number % 3).cast("int")).unionByName(again)
    feed = _in_turn(images, F.col("turn"), "image.origin", f"{root}/images", 4).select("image")
    photos = cut_lineage(I.photos(lib.assets))
    stored = lib.spark.createDataFrame([], PHOTO_FINGERPRINTS)
    stream_prints.fingerprint_new_images(feed, photos, stored, f"{root}/prints", f"{root}/checkpoint").awaitTermination()
    prints = stream_prints.read_prints(lib.spark, f"{root}/prints")
    rows = prints.groupBy("asset_id").agg(F.count(F.lit(1)).alias("stored"))
    kept = stream_prints.fingerprints_of(prints, photos, _now()).select("asset_id", "dhash")
    return kept.join(rows, "asset_id").select("asset_id", "dhash", "stored")


@_query
def featurize(lib):
    rows = FP.featurize(lib.images)
    return rows.select("asset_id", "dhash", F.posexplode("feature_vector").alias("dim", "x")).select(
        "asset_id", "dhash", "dim", F.round("x", 6).alias("x")
    )
