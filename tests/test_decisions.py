"""One test per semantic decision, on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from frameloom.functions import enums, media
from frameloom.functions import vectors as V
from frameloom.operators import bin as B
from frameloom.operators import fingerprints as FP
from frameloom.operators import groups as G
from frameloom.operators import index as I
from frameloom.operators import keyframes, ranking, report, sizes
from frameloom.plans import photos as P
from frameloom.plans import videos as VD

NOW = "2024-02-15 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def moment(text):
    return dt.datetime.fromisoformat(text)


def test_rows_expire_with_less_than_a_day_left(spark):
    rows = [
        ("gone30", moment("2024-01-16 00:00:00")),
        ("gone29h", moment("2024-01-16 23:59:59")),
        ("alive29", moment("2024-01-17 00:00:00")),
        ("urgent", moment("2024-01-19 12:00:00")),
        ("fresh", moment("2024-02-14 23:00:00")),
    ]
    bin_rows = spark.createDataFrame(rows, "asset_id string, deleted_at timestamp").withColumn("file_size", F.lit(5))
    active = {r.asset_id: (r.days_remaining, r.is_urgent) for r in B.active(bin_rows, now()).collect()}
    assert active == {"alive29": (1, True), "urgent": (3, True), "fresh": (29, False)}
    assert B.purge(bin_rows, now()).count() == 3
    assert B.totals(bin_rows, now()).first().active_bytes == 15


def test_second_deletion_keeps_the_first_row(spark):
    schema = "asset_id string, kind string, file_size long, deleted_at timestamp"
    old = spark.createDataFrame([("a", "photo", 1, moment("2020-01-01"))], schema)
    new = spark.createDataFrame(
        [("a", "photo", 2, moment("2024-01-01")), ("b", "photo", 3, moment("2024-01-03")), ("b", "photo", 4, moment("2024-01-02"))],
        schema,
    )
    rows = {r.asset_id: r.file_size for r in B.add(old, new, ["deleted_at"]).collect()}
    assert rows == {"a": 1, "b": 4}
    left = B.remove(old, new.select("asset_id"))
    assert left.count() == 0


def test_entries_default_to_size_zero_and_photo(spark):
    assets = spark.createDataFrame([("a", "unknown", None), ("v", "video", 7)], "asset_id string, kind string, file_size long")
    rows = {r.asset_id: (r.kind, r.file_size) for r in B.entries_from_assets(assets, now()).collect()}
    assert rows == {"a": ("photo", 0), "v": ("video", 7)}


@pytest.mark.parametrize(
    ("width", "height", "photo", "video"), [(4000, 3000, 4 / 3, 4 / 3), (0, 100, 100.0, 1.0), (-5, -5, 1.0, 1.0), (100, 200, 2.0, 2.0)]
)
def test_aspect_ratio_of_bad_sizes(spark, width, height, photo, video):
    w, h = F.lit(width), F.lit(height)
    assert value(spark, media.photo_aspect_ratio(w, h)) == pytest.approx(photo)
    assert value(spark, media.video_aspect_ratio(w, h)) == pytest.approx(video)


def test_tiers_round_half_away_from_zero(spark):
    # 1250 x 1000 is 1.25 megapixels: twice that is 2.5 and rounds to 3
    assert value(spark, media.megapixel_tier(F.lit(1250), F.lit(1000))) == 3
    assert value(spark, media.aspect_tier(F.lit(1250), F.lit(1000))) == 125
    assert value(spark, media.megapixel_tier(F.lit(60000), F.lit(60000))) == 7200  # no integer overflow


@pytest.mark.parametrize(
    ("seconds", "text"), [(0.0, "00:00"), (-1.0, "00:00"), (59.5, "01:00"), (3599.4, "59:59"), (3725.0, "1:02:05"), (0.2, "00:00")]
)
def test_duration_text(spark, seconds, text):
    assert value(spark, media.format_duration(F.lit(seconds))) == text


@pytest.mark.parametrize(("seconds", "text"), [(7325.0, "2h 2m"), (125.0, "2m 5s"), (45.4, "45s"), (0.0, "0s")])
def test_total_duration_text(spark, seconds, text):
    assert value(spark, media.format_total_duration(F.lit(seconds))) == text


@pytest.mark.parametrize(
    ("size", "text"),
    [(None, None), (0, None), (-4, None), (999, "999 B"), (1500, "2 KB"), (1_250_000, "1.3 MB"), (2_004_000_000, "2.00 GB"), (3_456_000_000_000, "3.46 TB")],
)
def test_byte_text(spark, size, text):
    assert value(spark, media.format_bytes(F.lit(size).cast("long"))) == text


def test_resolution_labels(spark):
    def label(w, h):
        return value(spark, media.resolution_label(F.lit(w), F.lit(h)))

    assert [label(3840, 2160), label(2160, 3840), label(1080, 1920), label(1280, 720), label(640, 480), label(0, 5)] == [
        "4K", "4K", "1080p", "720p", "640 × 480", "",
    ]
    # long enough but too flat for the next label
    assert label(3840, 2000) == "1080p"


def test_unknown_sizes_match_only_the_open_filter(spark):
    size = F.lit(None).cast("long")
    for filters in (media.VIDEO_SIZE_FILTERS, media.LARGE_VIDEO_SIZE_FILTERS, media.GROUP_SIZE_FILTERS):
        passed = [name for name in filters if value(spark, media.size_matches(filters, name, size))]
        assert passed == ["all"]


def test_size_filters_overlap_and_use_binary_megabytes(spark):
    size = F.lit(1024 * 1024 * 1024).cast("long")
    assert [n for n in media.VIDEO_SIZE_FILTERS if value(spark, media.size_matches(media.VIDEO_SIZE_FILTERS, n, size))] == ["all", "over1GB"]
    assert [n for n in media.GROUP_SIZE_FILTERS if value(spark, media.size_matches(media.GROUP_SIZE_FILTERS, n, size))] == ["all", "min500MB", "min1GB"]


def test_enum_fallbacks(spark):
    row = spark.range(1).select(
        enums.kind_from_code(F.lit(3)).alias("a"),
        enums.source_from_flags(F.lit(6)).alias("b"),
        enums.source_from_flags(F.lit(7)).alias("c"),
        enums.resource_kind(F.lit("new")).alias("d"),
        enums.processing_state(F.lit(None).cast("string")).alias("e"),
        enums.asset_kind(F.lit("video")).alias("f"),
        enums.bin_kind(F.lit("x")).alias("g"),
        enums.asset_source(F.lit("cloudShared")).alias("h"),
    ).first()
    assert tuple(row) == ("unknown", "cloudShared", "userLibrary", "unknown", "failed", "video", "unknown", "cloudShared")


def test_vector_edge_cases(spark):
    def arr(*xs):
        return F.array(*[F.lit(float(x)) for x in xs])

    empty = F.array().cast("array<double>")
    assert value(spark, V.is_usable(arr(0, 0))) is False
    assert value(spark, V.is_usable(empty)) is False
    assert value(spark, V.l2_normalize(arr(3, 4))) == [0.6, 0.8]
    assert value(spark, V.cosine_similarity(arr(1, 0), arr(1, 0, 0))) == 0.0
    assert value(spark, V.cosine_similarity(empty, empty)) == 0.0
    assert value(spark, V.cosine_similarity(arr(2, 0), arr(2, 0))) == 1.0
    assert value(spark, V.feature_distance(arr(1, 0), arr(1, 0, 0))) is None


def test_hash_and_hamming(spark):
    rising = F.array(*[F.lit(float(i % 9)) for i in range(72)])
    falling = F.array(*[F.lit(float(-(i % 9))) for i in range(72)])
    first_only = F.array(*[F.lit(1.0 if i == 1 else 0.0) for i in range(72)])
    assert value(spark, V.dhash(rising)) == -1
    assert value(spark, V.dhash(falling)) == 0
    assert value(spark, V.dhash(first_only)) == -(2**63)
    assert value(spark, V.dhash(F.array(F.lit(1.0)))) is None
    assert value(spark, V.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64


def test_thresholds_are_inclusive(spark):
    def match(d, h):
        return value(spark, V.classify_match(F.lit(d), F.lit(h)))

    assert [match(0.05, 4), match(0.05, 5), match(0.22, 16), match(0.0, 17), match(0.2201, 0)] == [
        "duplicate", "similar", "similar", "distinct", "distinct",
    ]


PHOTO = "asset_id string, kind string, pixel_width int, pixel_height int, file_size long"
FEATURE = "asset_id string, dhash long, vec array<double>"


def angle(degrees):
    import math

    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def test_groups_are_transitive_and_best_copy_first(spark):
    # neighbours are 2 degrees apart (distance 0.035); the ends are not within 0.05 of each other
    assets = spark.createDataFrame(
        [("a", "photo", 100, 100, 10), ("b", "photo", 100, 100, 30), ("c", "photo", 100, 100, 30), ("d", "photo", 900, 900, 99), ("e", "video", 100, 100, 1)],
        PHOTO,
    )
    features = spark.createDataFrame(
        [("a", 0, angle(0)), ("b", 1, angle(2)), ("c", 3, angle(4)), ("d", 0, angle(0)), ("e", 0, angle(0))], FEATURE
    )
    rows = P.duplicate_photo_groups(assets, features).orderBy("member_rank").collect()
    assert [(r.group_id, r.asset_id) for r in rows] == [("b", "b"), ("b", "c"), ("b", "a")]
    assert rows[0].total_storage == 70


def test_sizes_are_looked_up_for_members(spark):
    assets = spark.createDataFrame([("a", "photo", 10, 10, None), ("b", "photo", 10, 10, 50), ("c", "photo", 10, 10, 0)], PHOTO)
    features = spark.createDataFrame([(x, 5, [1.0, 0.0]) for x in "abc"], FEATURE)
    resources = spark.createDataFrame(
        [("a", "photo", 100), ("a", "adjustmentData", 400), ("c", "photo", -1)], "asset_id string, kind string, file_size long"
    )
    rows = P.duplicate_photo_groups(assets, features, resources).orderBy("member_rank").collect()
    assert [(r.asset_id, r.file_size) for r in rows] == [("a", 400), ("b", 50), ("c", 0)]
    video = spark.createDataFrame([("v", "pairedVideo", 5), ("v", "photo", 9)], "asset_id string, kind string, file_size long")
    assert sizes.resource_sizes(video).first().looked_up_size == 5


def test_similar_keeps_pairs_without_hash_at_the_ceiling(spark):
    assets = spark.createDataFrame([(x, "photo", 10, 10, 5) for x in "abcd"], PHOTO)
    features = spark.createDataFrame([("a", None, [1.0, 0.0]), ("b", 0, [1.0, 0.0]), ("c", 0, [0.0, 1.0]), ("d", 0, [0.0, 1.0])], FEATURE)
    none = spark.createDataFrame([], "asset_id string")
    rows = P.similar_photo_groups(assets, features, none).collect()
    assert {r.asset_id for r in rows} == {"a", "b"}
    assert all(r.average_similarity == pytest.approx(1.0) for r in rows)
    only = P.similar_photo_groups(assets, features, spark.createDataFrame([("a",)], "asset_id string"))
    assert only.count() == 0


def test_mean_similarity_counts_verified_pairs_with_their_copies(spark):
    # a and its exact copy b are duplicates of each other; c is similar to both
    assets = spark.createDataFrame([(x, "photo", 10, 10, 5) for x in "abc"], PHOTO)
    features = spark.createDataFrame([("a", 0, angle(0)), ("b", 0, angle(0)), ("c", -1, angle(20))], FEATURE)
    none = spark.createDataFrame([], "asset_id string")
    rows = P.similar_photo_groups(assets, features, none).collect()
    assert len(rows) == 3 and rows[0].average_similarity == pytest.approx(angle(20)[0])


VIDEO = "asset_id string, kind string, duration double, pixel_width int, pixel_height int, file_size long"


def frames_of(*degrees):
    return [angle(d) for d in degrees]


def test_missing_frame_shifts_the_rest(spark):
    videos = spark.createDataFrame([(x, "video", 10.0, 4, 3, 9) for x in "abc"], VIDEO)
    frame_rows = spark.createDataFrame(
        [(v, i, angle(20 * i)) for v in "ab" for i in range(5) if not (v == "b" and i == 1)] + [("c", i, angle(20 * i)) for i in range(3)],
        "asset_id string, frame_idx int, vec array<double>",
    )
    frames = keyframes.collect_frames(frame_rows)
    # b has four frames, compared by position: its second frame is a's third
    assert VD.duplicate_video_groups(videos, frames).count() == 0
    same = frames.filter("asset_id <> 'b'").unionByName(
        frames.filter("asset_id = 'a'").select(F.lit("b").alias("asset_id"), F.slice("frames", 1, 4).alias("frames"))
    )
    assert {r.asset_id for r in VD.duplicate_video_groups(videos, same).collect()} == {"a", "b"}


def test_chained_videos_are_compared_without_rechecking_duration(spark):
    # a and c are 1.8 s apart but in one component through b
    videos = spark.createDataFrame(
        [("a", "video", 10.0, 4, 3, 9), ("b", "video", 10.9, 4, 3, 9), ("c", "video", 11.8, 4, 3, 99)], VIDEO
    )
    frames = spark.createDataFrame(
        [("a", frames_of(0, 0, 0, 0)), ("b", frames_of(90, 90, 90, 90)), ("c", frames_of(0, 0, 0, 0))],
        "asset_id string, frames array<array<double>>",
    )
    rows = VD.duplicate_video_groups(videos, frames).orderBy("member_rank").collect()
    assert [r.asset_id for r in rows] == ["c", "a"]


def test_keyframes_need_three_hits(spark):
    videos = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("short", 0.3)], "asset_id string, duration double")
    times = spark.createDataFrame(
        [("a", 1, 1.1), ("a", 2, 0.95), ("a", 3, 3.0), ("a", 4, 5.1), ("b", 1, 1.0), ("b", 2, 3.0), ("b", 3, 4.0), ("short", 1, 0.03)],
        "asset_id string, frame_no int, frame_time double",
    )
    rows = keyframes.sample_keyframes(videos, times).orderBy("sample_idx").collect()
    assert [(r.asset_id, r.sample_idx, r.frame_no) for r in rows] == [("a", 0, 2), ("a", 1, 3), ("a", 2, 4)]


GROUPS = "group_id string, member_rank int, asset_id string, file_size long, pixels long, total_storage long"


@pytest.mark.parametrize("max_window_rows", [1_000_000, 0])
def test_removal_promotes_the_next_and_keeps_the_id(spark, max_window_rows):
    groups = spark.createDataFrame(
        [("a", 1, "a", 9, 1, 12), ("a", 2, "b", 2, 1, 12), ("a", 3, "c", 1, 1, 12), ("x", 1, "x", 5, 1, 6), ("x", 2, "y", 1, 1, 6)], GROUPS
    )
    gone = spark.createDataFrame([("a",), ("x",)], "asset_id string")
    left = G.remove_from_groups(groups, gone, max_window_rows).orderBy("member_rank").collect()
    assert [(r.group_id, r.member_rank, r.asset_id, r.total_storage) for r in left] == [("a", 1, "b", 3), ("a", 2, "c", 3)]
    nothing = spark.createDataFrame([], "asset_id string")
    assert sorted(map(tuple, G.remove_from_groups(groups, nothing, max_window_rows).collect())) == sorted(map(tuple, groups.collect()))


def test_rollup_and_selections(spark):
    groups = spark.createDataFrame([("a", 1, "a", 9, 1, 9), ("a", 2, "b", None, 1, 9), ("a", 3, "c", 4, 1, 9)], GROUPS)
    assert tuple(G.rollup(groups).first()) == (1, 3, 2, 4)
    assert tuple(G.rollup(groups.limit(0)).first()) == (0, 0, 0, 0)
    assert {r.asset_id for r in G.member_ids(groups, "extra_copies").collect()} == {"b", "c"}
    assert G.selection(groups, keep_best=False).count() == 3
    assert G.filter_by_group_size(groups, "under100MB").count() == 3
    assert G.filter_by_group_size(groups, "min500MB").count() == 0


@pytest.mark.parametrize("max_window_rows", [1_000_000, 0])
def test_ties_end_in_the_id(spark, max_window_rows):
    members = spark.createDataFrame([(x, "g" if x < "m" else "h") for x in "dbxycaz"], "asset_id string, component string")
    assets = spark.createDataFrame([(x, "photo", 10, 10, 5) for x in "abcdxyz"], PHOTO)
    rows = G.assemble_groups(members, assets, None, G.BEST_BY_SIZE, max_window_rows).orderBy("group_id", "member_rank").collect()
    assert [(r.group_id, r.asset_id) for r in rows] == [("a", x) for x in "abcd"] + [("x", x) for x in "xyz"]


def test_global_rank_over_many_partitions(spark):
    df = spark.range(500).select(F.concat(F.lit("a"), F.format_string("%04d", "id")).alias("asset_id"), (F.col("id") % 7).alias("file_size"))
    ranked = ranking.global_rank(df, [F.desc("file_size"), F.asc("asset_id")], partitions=6).collect()
    order = sorted(((-(i % 7), f"a{i:04d}") for i in range(500)))
    assert sorted((r["rank"], r.asset_id) for r in ranked) == [(k + 1, name) for k, (_, name) in enumerate(order)]


@pytest.mark.parametrize(("rows", "top"), [(0, 0), (1, 1), (6, 1), (7, 2), (20, 3), (21, 4)])
def test_top_fraction_rounds_up(rows, top):
    assert ranking.top_count(rows) == top


def test_large_videos_of_an_empty_library(spark):
    empty = spark.createDataFrame([], VIDEO + ", creation_date timestamp")
    totals = ranking.top_totals(VD.large_videos(empty)).first()
    assert tuple(totals) == (0, 0, 0, 0, 0)


INDEX = (
    "asset_id string, kind string, modification_date timestamp, creation_date timestamp, pixel_width int, pixel_height int, "
    "duration double, file_size long, uniform_type_identifiers array<string>, original_filenames array<string>, is_screenshot boolean"
)


def record(asset_id, size=1, names=("x",), kind="photo"):
    return (asset_id, kind, moment("2024-01-01"), None, 10, 10, 0.0, size, ["u"], list(names), False)


def stored(spark, index, **columns):
    rows = FP.fingerprint_rows(index.select("asset_id", F.lit(5).cast("long").alias("dhash"), F.array(F.lit(1.0)).alias("feature_vector")), index, now())
    return rows.withColumns(columns)


def test_changed_assets_are_analysed_once(spark):
    before = spark.createDataFrame([record("a"), record("b", names=("p", "q"))], INDEX)
    cache = stored(spark, before)
    after = spark.createDataFrame([record("a", size=2), record("b", names=("q", "p")), record("n")], INDEX)
    assert {r.asset_id for r in FP.needs_analysis(after, cache, "similar").collect()} == {"a", "n"}
    assert {r.asset_id for r in FP.cache_hits(after, cache, "duplicate").collect()} == {"b"}
    redone = stored(spark, FP.needs_analysis(after, cache, "similar"))
    assert FP.needs_analysis(after, FP.upsert_photos(cache, redone), "similar").count() == 0


def test_upsert_keeps_the_hash_of_an_unchanged_asset_only(spark):
    index = spark.createDataFrame([record("a"), record("b")], INDEX)
    cache = stored(spark, index)
    edited = spark.createDataFrame([record("a"), record("b", size=9)], INDEX)
    new = stored(spark, edited, dhash=F.lit(None).cast("long"))
    assert {r.asset_id: r.dhash for r in FP.upsert_photos(cache, new).collect()} == {"a": 5, "b": None}


def test_payload_rules_per_variant(spark):
    index = spark.createDataFrame([record("a")], INDEX)
    no_hash = stored(spark, index, dhash=F.lit(None).cast("long"))
    assert FP.cache_hits(index, no_hash, "similar").count() == 1
    assert FP.cache_hits(index, no_hash, "duplicate").count() == 0
    assert FP.needs_analysis(index, no_hash, "similar").count() == 1
    states = FP.fingerprint_states(index, no_hash, no_hash.withColumn("frames", F.array(F.array(F.lit(1.0)))))
    assert sorted(map(tuple, states.collect())) == [("duplicate", "a", True, False), ("similar", "a", True, True)]
    old = stored(spark, index, schema_version=F.lit(0))
    assert FP.needs_analysis(index, old, "duplicate").count() == 1
    failed = stored(spark, index, status=F.lit("failed"))
    assert FP.cache_hits(index, failed, "similar").count() == 0


def test_resources_fold_into_the_index(spark):
    library = spark.createDataFrame(
        [("a", [("photo", "u", "f", 5), ("odd", None, "f", 9)]), ("b", None)],
        "asset_id string, resources array<struct<kind:string,uti:string,filename:string,file_size:bigint>>",
    )
    a, b = I.index_records(library, now()).orderBy("asset_id").collect()
    assert (a.resource_types, a.uniform_type_identifiers, a.original_filenames, a.file_size) == (["photo", "unknown"], ["u"], ["f"], 9)
    assert (b.resource_types, b.file_size) == ([], None)
    assert [r.resource_id for r in I.explode_resources(library).orderBy("asset_id", "idx").collect()] == ["a#0", "a#1", None]


def test_newest_first_puts_missing_dates_last(spark):
    rows = [("a", None), ("b", moment("2020-01-01")), ("c", moment("2021-01-01"))]
    assert [r.asset_id for r in I.newest_first(spark.createDataFrame(rows, "asset_id string, creation_date timestamp")).collect()] == ["c", "b", "a"]


def test_summary_counts_failures(spark):
    index = spark.createDataFrame([record("a"), record("v", kind="video")], INDEX)
    failures = spark.createDataFrame([("x",)], "asset_id string")
    assert tuple(I.summary(index, failures).first()) == (2, 1, 1, 0, 1)


def test_snapshot_states_and_shares(spark):
    index = spark.createDataFrame([record("v", kind="video")] * 99, INDEX)
    groups = spark.createDataFrame([("a", 1, "a", 9, 1, 9), ("a", 2, "b", 1, 1, 9)], GROUPS)
    analyses = {"duplicatePhotos": groups, "duplicateVideos": groups.limit(0), "similarPhotos": None}
    totals = spark.createDataFrame([(0, 0)], "active_items long, active_bytes long")
    rows = report.dashboard_snapshot(index, analyses, totals).collect()
    assert [(r.category, r.state, r["count"]) for r in rows] == [
        ("screenshots", "empty", None),
        ("videos", "available", 99),
        ("duplicatePhotos", "available", 1),
        ("duplicateVideos", "empty", None),
        ("similarPhotos", "notAnalyzed", None),
        ("largeVideos", "available", 99),
        ("bin", "empty", None),
    ]
    busy = report.dashboard_snapshot(index, analyses, totals, frozenset({"similarPhotos"}), {"duplicatePhotos": "no access"})
    states = {r.category: (r.state, r.message) for r in busy.collect()}
    assert states["similarPhotos"][0] == "loading" and states["duplicatePhotos"] == ("failed", "no access")
    shares = {r.category: r.share for r in report.category_shares(index, analyses).collect()}
    assert shares["duplicatePhotos"] == 0.02 and shares["duplicateVideos"] is None
    assert shares["videos"] == pytest.approx(99 / 200)


def test_digest_ignores_order_and_partitioning(spark):
    index = spark.createDataFrame([record(f"a{i}") for i in range(50)], INDEX)
    one = report.input_digest(index, "photo")
    assert report.is_unchanged(one, report.input_digest(index.repartition(7).orderBy(F.desc("asset_id")), "photo"))
    assert not report.is_unchanged(one, report.input_digest(index.filter("asset_id <> 'a3'"), "photo"))
