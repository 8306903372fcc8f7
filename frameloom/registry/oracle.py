"""The same queries as plain SQL over the benchmark tables, written independently of the operators:
all pairs are compared and components are found by recursive reachability."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-02-15 00:00:00'"

# name -> (names it reads, body)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "assets": (
        (),
        """
        SELECT concat('a', e.vec_id, '_', c.copy) AS asset_id, e.vec_id, c.copy,
               CASE WHEN e.vec_id % 5 = 0 THEN 'video' ELSE 'photo' END AS kind,
               CASE WHEN (e.vec_id*5 + c.copy) % 37 = 0 THEN NULL ELSE o.o_orderdate END AS creation_date,
               o.o_orderdate AS modification_date,
               CAST((CASE e.vec_id % 6 WHEN 0 THEN 4032 WHEN 1 THEN 3024 WHEN 2 THEN 3840 WHEN 3 THEN 1920 WHEN 4 THEN 1280 ELSE 1170 END)
                    * (CASE WHEN c.copy = 4 THEN 0.5 ELSE 1.0 END) AS INT) AS pixel_width,
               CAST((CASE e.vec_id % 6 WHEN 0 THEN 3024 WHEN 1 THEN 4032 WHEN 2 THEN 2160 WHEN 3 THEN 1080 WHEN 4 THEN 720 ELSE 2532 END)
                    * (CASE WHEN c.copy = 4 THEN 0.5 ELSE 1.0 END) AS INT) AS pixel_height,
               CASE WHEN e.vec_id % 5 = 0
                    THEN CAST(5 AS DOUBLE) + CAST((e.vec_id % 200) AS DOUBLE) * CAST(1.5 AS DOUBLE) + CAST(c.copy AS DOUBLE) * CAST(0.2 AS DOUBLE)
                    ELSE CAST(0 AS DOUBLE) END AS duration,
               (e.vec_id % 5 <> 0 AND e.vec_id % 11 = 0) AS is_screenshot,
               CASE WHEN (e.vec_id*5 + c.copy) % 13 = 0 THEN NULL
                    WHEN (e.vec_id*5 + c.copy) % 17 = 0 THEN CAST(0 AS BIGINT)
                    ELSE CAST(floor(o.o_totalprice * (CASE WHEN e.vec_id % 5 = 0 THEN 5000 ELSE 20 END)) AS BIGINT) END AS file_size
        FROM embeddings e CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS c(copy)
        JOIN orders o ON o.o_orderkey = (e.vec_id*5 + c.copy) * 7919 % (SELECT count(*) FROM orders)""",
    ),
    "raw": (
        (),
        """
        SELECT concat('a', e.vec_id, '_', c.copy) AS asset_id, e.vec_id, c.copy,
               list_transform(e.embedding, lambda x, i: CAST(x AS DOUBLE)
                   + c.noise * CAST((((i - 1) * 7 + e.vec_id * 3) % 5) - 2 AS DOUBLE)) AS v
        FROM embeddings e CROSS JOIN (VALUES (0, 0.0::DOUBLE), (1, 0.002::DOUBLE), (2, 0.03::DOUBLE), (3, 0.05::DOUBLE), (4, 0.002::DOUBLE)) AS c(copy, noise)""",
    ),
    "unit": (
        ("raw",),
        """
        SELECT asset_id, vec_id, copy, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vec
        FROM raw WHERE list_dot_product(v, v) > 0""",
    ),
    "hashes": (
        ("raw",),
        """
        SELECT asset_id, vec_id, copy,
               CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS dhash
        FROM (SELECT asset_id, vec_id, copy,
                     list_reduce(list_transform(range(0, 64), lambda k: CASE WHEN g[k + k // 8 + 1] < g[k + k // 8 + 2] THEN 1::HUGEINT ELSE 0::HUGEINT END),
                                 lambda a, x: a * 2 + x) AS h
              FROM (SELECT asset_id, vec_id, copy, list_concat(v, v[1:8]) AS g FROM raw))""",
    ),
    "features": (
        ("unit", "hashes"),
        "SELECT u.asset_id, u.vec_id, u.copy, u.vec, h.dhash FROM unit u JOIN hashes h USING (asset_id) WHERE u.vec_id % 5 <> 0",
    ),
    "tiers": (
        ("assets",),
        """
        SELECT asset_id,
               CAST(round(CAST(greatest(pixel_width, pixel_height) AS DOUBLE) / least(pixel_width, pixel_height) * 100) AS INT) AS aspect_tier,
               CAST(round(CAST(pixel_width AS DOUBLE) * pixel_height / 1000000.0::DOUBLE * 2) AS INT) AS megapixel_tier
        FROM assets WHERE kind = 'photo'""",
    ),
    "resources": (
        (),
        """
        SELECT concat('a', e.vec_id, '_', c.copy) AS asset_id, e.vec_id, 0 AS idx,
               CASE WHEN e.vec_id % 5 = 0 THEN 'video' ELSE 'photo' END AS kind,
               CASE WHEN e.vec_id % 5 = 0 THEN 'public.mpeg-4' ELSE 'public.jpeg' END AS uti,
               concat('IMG_', e.vec_id) AS filename,
               CASE WHEN e.vec_id % 7 = 0 THEN NULL ELSE 900000 + e.vec_id * 1000 END AS file_size
        FROM embeddings e CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS c(copy)
        UNION ALL
        SELECT concat('a', e.vec_id, '_', c.copy), e.vec_id, 1, 'adjustmentData', NULL, 'Adjustments', 4096
        FROM embeddings e CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS c(copy)""",
    ),
    "lookup": (
        ("resources",),
        """
        SELECT asset_id, CAST(coalesce(max(CASE WHEN file_size > 0 AND kind = 'video' THEN file_size END),
                                       max(CASE WHEN file_size > 0 THEN file_size END)) AS BIGINT) AS looked_up_size
        FROM resources GROUP BY asset_id""",
    ),
    "sized": (
        ("assets", "lookup"),
        """
        SELECT a.* EXCLUDE (file_size), CAST(a.pixel_width AS BIGINT) * a.pixel_height AS pixels,
               CASE WHEN a.file_size > 0 THEN a.file_size WHEN l.looked_up_size > 0 THEN l.looked_up_size ELSE a.file_size END AS file_size
        FROM assets a LEFT JOIN lookup l USING (asset_id)""",
    ),
    "ranked": (
        ("sized",),
        """
        SELECT asset_id, size AS file_size, row_number() OVER (ORDER BY size DESC, asset_id) AS rank,
               row_number() OVER (ORDER BY size DESC, asset_id) <= ceil(count(*) OVER () * 0.15::DOUBLE) AS is_top
        FROM (SELECT asset_id, CASE WHEN file_size > 0 THEN file_size
                                    ELSE greatest(500000, CAST(floor(duration * 2500000) AS BIGINT)) END AS size
              FROM sized WHERE kind = 'video')""",
    ),
    "deleted": (
        (),
        "SELECT concat('a', vec_id, '_0') AS asset_id FROM embeddings WHERE vec_id % 9 = 0",
    ),
    "deletions": (
        (),
        """
        SELECT concat('b', CAST(floor(event_id / 3.0) AS BIGINT)) AS asset_id, 'photo' AS kind,
               CAST(floor(value * 1000000) AS BIGINT) AS file_size, ts AS deleted_at, event_id
        FROM events WHERE event_type = 'purchase'""",
    ),
    "bin": (
        ("deletions",),
        f"""
        SELECT asset_id, kind, file_size, deleted_at,
               CAST(greatest(0, floor((epoch_us(deleted_at) + 30 * 86400000000 - epoch_us({NOW})) / 86400000000.0)) AS INT) AS days_remaining
        FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY deleted_at, event_id) AS rn FROM deletions)
        WHERE rn = 1""",
    ),
    "dup_edges": (
        ("features", "tiers"),
        """
        SELECT a.asset_id AS a, b.asset_id AS b, list_distance(a.vec, b.vec) AS d
        FROM (SELECT * FROM features JOIN tiers USING (asset_id)) a
        JOIN (SELECT * FROM features JOIN tiers USING (asset_id)) b
          ON a.aspect_tier = b.aspect_tier AND a.megapixel_tier = b.megapixel_tier AND a.asset_id < b.asset_id
        WHERE bit_count(xor(a.dhash, b.dhash)) <= 4 AND list_distance(a.vec, b.vec) <= 0.05""",
    ),
    "sim_all": (
        ("features", "assets"),
        """
        SELECT a.asset_id AS a, b.asset_id AS b, greatest(-1.0, least(1.0, list_dot_product(a.vec, b.vec))) AS sim
        FROM (SELECT f.*, CAST(greatest(pixel_width, pixel_height) AS DOUBLE) / least(pixel_width, pixel_height) AS ratio
              FROM features f JOIN assets USING (asset_id)) a
        JOIN (SELECT f.*, CAST(greatest(pixel_width, pixel_height) AS DOUBLE) / least(pixel_width, pixel_height) AS ratio
              FROM features f JOIN assets USING (asset_id)) b
          ON a.asset_id < b.asset_id AND abs(a.ratio - b.ratio) <= 0.35
        WHERE list_dot_product(a.vec, b.vec) >= 0.86
          AND NOT (list_dot_product(a.vec, b.vec) >= 0.985 AND bit_count(xor(a.dhash, b.dhash)) <= 4)""",
    ),
    "sim_edges": (
        ("sim_all", "dup_groups"),
        "SELECT * FROM sim_all WHERE a NOT IN (SELECT asset_id FROM dup_groups) AND b NOT IN (SELECT asset_id FROM dup_groups)",
    ),
    "profiles": (
        ("assets",),
        """
        SELECT asset_id, duration, CASE WHEN pixel_width > 0 AND pixel_height > 0
               THEN CAST(greatest(pixel_width, pixel_height) AS DOUBLE) / least(pixel_width, pixel_height) ELSE 1.0 END AS aspect
        FROM assets WHERE kind = 'video'""",
    ),
    "range_edges": (
        ("profiles",),
        """
        SELECT x.asset_id AS a, y.asset_id AS b FROM profiles x JOIN profiles y
          ON x.asset_id < y.asset_id AND abs(x.aspect - y.aspect) <= 0.25
         AND abs(x.duration - y.duration) <= greatest(1.0, least(x.duration, y.duration) * 0.03)""",
    ),
    "frames": (
        (),
        """
        SELECT asset_id, list(vec ORDER BY frame_idx) AS frames FROM (
            SELECT asset_id, frame_idx, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vec FROM (
                SELECT concat('a', e.vec_id, '_', c.copy) AS asset_id, f.frame_idx,
                       list_transform(e.embedding, lambda x, i: CAST(e.embedding[1 + (i - 1 - f.frame_idx + len(e.embedding)) % len(e.embedding)] AS DOUBLE)
                           + c.noise * CAST((((i - 1) * 7 + e.vec_id * 3 + f.frame_idx) % 5) - 2 AS DOUBLE)) AS v
                FROM embeddings e
                CROSS JOIN (VALUES (0, 0.0::DOUBLE), (1, 0.002::DOUBLE), (2, 0.03::DOUBLE), (3, 0.02::DOUBLE), (4, 0.01::DOUBLE)) AS c(copy, noise)
                CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS f(frame_idx)
                WHERE e.vec_id % 5 = 0 AND NOT (f.frame_idx = 2 AND c.copy = 1 AND e.vec_id % 35 = 0))
            WHERE list_dot_product(v, v) > 0)
        GROUP BY asset_id""",
    ),
    "video_edges": (
        ("frames", "range_comp"),
        """
        SELECT a, b, list_sum(d) / len(d) AS d FROM (
            SELECT x.asset_id AS a, y.asset_id AS b,
                   list_transform(range(1, least(len(x.frames), len(y.frames)) + 1), lambda k: list_distance(x.frames[k], y.frames[k])) AS d
            FROM (SELECT * FROM frames JOIN range_comp ON node = asset_id) x
            JOIN (SELECT * FROM frames JOIN range_comp ON node = asset_id) y ON x.comp = y.comp AND x.asset_id < y.asset_id
            WHERE least(len(x.frames), len(y.frames)) >= 4)
        WHERE list_max(d) <= 0.22 AND list_sum(d) / len(d) <= 0.16""",
    ),
    "copy_pairs": (
        ("features",),
        """
        SELECT f.asset_id, f.dhash, o.dhash AS dhash_a, f.vec, o.vec AS vec_a
        FROM features f JOIN features o ON o.vec_id = f.vec_id AND o.copy = 0 WHERE f.copy > 0""",
    ),
    "stored_photos": (
        ("features", "assets"),
        """
        SELECT f.asset_id, a.vec_id % 10 = 1 AS is_stale,
               CASE WHEN a.vec_id % 10 = 2 THEN 'failed' ELSE 'ready' END AS status,
               CASE WHEN a.vec_id % 10 = 3 THEN NULL ELSE f.dhash END AS dhash,
               CASE WHEN a.vec_id % 10 = 4 THEN NULL ELSE len(f.vec) END AS dims,
               CASE WHEN a.vec_id % 10 = 6 THEN 0 ELSE 1 END AS schema_version,
               CASE WHEN a.vec_id % 10 = 1 THEN a.modification_date + INTERVAL 1 DAY ELSE a.modification_date END AS modification_date
        FROM features f JOIN assets a USING (asset_id) WHERE a.copy <> 3""",
    ),
    "stored_videos": (
        ("frames",),
        """
        SELECT asset_id, CASE WHEN CAST(split_part(substr(asset_id, 2), '_', 1) AS BIGINT) % 3 = 1 THEN 3 ELSE len(frames) END AS n_frames
        FROM frames WHERE asset_id NOT LIKE '%\\_3' ESCAPE '\\'""",
    ),
    "cache_state": (
        ("assets", "stored_photos", "stored_videos"),
        """
        SELECT a.asset_id, a.kind,
               coalesce(s.schema_version = 1 AND s.status = 'ready' AND NOT s.is_stale, FALSE) AS is_fresh,
               s.dhash IS NOT NULL AS has_hash, s.dims IS NOT NULL AS has_vector, coalesce(v.n_frames >= 4, FALSE) AS has_frames
        FROM assets a LEFT JOIN stored_photos s USING (asset_id) LEFT JOIN stored_videos v USING (asset_id)""",
    ),
    "images": (
        ("raw",),
        """
        SELECT asset_id, g, list_transform(g, lambda x: x - list_sum(g) / 72) AS centred
        FROM (SELECT asset_id, list_transform(list_concat(v, v[1:8]), lambda x: floor((least(greatest(x, -1.0), 1.0) + 1) * 127.5)) AS g FROM raw)""",
    ),
}


def _component(name: str, edges: str) -> None:
    """<name>_sym, <name>_reach, <name>_comp(node, comp): recursive reachability over an edge table."""
    _CTES[f"{name}_sym"] = ((edges,), f"SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}")
    _CTES[f"{name}_reach"] = (
        (f"{name}_sym",),
        f"SELECT a AS n, a AS c FROM {name}_sym UNION SELECT s.b, r.c FROM {name}_reach r JOIN {name}_sym s ON r.n = s.a",
    )
    _CTES[f"{name}_comp"] = ((f"{name}_reach",), f"SELECT n AS node, min(c) AS comp FROM {name}_reach GROUP BY n")


def _groups(name: str, order: str) -> None:
    _CTES[f"{name}_groups"] = (
        (f"{name}_comp", "sized"),
        f"""
        SELECT first_value(asset_id) OVER (PARTITION BY comp ORDER BY {order}) AS group_id,
               CAST(row_number() OVER (PARTITION BY comp ORDER BY {order}) AS INT) AS member_rank,
               asset_id, file_size, pixels, comp,
               CAST(coalesce(sum(file_size) OVER (PARTITION BY comp), 0) AS BIGINT) AS total_storage
        FROM {name}_comp JOIN sized ON asset_id = node""",
    )


_BY_SIZE = "coalesce(file_size, 0) DESC, pixels DESC, asset_id"
_BY_PIXELS = "pixels DESC, coalesce(file_size, 0) DESC, asset_id"
_component("dup", "dup_edges")
_component("sim", "sim_edges")
_component("range", "range_edges")
_component("video", "video_edges")
_groups("dup", _BY_SIZE)
_groups("sim", _BY_PIXELS)
_groups("video", _BY_PIXELS)
_CTES["sim_means"] = (
    ("sim_edges", "sim_comp"),
    "SELECT comp, avg(sim) AS average_similarity FROM sim_edges JOIN sim_comp ON node = a GROUP BY comp",
)
_CTES["analyses"] = (
    ("dup_groups", "sim_groups", "video_groups"),
    " UNION ALL ".join(
        f"""SELECT '{category}' AS category, count(*) FILTER (member_rank = 1) AS group_count, count(*) AS member_count,
               count(*) FILTER (member_rank > 1) AS deletable_copies,
               CAST(coalesce(sum(file_size) FILTER (member_rank > 1), 0) AS BIGINT) AS reclaimable_bytes FROM {name}_groups"""
        for category, name in (("duplicatePhotos", "dup"), ("similarPhotos", "sim"), ("duplicateVideos", "video"))
    ),
)


def _sql(select: str, *names: str) -> str:
    """``select`` behind the table expressions it needs."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in _CTES[name][0]:
            visit(other)
        needed.append(name)

    for name in names:
        visit(name)
    # a recursive expression cannot be materialised by hint
    parts = [
        f"{n} AS {'' if n.endswith('_reach') else 'MATERIALIZED '}({_CTES[n][1]})"
        for n in needed
    ]
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select


_SIGNATURE_TEXT = """concat_ws('|', asset_id, kind, coalesce(CAST(epoch_us(modification_date) AS VARCHAR), '-1'),
    coalesce(CAST(epoch_us(creation_date) AS VARCHAR), '-1'), CAST(pixel_width AS VARCHAR), CAST(pixel_height AS VARCHAR),
    CAST(CAST(duration AS DECIMAL(18,6)) AS VARCHAR), coalesce(CAST(file_size AS VARCHAR), '-1'), '', '')"""


def _digest(text: str) -> str:
    return f"coalesce(CAST(sum(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)) AS VARCHAR), '0')"


def _filters(rows: str, size: str, filters: dict[str, str], columns: str = "asset_id") -> str:
    return " UNION ALL ".join(
        f"SELECT {columns}, '{name}' AS size_filter FROM {rows} WHERE {test.format(mb=f'({size} / 1048576.0)')}"
        for name, test in filters.items()
    )


_VIDEO_FILTERS = {
    "all": "TRUE", "under100MB": "{mb} < 100", "under500MB": "{mb} < 500", "under1GB": "{mb} < 1024", "over1GB": "{mb} >= 1024",
}
_LARGE_FILTERS = {
    "all": "TRUE", "min100MB": "{mb} >= 100", "min500MB": "{mb} >= 500", "min1GB": "{mb} >= 1024", "min2GB": "{mb} >= 2048",
}
_GROUP_FILTERS = {
    "all": "TRUE", "under100MB": "{mb} < 100", "between100And500MB": "{mb} >= 100 AND {mb} < 500",
    "min500MB": "{mb} >= 500", "min1GB": "{mb} >= 1024",
}


def _match_statistics(edges: str, score: str, best: str, best_name: str, mean_name: str) -> str:
    return f"""
        SELECT asset_id, count(*) AS matches, round({best}(s), 6) AS {best_name}, round(avg(s), 6) AS {mean_name}
        FROM (SELECT a AS asset_id, {score} AS s FROM {edges} UNION ALL SELECT b, {score} FROM {edges}) GROUP BY asset_id"""


_ORDINALS = "(VALUES ('screenshots', 0), ('videos', 1), ('duplicatePhotos', 2), ('duplicateVideos', 3), ('similarPhotos', 4), ('largeVideos', 5), ('bin', 6)) AS o(category, ordinal)"

_INDEX_COUNTS = """
    SELECT 'screenshots' AS category, count(*) FILTER (is_screenshot) AS n FROM assets
    UNION ALL SELECT 'videos', count(*) FILTER (kind = 'video') FROM assets
    UNION ALL SELECT 'largeVideos', count(*) FILTER (kind = 'video') FROM assets"""


def _bytes_text(size: str) -> str:
    def scaled(unit: int, digits: int) -> str:
        step = unit // 10**digits
        n = f"(({size} + {step // 2}) // {step})"
        if digits == 0:
            return f"CAST({n} AS VARCHAR)"
        base = 10**digits
        return f"concat({n} // {base}, '.', lpad(CAST({n} % {base} AS VARCHAR), {digits}, '0'))"

    return f"""CASE WHEN NOT ({size} > 0) OR {size} IS NULL THEN NULL
        WHEN {size} < 1000 THEN concat({size}, ' B')
        WHEN {size} < 1000000 THEN concat({scaled(1000, 0)}, ' KB')
        WHEN {size} < 1000000000 THEN concat({scaled(1000000, 1)}, ' MB')
        WHEN {size} < 1000000000000 THEN concat({scaled(1000000000, 2)}, ' GB')
        ELSE concat({scaled(1000000000000, 2)}, ' TB') END"""


def _resolution(separator: str) -> str:
    return f"""CASE WHEN NOT (pixel_width > 0 AND pixel_height > 0) THEN ''
        WHEN greatest(pixel_width, pixel_height) >= 3840 AND least(pixel_width, pixel_height) >= 2160 THEN '4K'
        WHEN greatest(pixel_width, pixel_height) >= 1920 AND least(pixel_width, pixel_height) >= 1080 THEN '1080p'
        WHEN greatest(pixel_width, pixel_height) >= 1280 AND least(pixel_width, pixel_height) >= 720 THEN '720p'
        ELSE concat(pixel_width, '{separator}', pixel_height) END"""


def _code_pick(index: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


ORACLE: dict[str, str] = {
    # sources and sinks
    "scan_assets": _sql(
        """SELECT asset_id, concat('/library/', asset_id, '.png') AS path, 'photo' AS kind, 18 AS pixel_width, 16 AS pixel_height,
                  'userLibrary' AS source FROM raw""",
        "raw",
    ),
    "explode_resources": _sql(
        "SELECT asset_id, idx, concat(asset_id, '#', idx) AS resource_id, kind, uti, filename, CAST(file_size AS BIGINT) AS file_size FROM resources",
        "resources",
    ),
    "index_records": _sql(
        f"""SELECT asset_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS resource_types,
                   coalesce(string_agg(DISTINCT uti, ',' ORDER BY uti), '') AS uniform_type_identifiers,
                   string_agg(DISTINCT filename, ',' ORDER BY filename) AS original_filenames,
                   CAST(max(file_size) AS BIGINT) AS file_size, 'metadataIndexed' AS processing_state, {NOW} AS indexed_at
            FROM resources GROUP BY asset_id""",
        "resources",
    ),
    "build_index": _sql(
        f"""SELECT asset_id, a.kind, pixel_width, pixel_height, duration, is_screenshot, r.resource_types, r.file_size, creation_date, {NOW} AS indexed_at
            FROM assets a JOIN (SELECT asset_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS resource_types, CAST(max(file_size) AS BIGINT) AS file_size
                                FROM resources GROUP BY asset_id) r USING (asset_id)""",
        "assets",
        "resources",
    ),
    "load_index": _sql(
        f"""SELECT asset_id, kind, n % 3 = 0 OR n % 4 = 0 AS no_location, CASE WHEN n % 3 <> 0 AND n % 4 <> 0 THEN n % 90 + 0.5::DOUBLE END AS latitude,
                   CASE WHEN n % 3 <> 0 AND n % 4 <> 0 THEN n % 180 - 90.25::DOUBLE END AS longitude, file_size, {NOW} AS indexed_at
            FROM (SELECT *, vec_id * 5 + copy AS n FROM assets)""",
        "assets",
    ),
    "fingerprint_upsert": _sql(
        """SELECT s.asset_id, CASE WHEN m.asset_id IS NULL THEN s.status ELSE 'ready' END AS status,
                  CASE WHEN m.asset_id IS NULL THEN s.dhash ELSE f.dhash END AS dhash,
                  CAST(CASE WHEN m.asset_id IS NULL THEN s.dims ELSE 64 END AS INT) AS dims,
                  CASE WHEN m.asset_id IS NULL THEN s.schema_version ELSE 1 END AS schema_version,
                  CASE WHEN m.asset_id IS NULL THEN s.modification_date ELSE a.modification_date END AS modification_date
           FROM stored_photos s JOIN features f USING (asset_id) JOIN assets a USING (asset_id)
           LEFT JOIN (SELECT asset_id FROM cache_state WHERE kind = 'photo' AND NOT (is_fresh AND has_hash AND has_vector)) m USING (asset_id)
           UNION ALL
           SELECT f.asset_id, 'ready', f.dhash, 64, 1, a.modification_date
           FROM features f JOIN assets a USING (asset_id) WHERE f.copy = 3""",
        "cache_state",
    ),
    "fingerprint_prune": _sql(
        "SELECT asset_id, status, schema_version FROM stored_photos WHERE asset_id NOT IN (SELECT asset_id FROM deleted)",
        "stored_photos",
        "deleted",
    ),
    "bin_add": _sql(
        f"""SELECT asset_id, kind, CAST(coalesce(file_size, 0) AS BIGINT) AS file_size, {NOW} AS deleted_at
            FROM assets WHERE asset_id IN (SELECT asset_id FROM deleted)
            UNION ALL SELECT asset_id, kind, file_size, deleted_at FROM bin""",
        "assets",
        "deleted",
        "bin",
    ),
    "bin_remove": _sql("SELECT asset_id, kind, file_size, deleted_at FROM bin WHERE NOT file_size < 100000000", "bin"),
    "bin_purge": _sql("SELECT asset_id, kind, file_size, deleted_at FROM bin WHERE days_remaining >= 1", "bin"),
    "delete_assets": _sql(
        "SELECT asset_id, kind, file_size FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM deleted)", "assets", "deleted"
    ),
    "assets_exist": _sql(
        """SELECT DISTINCT asset_id FROM (SELECT asset_id FROM deleted UNION ALL SELECT asset_id FROM deletions)
           WHERE asset_id IN (SELECT asset_id FROM assets)""",
        "assets",
        "deleted",
        "deletions",
    ),
    # projections
    "aspect_ratio": _sql(
        """SELECT asset_id, round(CAST(greatest(pixel_width, pixel_height, 1) AS DOUBLE) / greatest(least(pixel_width, pixel_height), 1), 6) AS photo_ratio,
                  round(CASE WHEN pixel_width > 0 AND pixel_height > 0
                        THEN CAST(greatest(pixel_width, pixel_height) AS DOUBLE) / least(pixel_width, pixel_height) ELSE 1.0 END, 6) AS video_ratio
           FROM assets""",
        "assets",
    ),
    "photo_tiers": _sql("SELECT asset_id, aspect_tier, megapixel_tier FROM tiers", "tiers"),
    "format_duration": _sql(
        """SELECT asset_id, CASE WHEN duration <= 0 THEN '00:00'
                  WHEN s // 3600 > 0 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
                  ELSE printf('%02d:%02d', s % 3600 // 60, s % 60) END AS duration_text
           FROM (SELECT asset_id, duration, CAST(round(duration) AS BIGINT) AS s FROM assets)""",
        "assets",
    ),
    "total_duration": _sql(
        """SELECT CASE WHEN s // 3600 > 0 THEN printf('%dh %dm', s // 3600, s % 3600 // 60)
                       WHEN s % 3600 // 60 > 0 THEN printf('%dm %ds', s % 3600 // 60, s % 60) ELSE printf('%ds', s % 60) END AS total_text
           FROM (SELECT CAST(round(sum(duration)) AS BIGINT) AS s FROM assets WHERE kind = 'video')""",
        "assets",
    ),
    "format_bytes": _sql(f"SELECT asset_id, {_bytes_text('file_size')} AS size_text FROM assets", "assets"),
    "resolution_label": _sql(
        f"SELECT asset_id, {_resolution(' × ')} AS label, {_resolution('×')} AS compact_label FROM assets", "assets"
    ),
    "resource_file_size": _sql("SELECT asset_id, looked_up_size FROM lookup", "lookup"),
    "resolve_size": _sql("SELECT asset_id, file_size FROM sized", "sized"),
    "size_estimate": _sql(
        """SELECT asset_id, greatest(500000, CAST(floor(duration * 2500000) AS BIGINT)) AS estimated_size
           FROM assets WHERE kind = 'video'""",
        "assets",
    ),
    "normalize_enums": f"""
        SELECT asset_id, CASE n % 4 WHEN 1 THEN 'photo' WHEN 2 THEN 'video' ELSE 'unknown' END AS kind,
               CASE WHEN n % 8 & 1 <> 0 THEN 'userLibrary' WHEN n % 8 & 2 <> 0 THEN 'cloudShared' WHEN n % 8 & 4 <> 0 THEN 'iTunesSynced' ELSE 'unknown' END AS source,
               {_code_pick('n % 5', ('photo', 'pairedVideo', 'alternatePhoto', 'unknown', 'photoProxy'))} AS resource_kind,
               {_code_pick('n % 3', ('metadataIndexed', 'unavailable', 'failed'))} AS processing_state,
               {_code_pick('n % 4', ('photo', 'video', 'unknown', 'unknown'))} AS bin_kind
        FROM (SELECT concat('a', e.vec_id, '_', c.copy) AS asset_id, e.vec_id * 5 + c.copy AS n
              FROM embeddings e CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS c(copy))""",
    "hamming_pairs": _sql(
        "SELECT asset_id, CAST(bit_count(xor(dhash_a, dhash)) AS INT) AS hamming FROM copy_pairs", "copy_pairs"
    ),
    "cosine_pairs": _sql(
        "SELECT asset_id, round(greatest(-1.0, least(1.0, list_dot_product(vec_a, vec))), 6) AS cosine FROM copy_pairs", "copy_pairs"
    ),
    "feature_distance": _sql(
        "SELECT asset_id, round(list_distance(vec_a, vec), 6) AS distance FROM copy_pairs", "copy_pairs"
    ),
    "classify_pairs": _sql(
        """SELECT asset_id, CASE WHEN d <= 0.05 AND h <= 4 THEN 'duplicate' WHEN d <= 0.22 AND h <= 16 THEN 'similar' ELSE 'distinct' END AS match
           FROM (SELECT asset_id, list_distance(vec_a, vec) AS d, bit_count(xor(dhash_a, dhash)) AS h FROM copy_pairs)""",
        "copy_pairs",
    ),
    "asset_signature": _sql(f"SELECT asset_id, sha256({_SIGNATURE_TEXT}) AS signature FROM assets", "assets"),
    "bin_days_remaining": _sql("SELECT asset_id, days_remaining, days_remaining = 0 AS is_expired FROM bin", "bin"),
    "dhash": _sql("SELECT asset_id, dhash FROM hashes", "hashes"),
    "normalize_vectors": _sql(
        """SELECT asset_id, CAST(i - 1 AS INT) AS dim, round(vec[i], 6) AS x
           FROM (SELECT asset_id, vec, unnest(range(1, len(vec) + 1)) AS i FROM unit)""",
        "unit",
    ),
    "top15_share": _sql(
        """SELECT round(CAST(sum(file_size) FILTER (is_top) AS DOUBLE) / CAST(greatest(sum(file_size), 1) AS DOUBLE) * 100, 6) AS top_percent FROM ranked""",
        "ranked",
    ),
    # filters
    "videos_by_date": _sql("SELECT asset_id, creation_date FROM assets WHERE kind = 'video'", "assets"),
    "screenshots_by_date": _sql("SELECT asset_id, creation_date FROM assets WHERE is_screenshot", "assets"),
    "video_size_filter": _sql(
        _filters("(SELECT * FROM assets WHERE kind = 'video')", "file_size", _VIDEO_FILTERS), "assets"
    ),
    "large_size_filter": _sql(
        _filters("ranked", "file_size", _LARGE_FILTERS, "asset_id, 'all' AS mode")
        + " UNION ALL "
        + _filters("(SELECT * FROM ranked WHERE is_top)", "file_size", _LARGE_FILTERS, "asset_id, 'top15' AS mode"),
        "ranked",
    ),
    "dup_video_group_filter": _sql(
        _filters(
            "(SELECT group_id, CAST(coalesce(max(file_size), 0) AS BIGINT) AS largest_member FROM video_groups GROUP BY group_id)",
            "largest_member",
            _GROUP_FILTERS,
            "group_id, largest_member",
        ),
        "video_groups",
    ),
    "exclude_ids": _sql(
        "SELECT asset_id FROM assets WHERE kind = 'photo' AND asset_id NOT IN (SELECT node FROM dup_comp)", "assets", "dup_comp"
    ),
    "bin_active": _sql(
        "SELECT asset_id, file_size, deleted_at, days_remaining, days_remaining <= 3 AS is_urgent FROM bin WHERE days_remaining >= 1", "bin"
    ),
    "needs_analysis": _sql(
        """SELECT v.variant, asset_id FROM cache_state CROSS JOIN (VALUES ('duplicate'), ('similar')) AS v(variant)
           WHERE kind = 'photo' AND NOT (is_fresh AND has_hash AND has_vector)
           UNION ALL SELECT 'video', asset_id FROM cache_state WHERE kind = 'video' AND NOT has_frames""",
        "cache_state",
    ),
    "stored_needs_analysis": _sql(
        """SELECT v.variant, asset_id FROM cache_state CROSS JOIN (VALUES ('duplicate'), ('similar')) AS v(variant)
           WHERE kind = 'photo' AND NOT (is_fresh AND has_hash AND has_vector)
           UNION ALL SELECT 'video', asset_id FROM cache_state WHERE kind = 'video' AND NOT has_frames""",
        "cache_state",
    ),
    "cache_hits": _sql(
        """SELECT 'duplicate' AS variant, asset_id FROM cache_state WHERE kind = 'photo' AND is_fresh AND has_hash AND has_vector
           UNION ALL SELECT 'similar', asset_id FROM cache_state WHERE kind = 'photo' AND is_fresh AND has_vector
           UNION ALL SELECT 'video', asset_id FROM cache_state WHERE kind = 'video' AND has_frames""",
        "cache_state",
    ),
    "bucket_candidates": _sql(
        """SELECT aspect_tier, megapixel_tier, count(*) AS photos, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS comparisons
           FROM tiers GROUP BY ALL HAVING count(*) >= 2""",
        "tiers",
    ),
    # joins
    "photo_candidate_pairs": _sql(
        """SELECT aspect_tier, megapixel_tier, dhash, photos, CAST(sum(m) AS BIGINT) AS near_photos, CAST(photos * sum(m) AS BIGINT) AS photo_pairs, min(h) AS nearest_hamming
           FROM (SELECT aspect_tier, megapixel_tier, a.dhash AS dhash, a.n AS photos, CASE WHEN a.dhash = b.dhash THEN b.n - 1 ELSE b.n END AS m,
                        CAST(bit_count(xor(a.dhash, b.dhash)) AS INT) AS h
                 FROM (SELECT aspect_tier, megapixel_tier, dhash, count(*) AS n FROM features JOIN tiers USING (asset_id) WHERE dhash IS NOT NULL GROUP BY ALL) a
                 JOIN (SELECT aspect_tier, megapixel_tier, dhash, count(*) AS n FROM features JOIN tiers USING (asset_id) WHERE dhash IS NOT NULL GROUP BY ALL) b
                 USING (aspect_tier, megapixel_tier)
                 WHERE bit_count(xor(a.dhash, b.dhash)) <= 4 AND (a.dhash <> b.dhash OR a.n >= 2))
           GROUP BY aspect_tier, megapixel_tier, dhash, photos""",
        "features",
        "tiers",
    ),
    "hamming_band_pairs": _sql(
        """SELECT dhash, photos, CAST(sum(m) AS BIGINT) AS near_photos, CAST(photos * sum(m) AS BIGINT) AS photo_pairs, min(h) AS nearest_hamming
           FROM (SELECT a.dhash AS dhash, a.n AS photos, CASE WHEN a.dhash = b.dhash THEN b.n - 1 ELSE b.n END AS m, CAST(bit_count(xor(a.dhash, b.dhash)) AS INT) AS h
                 FROM (SELECT dhash, count(*) AS n FROM features WHERE dhash IS NOT NULL GROUP BY dhash) a
                 JOIN (SELECT dhash, count(*) AS n FROM features WHERE dhash IS NOT NULL GROUP BY dhash) b
                 ON bit_count(xor(a.dhash, b.dhash)) <= 4 AND (a.dhash <> b.dhash OR a.n >= 2))
           GROUP BY dhash, photos""",
        "features",
    ),
    "duplicate_photo_pairs": _sql(
        _match_statistics("dup_edges", "d", "min", "nearest_distance", "mean_distance"), "dup_edges"
    ),
    "similar_photo_pairs": _sql(
        _match_statistics("sim_all", "sim", "max", "best_similarity", "mean_similarity"), "sim_all"
    ),
    "video_candidate_pairs": _sql(
        """SELECT round(duration, 6) AS duration, round(aspect, 6) AS aspect, count(DISTINCT p.asset_id) AS videos,
                  CAST(count(e.other) / count(DISTINCT p.asset_id) AS BIGINT) AS partners
           FROM profiles p LEFT JOIN (SELECT a AS asset_id, b AS other FROM range_edges UNION ALL SELECT b, a FROM range_edges) e USING (asset_id)
           GROUP BY p.duration, p.aspect""",
        "profiles",
        "range_edges",
    ),
    "duplicate_video_pairs": _sql(
        _match_statistics("video_edges", "d", "min", "nearest_distance", "mean_distance"), "video_edges"
    ),
    "keyframe_sample": _sql(
        """SELECT asset_id, k AS sample_idx, frame_no, round(gap, 6) AS gap FROM (
               SELECT *, count(*) OVER (PARTITION BY asset_id) AS hits FROM (
                   SELECT asset_id, k, n AS frame_no, abs(n * (duration / 23.0) - p * duration) AS gap,
                          row_number() OVER (PARTITION BY asset_id, k ORDER BY abs(n * (duration / 23.0) - p * duration), n) AS rn
                   FROM assets CROSS JOIN (SELECT CAST(unnest(range(0, 24)) AS INT) AS n)
                   CROSS JOIN (VALUES (0, 0.1::DOUBLE), (1, 0.3::DOUBLE), (2, 0.5::DOUBLE), (3, 0.7::DOUBLE), (4, 0.9::DOUBLE)) AS f(k, p)
                   WHERE kind = 'video' AND duration > 0.3 AND abs(n * (duration / 23.0) - p * duration) <= 0.2)
               WHERE rn = 1) WHERE hits >= 3""",
        "assets",
    ),
    # components and groups
    "components": """
        WITH customers AS (SELECT o_custkey, min(concat('o', o_orderkey)) AS first_order FROM orders GROUP BY o_custkey)
        SELECT concat('a', e.vec_id, '_', c.copy) AS node, concat('a', e.vec_id, '_0') AS component
        FROM embeddings e CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS c(copy)
        UNION ALL SELECT concat('o', o_orderkey), concat('c', o_custkey) FROM orders
        UNION ALL SELECT concat('c', o_custkey), concat('c', o_custkey) FROM customers""",
    "video_components": _sql(
        """SELECT node AS asset_id, comp AS first_id, count(*) OVER (PARTITION BY comp) AS members FROM range_comp""", "range_comp"
    ),
    "duplicate_photo_groups": _sql(
        "SELECT group_id, member_rank, asset_id, file_size, pixels, total_storage FROM dup_groups", "dup_groups"
    ),
    "incremental_photo_groups": _sql(
        "SELECT group_id, member_rank, asset_id, file_size, pixels, total_storage FROM dup_groups", "dup_groups"
    ),
    "delta_photo_groups": _sql(
        "SELECT group_id, member_rank, asset_id, file_size, pixels, total_storage FROM dup_groups", "dup_groups"
    ),
    "similar_photo_groups": _sql(
        """SELECT group_id, member_rank, asset_id, file_size, pixels, total_storage, round(average_similarity, 6) AS average_similarity
           FROM sim_groups JOIN sim_means USING (comp)""",
        "sim_groups",
        "sim_means",
    ),
    "duplicate_video_groups": _sql(
        "SELECT group_id, member_rank, asset_id, file_size, pixels, total_storage FROM video_groups", "video_groups"
    ),
    "group_storage": _sql(
        """SELECT group_id, count(*) AS members, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_storage,
                  CAST(coalesce(max(file_size), 0) AS BIGINT) AS largest_member FROM dup_groups GROUP BY group_id""",
        "dup_groups",
    ),
    "best_copy": _sql("SELECT group_id, asset_id, file_size, pixels FROM dup_groups WHERE member_rank = 1", "dup_groups"),
    "deletion_candidates": _sql(
        "SELECT group_id, member_rank, asset_id, file_size FROM video_groups WHERE member_rank > 1", "video_groups"
    ),
    "groups_removing": _sql(
        """SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY member_rank) AS INT) AS member_rank, asset_id, file_size,
                  CAST(coalesce(sum(file_size) OVER (PARTITION BY group_id), 0) AS BIGINT) AS total_storage
           FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM dup_groups WHERE asset_id NOT IN (SELECT asset_id FROM deleted))
           WHERE n >= 2""",
        "dup_groups",
        "deleted",
    ),
    "group_similarity": _sql(
        """SELECT group_id, round(average_similarity, 6) AS average_similarity, round(average_similarity * 100, 4) AS percent
           FROM sim_groups JOIN sim_means USING (comp) WHERE member_rank = 1""",
        "sim_groups",
        "sim_means",
    ),
    # aggregates and reports
    "index_summary": _sql(
        """SELECT count(*) AS total, count(*) FILTER (kind = 'photo') AS photos, count(*) FILTER (kind = 'video') AS videos,
                  count(*) FILTER (is_screenshot) AS screenshots, CAST(0 AS BIGINT) AS failures FROM assets""",
        "assets",
    ),
    "latest_index": _sql(f"SELECT max({NOW}) AS latest_indexed_at FROM assets", "assets"),
    "dup_rollup": _sql(
        """SELECT category, group_count, member_count, deletable_copies, reclaimable_bytes,
                  CASE category WHEN 'duplicatePhotos' THEN (SELECT count(*) FROM assets WHERE kind = 'photo')
                                WHEN 'similarPhotos' THEN (SELECT count(*) FROM assets WHERE kind = 'photo') - (SELECT count(*) FROM dup_groups)
                                ELSE (SELECT count(*) FROM assets WHERE kind = 'video') END AS analyzed
           FROM analyses""",
        "analyses",
        "assets",
    ),
    "total_cleanable": _sql("SELECT CAST(sum(reclaimable_bytes) AS BIGINT) AS cleanable_bytes FROM analyses", "analyses"),
    "large_video_totals": _sql(
        """SELECT count(*) AS videos, count(*) FILTER (is_top) AS top_videos, CAST(sum(file_size) AS BIGINT) AS total_bytes,
                  CAST(sum(file_size) FILTER (is_top) AS BIGINT) AS top_bytes, CAST(sum(file_size) FILTER (NOT is_top) AS BIGINT) AS rest_bytes
           FROM ranked""",
        "ranked",
    ),
    "bin_totals": _sql(
        "SELECT count(*) AS active_items, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS active_bytes FROM bin WHERE days_remaining >= 1", "bin"
    ),
    "dashboard_snapshot": _sql(
        f"""SELECT o.ordinal, category, CASE WHEN n > 0 THEN 'available' ELSE 'empty' END AS state, CASE WHEN n > 0 THEN n END AS count
            FROM ({_INDEX_COUNTS} UNION ALL SELECT category, group_count FROM analyses
                  UNION ALL SELECT 'bin', count(*) FROM bin WHERE days_remaining >= 1) JOIN {_ORDINALS} USING (category)""",
        "assets",
        "analyses",
        "bin",
    ),
    "category_share": _sql(
        f"""SELECT category, n AS count, CASE WHEN n > 0 THEN round(greatest(n / CAST(greatest(sum(n) OVER (), 1) AS DOUBLE), 0.02), 6) END AS share
            FROM ({_INDEX_COUNTS} UNION ALL SELECT category, member_count FROM analyses)""",
        "assets",
        "analyses",
    ),
    "preview_top3": _sql(
        """SELECT category, asset_id, CAST(position AS INT) AS position FROM (
               SELECT 'screenshots' AS category, asset_id, row_number() OVER (ORDER BY creation_date DESC NULLS LAST, asset_id) AS position FROM assets WHERE is_screenshot
               UNION ALL SELECT 'videos', asset_id, row_number() OVER (ORDER BY creation_date DESC NULLS LAST, asset_id) FROM assets WHERE kind = 'video'
               UNION ALL SELECT 'duplicatePhotos', asset_id, row_number() OVER (ORDER BY total_storage DESC, group_id, member_rank) FROM dup_groups
               UNION ALL SELECT 'duplicateVideos', asset_id, row_number() OVER (ORDER BY total_storage DESC, group_id, member_rank) FROM video_groups
               UNION ALL SELECT 'similarPhotos', asset_id, row_number() OVER (ORDER BY total_storage DESC, group_id, member_rank) FROM sim_groups)
           WHERE position <= 3""",
        "assets",
        "dup_groups",
        "video_groups",
        "sim_groups",
    ),
    "analysis_key": _sql(
        f"""SELECT kind, 'records' AS part, count(*) AS rows, {_digest(_SIGNATURE_TEXT)} AS digest FROM assets GROUP BY kind
            UNION ALL SELECT 'photo', 'excluded', count(*), {_digest('asset_id')} FROM deleted""",
        "assets",
        "deleted",
    ),
    # ranking
    "video_rank": _sql("SELECT asset_id, file_size, rank FROM ranked", "ranked"),
    "large_videos_top15": _sql("SELECT asset_id, file_size, rank FROM ranked WHERE is_top", "ranked"),
    "large_videos_removing": _sql(
        """SELECT asset_id, file_size, row_number() OVER (ORDER BY file_size DESC, asset_id) AS rank,
                  row_number() OVER (ORDER BY file_size DESC, asset_id) <= ceil(count(*) OVER () * 0.15::DOUBLE) AS is_top
           FROM ranked WHERE asset_id NOT IN (SELECT asset_id FROM deleted)""",
        "ranked",
        "deleted",
    ),
    # streaming and featurizer
    "stream_index": _sql(
        """SELECT a.asset_id, a.kind, coalesce(c.change_ts, a.modification_date) AS modification_date
           FROM assets a LEFT JOIN (
               SELECT asset_id, op, change_ts FROM (
                   SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY change_ts DESC, event_id DESC) AS rn FROM (
                       SELECT concat('a', event_id * 7 % (SELECT count(*) FROM embeddings), '_0') AS asset_id, event_id, ts AS change_ts,
                              CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'modify' WHEN 'view' THEN 'modify' WHEN 'purchase' THEN 'delete' END AS op
                       FROM events) WHERE op IS NOT NULL) WHERE rn = 1) c ON c.asset_id = a.asset_id AND c.change_ts >= a.modification_date
           WHERE c.op IS NULL OR c.op <> 'delete'""",
        "assets",
    ),
    "stream_bin": _sql(
        "SELECT asset_id, file_size, deleted_at, days_remaining FROM bin WHERE days_remaining >= 1", "bin"
    ),
    "stream_fingerprints": _sql(
        """SELECT asset_id, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS dhash, 1::BIGINT AS stored
           FROM (SELECT asset_id, sqrt(list_dot_product(centred, centred)) AS norm,
                        list_reduce(list_transform(range(0, 64), lambda k: CASE WHEN g[k + k // 8 + 1] < g[k + k // 8 + 2] THEN 1::HUGEINT ELSE 0::HUGEINT END),
                                    lambda a, x: a * 2 + x) AS h
                 FROM images) JOIN assets USING (asset_id) WHERE norm > 0 AND kind = 'photo'""",
        "images",
        "assets",
    ),
    "featurize": _sql(
        """SELECT asset_id, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS dhash,
                  CAST(i - 1 AS INT) AS dim, round(centred[i] / norm, 6) AS x
           FROM (SELECT asset_id, centred, sqrt(list_dot_product(centred, centred)) AS norm, unnest(range(1, 73)) AS i,
                        list_reduce(list_transform(range(0, 64), lambda k: CASE WHEN g[k + k // 8 + 1] < g[k + k // 8 + 2] THEN 1::HUGEINT ELSE 0::HUGEINT END),
                                    lambda a, x: a * 2 + x) AS h
                 FROM images) WHERE norm > 0""",
        "images",
    ),
}
