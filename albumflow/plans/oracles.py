"""DuckDB SQL of every query of the catalogue, written apart from its Spark code."""

from __future__ import annotations

_EXT = "['.jpg','.JPEG','.png','.tif','.tiff','.webp','.mp4','.MOV','.m4v','.heic','.HEIF','.txt','.gif','.bin']"
_MEDIA_EXT = "('.jpg','.jpeg','.png','.tif','.tiff','.webp','.heic','.heif','.mp4','.mov','.m4v')"
_VIDEO_EXT = "('.mp4','.mov','.m4v')"

_VIEWS = f"""
media AS (
  SELECT *, dir || '/' || name AS path FROM (
    SELECT *, stem || ext AS name FROM (
      SELECT event_id, ts, 'album_' || (user_id % 20) AS dir, 'IMG_' || event_id AS stem, {_EXT}[event_id % 14 + 1] AS ext,
        CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '1904:01:01 00:00:00' WHEN event_id % 13 = 0 THEN 'n/a'
             ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') END AS meta
      FROM events))),
sidecar AS (
  SELECT event_id, dir, name || '.supplemental-metadata.json' AS json_name, name || '.supplemental-metadata' AS json_stem,
    CASE WHEN event_id % 21 = 0 THEN '{{broken'
         ELSE '{{"' || CASE WHEN event_id % 15 = 0 THEN 'creationTime' ELSE 'photoTakenTime' END || '": {{"timestamp": "' || floor(epoch(ts))::BIGINT || '"}}}}' END AS body
  FROM media WHERE event_id % 3 = 0),
seconds AS (
  SELECT *, coalesce(try_cast(json_extract_string(j, '$.photoTakenTime.timestamp') AS BIGINT), try_cast(json_extract_string(j, '$.creationTime.timestamp') AS BIGINT)) AS n
  FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM sidecar)),
parsed AS (SELECT *, try_strptime(meta, '%Y:%m:%d %H:%M:%S') AS dto FROM media),
flagged AS (SELECT *, dto IS NULL OR year(dto) < 1900 OR year(dto) = 1904 AS bad FROM parsed),
matches AS (
  SELECT m.path, s.json_name, s.n,
    CASE WHEN starts_with(lower(s.json_stem), lower(m.name)) THEN 1 WHEN lower(s.json_stem) = lower(m.stem) THEN 2 ELSE 3 END AS rule
  FROM media m JOIN seconds s ON m.dir = s.dir AND starts_with(lower(s.json_stem), lower(m.stem[1:25]))),
ranked AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY path ORDER BY rule, lower(json_name)) = 1),
listed AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY path ORDER BY lower(json_name)) = 1),
resolved AS (
  SELECT f.*, CASE WHEN bad THEN coalesce(make_timestamp(r.n * 1000000), dto) ELSE dto END AS capture_ts,
    CASE WHEN bad AND r.n IS NOT NULL THEN 'sidecar' WHEN dto IS NOT NULL THEN 'embedded' END AS date_source
  FROM flagged f LEFT JOIN ranked r USING (path)),
final AS (SELECT *, capture_ts IS NULL OR year(capture_ts) < 1900 OR year(capture_ts) = 1904 AS no_date FROM resolved),
routed AS (
  SELECT *, CASE WHEN no_date THEN 'NO_DATE' WHEN lower(ext) IN {_VIDEO_EXT} THEN 'videos' ELSE 'photos' END AS kind,
    CASE WHEN NOT no_date THEN strftime(capture_ts, '%Y') END AS year, CASE WHEN NOT no_date THEN strftime(capture_ts, '%Y-%m-%d') END AS bucket
  FROM final WHERE lower(ext) IN {_MEDIA_EXT}),
fast AS (
  SELECT *, CASE WHEN dto IS NULL THEN 'NO_DATE' WHEN lower(ext) IN {_VIDEO_EXT} THEN 'videos' ELSE 'photos' END AS kind,
    strftime(dto, '%Y') AS year, strftime(dto, '%Y-%m-%d') AS bucket
  FROM parsed WHERE lower(ext) IN {_MEDIA_EXT}),
lines AS (SELECT path, name, kind, CASE WHEN no_date THEN 'NO DATE → ' || name ELSE name || ' → ' || kind || '\\' || year || '\\' || bucket END AS message FROM routed),
contested AS (
  SELECT path, CASE WHEN no_date THEN 'out/NO_DATE/' || name
      ELSE 'out/' || CASE WHEN lower(ext) IN {_VIDEO_EXT} THEN 'videos' ELSE 'photos' END || '/' || strftime(ts, '%Y') || '/' || strftime(ts, '%Y-%m-%d') || '/' || name END AS target_path
  FROM (SELECT dir || '/' || event_id || '/IMG_' || (event_id % 500) || lower(ext) AS path, 'IMG_' || (event_id % 500) || lower(ext) AS name, ext, ts, event_id % 11 = 0 AS no_date FROM media)),
fix AS (SELECT user_id AS device, ts AS t, value FROM events WHERE event_id % 2 = 0),
point AS (SELECT user_id AS device, ts AS t, event_id FROM events WHERE event_id % 2 = 1),
bracket AS (
  SELECT p.event_id, p.t, a.t AS t0, a.value AS v0, b.t AS t1, b.value AS v1
  FROM point p ASOF LEFT JOIN fix a ON p.device = a.device AND p.t >= a.t
  ASOF LEFT JOIN fix b ON p.device = b.device AND p.t < b.t),
sections AS (SELECT *, strftime(ts, '%Y-%m-%d') AS h, row_number() OVER o AS n, strftime(ts, '%Y-%m-%d') IS DISTINCT FROM lag(strftime(ts, '%Y-%m-%d')) OVER o AS opens FROM media WINDOW o AS (PARTITION BY dir ORDER BY event_id)),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY dir ORDER BY n) AS section FROM sections),
outputs AS (SELECT path, event_id, dir || '/' || strftime(ts, '%Y-%m-%d') || '.txt' AS output FROM media),
tags AS (
  SELECT user_id AS source_file, ['CreateDate','ModifyDate','DateTimeOriginal','GPSImgDir2Ab','Model'][event_id % 5 + 1] AS tag, ['Create Date','Modify Date','Date Time Original','GPS Img Dir 2 Ab','Model'][event_id % 5 + 1] AS label,
    ['EXIF','XMP','IPTC'][event_id % 3 + 1] AS group0, event_id AS file_order, trunc(value)::INTEGER::VARCHAR AS raw, CASE WHEN event_id % 2 = 0 THEN event_id || ' mm' END AS printed, event_id::VARCHAR AS value FROM events),
checked AS (SELECT *, event_id % 3 AS n FROM media),
cust AS (SELECT c_custkey, c_custkey * 37 % 1700 / 10.0 - 85 AS lat, c_custkey * 91 % 3600 / 10.0 - 180 AS lon FROM customer),
supp AS (SELECT s_suppkey, s_suppkey * 37 % 1700 / 10.0 - 85 AS lat2, s_suppkey * 91 % 3600 / 10.0 - 180 AS lon2 FROM supplier),
camera AS (
  SELECT p_partkey, (p_size % 20 + 1.4)::DOUBLE AS f, 1.0::DOUBLE / (p_partkey % 500 + 1) AS t, (p_size % 7 * 100.0)::DOUBLE AS iso,
    (p_size + 10.0)::DOUBLE AS focal, (p_partkey % 40 + 1.0)::DOUBLE AS d, sqrt(24*24+36*36) / (1.5 * 1440) AS coc
  FROM part)
"""

_KM = """2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"""
_PLACE = _KM.format(a="lat", b="lon", c="lat2", d="lon2")
_PAIR = _KM.format(a="a", b="b", c="c", d="d")


def _shift(months: str, days: str) -> str:
    total = f"(year(o_orderdate) * 12 + month(o_orderdate) - 1 + ({months}))"
    start = f"make_timestamp({total} // 12, {total} % 12 + 1, 1, hour(o_orderdate), minute(o_orderdate), second(o_orderdate)::DOUBLE)"
    return f"({start} + to_days((day(o_orderdate) - 1)::INTEGER) {days})"


SQL = {
    "ext_filter": f"SELECT path, ext FROM media WHERE lower(ext) IN {_MEDIA_EXT}",
    "ext_include_exclude": "SELECT path, lower(ext) NOT IN ('.gif', '.bin') AS accepted FROM media",
    "classify_kind": f"SELECT path, CASE WHEN lower(ext) IN {_VIDEO_EXT} THEN 'videos' ELSE 'photos' END AS kind FROM media",
    "classify_heic": f"SELECT path, lower(ext) IN {_VIDEO_EXT} AS is_video, lower(ext) IN ('.heic', '.heif') AS is_heic FROM media",
    "path_parts": r"""
        SELECT path, regexp_extract(path, '^(.*)[/\\][^/\\]*$', 1) AS dir, name, regexp_replace(name, '\.[^.]*$', '') AS stem, regexp_extract(name, '(\.[^.]+)$', 1) AS ext
        FROM (SELECT path, regexp_extract(path, '([^/\\]*)$', 1) AS name FROM (SELECT path FROM media UNION ALL SELECT url FROM pages))""",
    "file_template": "SELECT path, dir || '/' || stem[1:3] || '_' || stem || '.' || ext[2:] AS target FROM media",
    "strict_date_parse": "SELECT path, dto AS capture_ts FROM parsed",
    "invalid_date_flag": "SELECT path, bad AS invalid FROM flagged",
    "date_coalesce": """
        SELECT path, CASE WHEN event_id % 2 = 0 THEN ts WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY WHEN event_id % 5 = 0 THEN ts + INTERVAL 2 DAY END AS capture_ts FROM media""",
    "sidecar_json_extract": "SELECT json_name, coalesce(n, -1) AS seconds FROM seconds",
    "json_number": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "epoch_to_ts_guarded": """
        SELECT json_name, CASE WHEN m BETWEEN -62135596800 AND 253402300799 THEN make_timestamp(m * 1000000) END AS ts
        FROM (SELECT json_name, n * CASE WHEN event_id % 4 = 0 THEN 1000 ELSE 1 END AS m FROM seconds)""",
    "quicktime_dates": "SELECT path, date_trunc('second', ts) AS ts FROM media",
    "exif_unix_roundtrip": "SELECT path, coalesce(epoch(dto)::BIGINT, 0) AS seconds, strftime(dto, '%Y:%m:%d %H:%M:%S') AS exif FROM parsed",
    "sidecar_prefix_join": "SELECT path, json_name, coalesce(rule, 0) AS rule FROM media LEFT JOIN ranked USING (path)",
    "sidecar_first_listed": "SELECT path, json_name FROM media LEFT JOIN listed USING (path)",
    "conditional_fallback": "SELECT path, capture_ts, date_source, no_date FROM final",
    "bucket_day": "SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m-%d') AS bucket, count(*) AS files FROM orders GROUP BY ALL",
    "bucket_month": "SELECT strftime(l_shipdate, '%Y-%m') AS bucket, count(*) AS files FROM lineitem GROUP BY ALL",
    "route_path": """
        SELECT path AS source_path, CASE WHEN kind = 'NO_DATE' THEN 'out/NO_DATE/' || name ELSE concat_ws('/', 'out', kind, year, bucket, name) END AS target_path, message
        FROM routed JOIN lines USING (path, name, kind)""",
    "route_path_month": """
        SELECT path AS source_path, CASE WHEN no_date THEN 'out/NO_DATE/' || name ELSE concat_ws('/', 'out', kind, year, strftime(capture_ts, '%Y-%m'), name) END AS target_path FROM routed""",
    "collision_last": "SELECT path, target_path, CASE WHEN path = max(path) OVER (PARTITION BY target_path) THEN 'copied' ELSE 'overwritten' END AS status FROM contested",
    "collision_report": "SELECT target_path, max(path) AS kept_path, count(*) AS sources FROM contested GROUP BY target_path HAVING count(*) > 1",
    "copy_number": "SELECT path, target_path, row_number() OVER (PARTITION BY target_path ORDER BY path) - 1 AS copy_number FROM contested",
    "summary_by_kind": "SELECT count(*) AS total, count(*) FILTER (kind = 'photos') AS photos, count(*) FILTER (kind = 'videos') AS videos, count(*) FILTER (kind = 'NO_DATE') AS no_date FROM routed",
    "summary_compat": "SELECT count(*) AS total, count(*) FILTER (lower(message) LIKE '%photo%') AS photos, count(*) FILTER (lower(message) LIKE '%video%') AS videos FROM lines",
    "progress_percent": "SELECT event_id, trunc((event_id % 101)::DOUBLE / 100.0::DOUBLE * 100)::INTEGER AS percent FROM events",
    "pipeline_classic": "SELECT kind, year, bucket, count(*) AS files FROM routed GROUP BY ALL",
    "pipeline_fast": "SELECT kind, year, bucket, count(*) AS files FROM fast GROUP BY ALL",
    "sequence_per_dir": "SELECT path, row_number() OVER (PARTITION BY dir ORDER BY path) - 1 AS folder_number FROM media",
    "override_join": """
        SELECT c_custkey, c_mktsegment, coalesce(s.l, g.l) AS "limit" FROM customer
        LEFT JOIN (SELECT c_mktsegment, max(c_acctbal) AS l FROM customer WHERE c_mktsegment[1:1] < 'H' GROUP BY 1) s USING (c_mktsegment), (SELECT min(c_acctbal) AS l FROM customer) g""",
    "asof_previous": "SELECT event_id, t0 AS t, v0 AS value FROM bracket",
    "asof_interpolate": """
        SELECT event_id, round(CASE position WHEN 'between' THEN CASE WHEN s = s0 THEN v0 ELSE v0 + (s - s0) / (s1 - s0) * (v1 - v0) END WHEN 'nearest' THEN CASE near WHEN 'before' THEN v0 ELSE v1 END END, 4) AS value, position
        FROM (SELECT *, CASE WHEN s = s0 OR s1 - s0 <= 40000 THEN 'between' WHEN CASE near WHEN 'before' THEN s - s0 ELSE s1 - s END <= 20000 THEN 'nearest' END AS position
          FROM (SELECT *, CASE WHEN s1 IS NULL OR s - s0 <= s1 - s THEN 'before' ELSE 'after' END AS near
            FROM (SELECT event_id, v0, v1, floor(epoch(t))::DOUBLE AS s, floor(epoch(t0))::DOUBLE AS s0, floor(epoch(t1))::DOUBLE AS s1 FROM bracket)))""",
    "clock_drift": """
        SELECT event_id, round(CASE WHEN s < 1704672000.0 THEN 1704067260.0 + (s - 1704067200.0) * (604770.0 / 604800.0) ELSE 1704672030.0 + (s - 1704672000.0) * (864060.0 / 864000.0) END, 3) AS corrected
        FROM (SELECT event_id, floor(epoch(ts))::DOUBLE AS s FROM events)""",
    "quality_cut": """
        SELECT event_id, hdop, nsats FROM (SELECT event_id, CASE WHEN event_id % 4 != 0 THEN value END AS hdop, event_id % 9 AS nsats FROM events) WHERE (hdop IS NULL OR hdop <= 50) AND nsats >= 4""",
    "track_merge": """
        SELECT user_id AS device, date_trunc('day', ts)::TIMESTAMP AS t, coalesce(min(value) FILTER (value < 50), max(value)) AS value FROM events GROUP BY 1, 2""",
    "nearest_place": f"""
        SELECT c_custkey, s_suppkey, round(km, 2) AS km, rank FROM (
          SELECT c_custkey, s_suppkey, km, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS rank FROM (SELECT c_custkey, s_suppkey, {_PLACE} AS km FROM cust, supp) WHERE km <= 2500)
        WHERE rank <= 3""",
    "haversine_bearing": f"""
        SELECT c_custkey, round({_PAIR}, 2) AS km,
          (floor(degrees(atan2(sin(radians(d - b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d - b)))) + 360.5)::BIGINT) % 360 AS bearing
        FROM (SELECT c_custkey, (c_custkey % 170 - 85.0)::DOUBLE AS a, (c_custkey * 7 % 360 - 180.0)::DOUBLE AS b, (c_custkey * 13 % 170 - 84.5)::DOUBLE AS c, (c_custkey * 29 % 360 - 179.5)::DOUBLE AS d FROM customer)""",
    "places_by_population": "SELECT s_name AS city, floor(s_acctbal)::BIGINT AS population FROM supplier WHERE floor(s_acctbal) >= 100 AND regexp_matches(s_name, '0[0-9]*[1-5]$')",
    "full_outer_diff": """
        SELECT p_partkey, l.v AS left_value, r.v AS right_value, CASE WHEN r.k IS NULL THEN '<' WHEN l.k IS NULL THEN '>' ELSE '<>' END AS side
        FROM (SELECT p_partkey, p_brand AS v, true AS k FROM part WHERE p_partkey % 10 != 0) l
        FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_brand || 'x' WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS v, true AS k FROM part WHERE p_partkey % 11 != 0) r USING (p_partkey)
        WHERE l.k IS NULL OR r.k IS NULL OR l.v IS DISTINCT FROM r.v""",
    "sentence_fixes": """
        SELECT 'log' || (user_id % 5) AS device,
          TIMESTAMP '2024-01-01' + to_minutes(n) + to_seconds(CASE WHEN NOT named AND n % 2 = 0 AND n % 3 = 0 THEN 1 ELSE 0 END) AS t,
          n % 60 + 0.5::DOUBLE AS lat, -(n % 120 + 0.25::DOUBLE) AS lon,
          CASE WHEN n % 3 <> 0 THEN n % 1000 + 0.5::DOUBLE ELSE 99999.0 END AS alt, CASE WHEN named THEN 18.52::DOUBLE END AS speed, CASE WHEN named THEN (n % 360)::DOUBLE END AS track,
          CASE WHEN n % 3 <> 0 THEN 0.9 ELSE 2.5 END::DOUBLE AS hdop
        FROM (SELECT user_id, event_id::INT AS n, event_id % 5 <> 0 OR event_id < 200 AS named FROM events)""",
    "file_types": """
        SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'PNG' WHEN 2 THEN CASE WHEN page_id % 2 = 0 THEN 'DOCX' ELSE 'ZIP' END WHEN 3 THEN 'MOV' WHEN 4 THEN 'WEBP' WHEN 5 THEN 'CR2'
          WHEN 0 THEN CASE WHEN starts_with(html, '<!DOCTYPE html') OR starts_with(html, '<html') THEN 'HTML' END END AS kind FROM pages""",
    "tag_descriptions": """
        SELECT p_partkey, 'PartNo' || p_partkey AS tag,
          CASE WHEN p_partkey % 2 <> 0 THEN 'fr_CA: ' || p_name WHEN p_partkey % 3 <> 0 THEN 'FR: ' || p_name WHEN p_partkey % 5 <> 0 THEN 'en: ' || p_name ELSE 'Part No ' || p_partkey END AS description
        FROM part""",
    "diff_repeats": """
        SELECT * FROM (WITH lines AS (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_partkey % 23 <> 0 THEN (l_quantity % 5)::INT END AS v FROM lineitem),
        changed AS (
          SELECT l_orderkey, CASE WHEN (l_orderkey + n) % 7 = 0 THEN v + 1 ELSE v END AS v, unnest(range(CASE WHEN (l_orderkey + n) % 9 = 0 THEN 2 ELSE 1 END))
          FROM lines WHERE (l_orderkey * 3 + n) % 11 <> 0),
        l AS (SELECT l_orderkey, v, row_number() OVER (PARTITION BY l_orderkey, v) AS i FROM lines),
        r AS (SELECT l_orderkey, v, row_number() OVER (PARTITION BY l_orderkey, v) AS i FROM changed),
        gone AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY v NULLS LAST) AS occurrence FROM l WHERE NOT EXISTS (FROM r WHERE r.l_orderkey = l.l_orderkey AND r.v IS NOT DISTINCT FROM l.v AND r.i = l.i)),
        come AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY v NULLS LAST) AS occurrence FROM r WHERE NOT EXISTS (FROM l WHERE r.l_orderkey = l.l_orderkey AND r.v IS NOT DISTINCT FROM l.v AND r.i = l.i))
        SELECT l_orderkey, occurrence::INT AS occurrence, gone.v AS left_value, come.v AS right_value, CASE WHEN come.i IS NULL THEN '<' WHEN gone.i IS NULL THEN '>' ELSE '<>' END AS side
        FROM gone FULL JOIN come USING (l_orderkey, occurrence))""",
    "natural_sort_rank": "SELECT path, row_number() OVER (PARTITION BY dir ORDER BY 'IMG_' || lpad(event_id::VARCHAR, 12, '0') || ext, path) AS rank FROM media",
    "dedupe_by_priority": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1",
    "duplicate_tags": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) - 1 AS copy_no FROM events",
    "tag_selection": """
        SELECT event_id, tag, group0 FROM (SELECT event_id, event_type AS tag, CASE WHEN event_id % 2 = 0 THEN 'EXIF' ELSE 'XMP' END AS group0 FROM events)
        WHERE (tag ILIKE '%i%' OR group0 = 'XMP') AND NOT (group0 = 'EXIF' AND tag ILIKE 'c%')""",
    "combine_first_wins": "SELECT user_id, coalesce(max(event_id) FILTER (value > 60), min(event_id)) AS event_id FROM events GROUP BY user_id",
    "pivot_union_columns": "SELECT user_id, " + ", ".join(
        f"CASE WHEN count(*) FILTER (event_type = '{t}') = 0 THEN '-' ELSE count(*) FILTER (event_type = '{t}')::VARCHAR END AS {t}" for t in ("click", "error", "purchase", "signup", "view")
    ) + " FROM events GROUP BY user_id",
    "list_join_distinct": """
        SELECT user_id, array_to_string(l, ', ') AS types, l[2] AS second FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS l FROM events GROUP BY user_id)""",
    "json_flatten": "SELECT event_id, upper(k[1:1]) || k[2:] AS tag, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "json_flatten_deep": """
        SELECT event_id, tag, place::INT AS place, value FROM (
          SELECT event_id, 'Own' || upper(k[1:1]) || k[2:] AS tag, 0 AS place, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
          UNION ALL SELECT event_id, 'UserId', 0, user_id::VARCHAR FROM events UNION ALL SELECT event_id, 'UserSeenKind', 0, event_type FROM events
          UNION ALL SELECT event_id, 'UserSeen', 0, 'true' FROM events UNION ALL SELECT event_id, 'UserSeen', 1, event_id::VARCHAR FROM events
          UNION ALL SELECT event_id, 'UserSeenDeepErX', 0, (event_id % 7)::VARCHAR FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'UserSeenDeepErX', 1, (event_id % 5)::VARCHAR FROM events WHERE event_id % 3 = 0)
        WHERE event_id % 50 <> 7""",
    "lens_matches": """
        SELECT * FROM (WITH lenses AS (
          SELECT k % 50 AS lens_type, k AS place, short, short + spread AS long, wide, wide + more AS narrow,
            'No. ' || k || ' ' || short || CASE WHEN spread > 0 THEN '-' || (short + spread) ELSE '' END || 'mm F' || wide::VARCHAR || CASE WHEN more > 0 THEN '-' || (wide + more)::VARCHAR ELSE '' END AS name
          FROM (SELECT p_partkey AS k, p_partkey % 9 * 10 + 18 AS short, p_partkey % 4 * 30 AS spread, (p_partkey % 5 + 14) / 5 AS wide, (p_partkey % 3)::DOUBLE AS more FROM part)),
        photos AS (
          SELECT l_orderkey, l_linenumber, l_partkey % 51 AS lens_type, CASE WHEN l_suppkey % 10 <> 0 THEN l_quantity * 3 + 5 END AS focal, CASE WHEN l_suppkey % 7 <> 0 THEN round(l_discount * 30 + 2.7, 2) END AS aperture FROM lineitem),
        combos AS (SELECT DISTINCT lens_type, focal, aperture FROM photos),
        met AS (
          SELECT c.lens_type, focal, aperture, place, name,
            coalesce(round(abs(aperture - CASE WHEN short = long OR wide = narrow OR focal IS NULL OR focal <= short THEN wide WHEN focal >= long THEN narrow
              ELSE exp(ln(wide) + (ln(narrow) - ln(wide)) / (ln(long) - ln(short)) * (ln(focal) - ln(short))) END), 6), 0) AS off
          FROM combos c JOIN lenses l ON c.lens_type = l.lens_type AND coalesce(focal BETWEEN short - 0.5 AND long + 0.5, true) AND coalesce(aperture BETWEEN wide - 0.15::DOUBLE AND narrow + 0.15::DOUBLE, true)),
        found AS (
          SELECT lens_type, focal, aperture, string_agg(name, ' or ' ORDER BY place) AS lens
          FROM (SELECT *, min(off) OVER (PARTITION BY lens_type, focal, aperture) AS least FROM met) WHERE round(off - least, 6) <= 0.15 GROUP BY ALL),
        firsts AS (SELECT lens_type, arg_min(name, place) AS first FROM lenses GROUP BY lens_type)
        SELECT l_orderkey, l_linenumber, coalesce(lens, first) AS lens
        FROM photos p LEFT JOIN found f ON p.lens_type = f.lens_type AND p.focal IS NOT DISTINCT FROM f.focal AND p.aperture IS NOT DISTINCT FROM f.aperture LEFT JOIN firsts s ON p.lens_type = s.lens_type)""",
    "shift_runs": """
        SELECT event_id, user_id, ts + (date_trunc('month', first) + INTERVAL 1 MONTH + (first - date_trunc('month', first)) + INTERVAL 30 SECOND - first) AS ts
        FROM (SELECT event_id, user_id, ts, min(ts) OVER (PARTITION BY user_id) AS first FROM events)""",
    "shift_by_anchor": """
        SELECT source_file, tag, value + coalesce(date_trunc('month', first) - INTERVAL 13 MONTH + (first - date_trunc('month', first)) - first, INTERVAL 0 DAY) AS value, file_order
        FROM (SELECT *, arg_min(value, file_order) FILTER (tag = 'CreateDate' AND value IS NOT NULL) OVER (PARTITION BY source_file) AS first FROM (
          SELECT o_orderkey AS source_file, 'ModifyDate' AS tag, o_orderdate + INTERVAL 40 DAY AS value, 0 AS file_order FROM orders
          UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'Other' ELSE 'CreateDate' END, o_orderdate, 1 FROM orders
          UNION ALL SELECT o_orderkey, 'CreateDate', CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY END, 2 FROM orders))""",
    "struct_json": """SELECT o_orderkey, '{"status":"' || o_orderstatus || '","customer":' || o_custkey || '}' AS body FROM orders""",
    "date_shift_overflow": f"""SELECT o_orderkey, {_shift("13", "+ to_seconds(19800)")} AS later, {_shift("-2", "- to_days(3)")} AS earlier FROM orders""",
    "date_shift_seconds": "SELECT o_orderkey, o_orderdate + to_seconds((o_orderkey % 100000)) AS shifted FROM orders",
    "month_lengths": "SELECT o_orderkey, day(last_day(o_orderdate)) AS days FROM orders",
    "date_format_tolerant": "SELECT path, coalesce(strftime(dto, '%Y/%m/%d at %H.%M'), meta) AS shown FROM parsed",
    "subsecond_merge": """
        SELECT path, meta || '.' || (event_id % 1000) || CASE WHEN event_id % 2 = 0 THEN CASE WHEN z < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', abs(z) // 60, abs(z) % 60) ELSE '' END AS "full"
        FROM (SELECT *, event_id % 1440 - 720 AS z FROM media)""",
    "human_size": """
        SELECT doc_id, CASE WHEN n < 2000 THEN n || ' bytes' WHEN n < 10000 THEN printf('%.1f kB', n / 1e3) WHEN n < 2000000 THEN printf('%.0f kB', n / 1e3) WHEN n < 10000000 THEN printf('%.1f MB', n / 1e6)
          WHEN n < 2000000000 THEN printf('%.0f MB', n / 1e6) WHEN n < 10000000000 THEN printf('%.1f GB', n / 1e9) ELSE printf('%.0f GB', n / 1e9) END AS shown
        FROM (SELECT doc_id, n_chars * n_chars * 7 AS n FROM documents)""",
    "human_duration": """
        SELECT doc_id, CASE WHEN n = 0 THEN '0 s' WHEN n < 30 THEN printf('%.2f s', n::DOUBLE) WHEN n // 3600 > 24 THEN printf('%d days %d:%02d:%02d', n // 86400, n // 3600 % 24, n // 60 % 60, n % 60)
          ELSE printf('%d:%02d:%02d', n // 3600, n // 60 % 60, n % 60) END AS shown
        FROM (SELECT doc_id, n_chars * 31 % 400000 AS n FROM documents)""",
    "human_bitrate": """
        SELECT doc_id, CASE WHEN v >= 100 THEN printf('%.0f', v) ELSE regexp_replace(CASE WHEN v >= 10 THEN printf('%.1f', v) WHEN v >= 1 THEN printf('%.2f', v) ELSE printf('%.3f', v) END, '\\.?0+$', '') END || ' ' || unit AS shown
        FROM (SELECT doc_id, n / CASE WHEN n < 1e3 THEN 1 WHEN n < 1e6 THEN 1e3 WHEN n < 1e9 THEN 1e6 ELSE 1e9 END AS v, CASE WHEN n < 1e3 THEN 'bps' WHEN n < 1e6 THEN 'kbps' WHEN n < 1e9 THEN 'Mbps' ELSE 'Gbps' END AS unit
          FROM (SELECT doc_id, (n_chars * n_chars + 0.25)::DOUBLE AS n FROM documents))""",
    "dms_roundtrip": """
        SELECT c_custkey, printf('%d deg %d'' %.2f" %s', h // 360000, h // 6000 % 60, h % 6000 / 100.0, CASE WHEN lat < 0 THEN 'S' ELSE 'N' END) AS dms, round(sign(lat) * h / 360000.0, 5) AS degrees
        FROM (SELECT c_custkey, lat, round(abs(lat) * 360000)::BIGINT AS h FROM (SELECT c_custkey, (c_custkey * 7919 % 1800000)::DOUBLE / 10000.0 - 90 AS lat FROM customer))""",
    "light_value": """
        SELECT p_partkey, round(CASE WHEN iso > 0 THEN log2(f * f * 100 / (t * CASE WHEN iso > 0 THEN iso END)) END, 4) AS lv,
          CASE WHEN t < 0.25001 THEN '1/' || floor(0.5 + 1 / t)::BIGINT ELSE regexp_replace(printf('%.1f', t), '\\.0$', '') END AS exposure FROM camera""",
    "megapixels": "SELECT p_partkey, round(p_size::DOUBLE * 100 * (p_partkey % 4000 + 1) / 1000000, 6) AS mp, p_size * 100 || 'x' || (p_partkey % 4000 + 1) AS size FROM part",
    "depth_of_field": """
        SELECT p_partkey, round(d * focal * focal / (focal * focal + b), 4) AS near, round(CASE WHEN focal * focal - b > 0 THEN d * focal * focal / (focal * focal - b) ELSE 0 END, 3) AS far,
          round(degrees(2 * atan2(36.0, 2 * focal * 1.5)), 4) AS fov, round(focal * focal / (f * coc * 1000), 4) AS hyper
        FROM (SELECT *, coc * f * (d * 1000 - focal) AS b FROM camera)""",
    "derived_columns": "SELECT p_partkey, CASE WHEN iso > 0 THEN printf('%.1f', log2(f * f * 100 / (t * CASE WHEN iso > 0 THEN iso END))) END AS lv_text FROM camera",
    "bitmask_decode": """
        SELECT p_partkey, CASE WHEN p_size % 256 = 0 THEN '(none)' ELSE array_to_string(list_transform(list_filter(range(8), lambda i: (p_size >> i::INTEGER) & 1 = 1),
          lambda i: CASE i WHEN 0 THEN 'fired' WHEN 1 THEN 'returned' WHEN 2 THEN 'auto' WHEN 3 THEN 'red-eye' ELSE '[' || i || ']' END), ', ') END AS bits, (p_size & 15)::BIGINT AS known FROM part""",
    "enum_decode": """
        SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'Unknown (' || o_orderpriority || ')' END AS priority FROM orders""",
    "content_hash_duplicates": "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "histogram20": "SELECT least(floor((l_quantity - 1) / (49.0 / 20)), 19)::INTEGER AS bin, count(*) AS rows FROM lineitem GROUP BY ALL",
    "truncation_recovery": "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 AND left(text, 31) || '#' != left(text, 32) THEN left(text, 31) || '#' WHEN length(text) < 32 THEN left(text, 32) ELSE text END) AS digest FROM documents",
    "filter_expr_null_semantics": "SELECT path, coalesce(dto < TIMESTAMP '2024-01-15', false) AS passes, NOT coalesce(dto < TIMESTAMP '2024-01-15', false) AS negated FROM parsed",
    "conditional_edit": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders",
    "list_edit": """
        SELECT user_id, array_to_string(list_filter(list_append(list_sort(list(DISTINCT event_type)), 'zoom'), lambda x: x != 'click'), ', ') AS types FROM events GROUP BY user_id""",
    "csv_quote": r"""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[",\r\n]') OR regexp_matches(text, '^\s|\s$') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS digest FROM documents""",
    "json_escape": r"""SELECT doc_id, md5('"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"') AS digest FROM documents""",
    "xml_escape": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&quot;')) AS digest, true AS same FROM pages",
    "report_template": """
        SELECT path, CASE WHEN h IS DISTINCT FROM lag(h) OVER (PARTITION BY dir ORDER BY event_id) THEN h || chr(10) || '- ' || name ELSE '- ' || name END AS line
        FROM (SELECT *, '# ' || coalesce(meta[1:10], 'none') AS h FROM media)""",
    "tag_names": """
        SELECT event_id, upper(event_type[1:1]) || event_type[2:] || ' Date ' || user_id || ' GPS Info' AS label FROM events""",
    "csv_report": '''SELECT o_orderkey, o_orderkey || ',"' || o_orderpriority || ', ""' || o_orderstatus || '""",' || o_custkey AS line FROM orders''',
    "date_texts": """
        SELECT path, strftime(ts, '%Y:%m:%d') AS day, strftime(ts, '%H:%M:%S') || '+01:00' AS clock, CASE WHEN meta = 'n/a' THEN 'bad format' END AS problem FROM media""",
    "gps_times": """
        SELECT path, printf('%02d:%02d:%02d', event_id % 24, event_id % 60, event_id % 60) || CASE WHEN event_id % 2 = 0 THEN '.25' ELSE '' END AS clock FROM media""",
    "shift_every_date": "SELECT o_orderkey, o_orderdate + INTERVAL 26 HOUR AS o_orderdate, date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 26 HOUR AS day FROM orders",
    "rational_text": "SELECT p_partkey, p_size // gcd(p_size, 8) || '/' || 8 // gcd(p_size, 8) AS fraction FROM part",
    "list_texts": '''
        SELECT o_orderkey, o_orderstatus || '; "' || o_orderpriority || '; ""x"""' AS joined, lower(o_orderstatus) || '|' || lower(o_orderpriority) || '; "x"' AS items FROM orders''',
    "struct_texts": "SELECT o_orderkey, '{a=' || o_orderstatus || ',b=' || o_orderpriority || '|,|}}' AS shown, true AS same FROM orders",
    "bytes_as_text": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'base64:/wA=' ELSE event_type END AS shown, event_type AS wide FROM events",
    "tag_sort_rank": """
        SELECT event_id AS file_order, row_number() OVER (PARTITION BY user_id ORDER BY f, event_id) AS rank
        FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type[1:1]) AS f FROM events)""",
    "copy_from_other_file": "SELECT a.event_id, coalesce(b.meta, a.meta) AS meta FROM media a LEFT JOIN media b ON b.event_id = a.event_id + 1 AND b.event_id % 2 = 1 WHERE a.event_id % 2 = 0",
    "alternate_source": """
        SELECT path, CASE WHEN event_id % 3 != 0 THEN path END AS source FROM media""",
    "run_counts": """
        SELECT count(*) AS files, count(*) FILTER (w) AS copied, count(*) FILTER (NOT w) AS overwritten, 0::BIGINT AS failed, count(DISTINCT split_part(path, '/', 1)) AS folders, 0 AS exit_code
        FROM (SELECT path, path = max(path) OVER (PARTITION BY target_path) AS w FROM contested)""",
    "interpolate_each_value": """
        SELECT event_id, round(max(v) FILTER (k = 1), 4) AS value, round(max(v) FILTER (k = 2), 4) AS alt FROM (
          SELECT event_id, k, CASE WHEN s = s0 THEN v0 WHEN s1 - s0 <= 200000 THEN v0 + (s - s0) / (s1 - s0) * (v1 - v0)
            WHEN (s1 IS NULL OR s - s0 <= s1 - s) THEN CASE WHEN s - s0 <= 50000 THEN v0 END WHEN s1 - s <= 50000 THEN v1 END AS v
          FROM (SELECT p.event_id, p.k, a.v AS v0, b.v AS v1, floor(epoch(p.t))::DOUBLE AS s, floor(epoch(a.t))::DOUBLE AS s0, floor(epoch(b.t))::DOUBLE AS s1
            FROM (SELECT *, unnest([1, 2]) AS k FROM point) p
            ASOF LEFT JOIN (SELECT 1 AS k, user_id AS device, ts AS t, value AS v FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 2, user_id, ts, value * 2 FROM events WHERE event_id % 4 = 0) a ON a.k = p.k AND a.device = p.device AND p.t >= a.t
            ASOF LEFT JOIN (SELECT 1 AS k, user_id AS device, ts AS t, value AS v FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 2, user_id, ts, value * 2 FROM events WHERE event_id % 4 = 0) b ON b.k = p.k AND b.device = p.device AND p.t < b.t))
        GROUP BY event_id""",
    "camera_fallbacks": """
        SELECT p_partkey, coalesce(nullif(a, 0), nullif(b, 0)) AS aperture, CASE WHEN p_partkey % 7 = 0 THEN 30.0::DOUBLE ELSE coalesce(a, b) END AS shutter, CASE WHEN p_partkey > 0 THEN b / p_partkey END AS red
        FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN p_partkey::DOUBLE END AS a, (p_partkey % 5)::DOUBLE AS b FROM part)""",
    "elapsed_time": "SELECT doc_id, printf('%02d:%02d:%02d', n // 3600 % 24, n // 60 % 60, n % 60) AS shown FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)",
    "shortened_text": "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 55) || '[...]' ELSE text END AS shown FROM documents",
    "gated_sources": """
        SELECT path, CASE WHEN event_id % 3 = 1 THEN coalesce(meta, dir, f) ELSE coalesce(f, meta, dir) END AS value FROM (SELECT *, CASE WHEN event_id % 5 != 0 THEN name END AS f FROM media)""",
    "safe_names": "SELECT path, dir || name AS safe FROM media",
    "signed_positions": """
        SELECT path, (CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * (event_id % 90 + 0.5))::DOUBLE AS lat, (CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * (event_id % 180 + 0.25))::DOUBLE AS lon FROM media""",
    "written_dates": """
        SELECT path, CASE event_id % 5 WHEN 0 THEN minute WHEN 1 THEN second || '.25+02:30' WHEN 2 THEN second || 'Z' END AS value,
          CASE event_id % 5 WHEN 0 THEN minute WHEN 1 THEN second WHEN 2 THEN second END AS bare, second AS formed
        FROM (SELECT *, strftime(ts, '%Y:%m:%d %H:%M:00') AS minute, strftime(ts, '%Y:%m:%d %H:%M:%S') AS second FROM media)""",
    "date_format_strict": "SELECT path, strftime(dto, '%d/%m/%y') AS shown FROM parsed",
    "date_directives": """
        SELECT path, CASE WHEN dto IS NULL THEN full_ ELSE strftime(dto + to_seconds(left(tenths, 1)::INT), '%Y-%m-%dT%H:%M:%S') || substr(tenths, 2) || zone END AS iso,
          (epoch(dto)::BIGINT - CASE WHEN n % 2 = 0 THEN 19800 ELSE 0 END) || ' ' || lpad((n % 1000)::VARCHAR, 3, '0') || ' ' || replace(zone, ':', '') || '%' AS epoch
        FROM (SELECT *, event_id AS n, printf('%.1f', (event_id % 1000) / 1000.0::DOUBLE) AS tenths, CASE WHEN event_id % 2 = 0 THEN '+05:30' ELSE '+00:00' END AS zone, meta || '.' || lpad((event_id % 1000)::VARCHAR, 3, '0') || CASE WHEN event_id % 2 = 0 THEN '+05:30' ELSE '' END AS full_ FROM parsed)""",
    "xmp_dates": "SELECT path, CASE event_id % 4 WHEN 2 THEN CASE WHEN meta = 'n/a' THEN 'bad format' END WHEN 3 THEN 'bad date' END AS problem FROM media",
    "lens_texts": """
        SELECT p_partkey, CASE WHEN f * 0.31 < 1 THEN printf('%.2f', f * 0.31) ELSE printf('%.1f', f * 0.31) END AS f_number, printf('%.1f mm (35 mm equivalent: %.1f mm)', focal, focal + 20) AS focal,
          focal::INTEGER || CASE WHEN p_partkey % 2 = 0 THEN '-' || (focal + 50)::INTEGER ELSE '' END || 'mm f/3.5-5.6' AS lens FROM camera""",
    "significant_digits": """
        SELECT p_partkey, round(round(p_retailprice / s) * s, 4) AS two, try_cast(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS DOUBLE) AS number
        FROM (SELECT *, pow(10.0, floor(log10(p_retailprice)) - 1) AS s FROM part)""",
    "coordinate_forms": """
        SELECT c_custkey, printf('%d deg %d'' %.2f', h // 360000, h // 6000 % 60, h % 6000 / 100.0) AS "full", printf('%d %.3f', m // 60000, m % 60000 / 1000.0) || chr(39) AS short, printf('%+.4f', lat) AS plain
        FROM (SELECT c_custkey, lat, round(abs(lat) * 360000)::BIGINT AS h, round(abs(lat) * 60000)::BIGINT AS m FROM (SELECT c_custkey, (c_custkey * 7919 % 1800000)::DOUBLE / 10000.0 - 90 AS lat FROM customer))""",
    "binary_sizes": """
        SELECT doc_id, CASE WHEN n < 2048 THEN n || ' bytes' WHEN n < 10240 THEN printf('%.1f KiB', n / 1024) WHEN n < 2097152 THEN printf('%.0f KiB', n / 1024) WHEN n < 10485760 THEN printf('%.1f MiB', n / 1048576)
          WHEN n < 2147483648 THEN printf('%.0f MiB', n / 1048576) WHEN n < 10737418240 THEN printf('%.1f GiB', n / 1073741824) ELSE printf('%.0f GiB', n / 1073741824) END AS shown
        FROM (SELECT doc_id, n_chars * n_chars * 7 AS n FROM documents)""",
    "php_report": r"""SELECT o_orderkey, 'Array("id" => ' || o_orderkey || ',"note" => "\$\"' || o_orderpriority || '\t\x01")' AS line FROM orders""",
    "json_literals": r"""
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '"0' || event_id || '"' WHEN 2 THEN 'true' WHEN 3 THEN '"' || event_type || '\u0002\n"' ELSE '-1.5E3' END AS value FROM events""",
    "escapes_of_c": r"""SELECT o_orderkey, o_orderstatus || '\n\\\t' || o_orderpriority AS escaped, true AS same FROM orders""",
    "html_entities": "SELECT o_orderkey, 'éA<' || o_orderstatus || '&nosuch;' AS shown FROM orders",
    "nested_changes": """
        SELECT o_orderkey, '{"s":"' || s || '!","l":["' || lower(o_orderpriority) || '!","x!"],"m":{"k":["' || s || '!"]},"n":1}' AS body FROM (SELECT *, lower(o_orderstatus) AS s FROM orders)""",
    "nested_struct_text": """SELECT o_orderkey, '{"a": {"b": "' || o_orderstatus || ',"}, "c": ["x", "' || o_orderpriority || '"], "d": ""}' AS body FROM orders""",
    "file_template_forms": """
        SELECT path, stem[5:] || right(stem, 2) AS skip, dir || '/' || lower(stem) || '.' || upper(ext[2:]) AS "case", stem || '-' || printf('%02d', c) || ext AS copy,
          stem || CASE c WHEN 0 THEN '' WHEN 1 THEN '_b' ELSE '_c' END AS letters, (5 + q) || '_' || printf('%03d', q + 1) AS sequence
        FROM (SELECT *, event_id % 3 AS c, event_id % 7 AS q FROM media)""",
    "tag_templates": """
        SELECT path, '$ ' || name || ' by ' || upper(dir) || ' ' || lower(dir) || ', ' || lower(stem) || ' it''s me ' || ext[2:] || chr(10) AS line, coalesce(meta, '-') || '!' AS dated FROM media""",
    "sectioned_report": """
        SELECT dir, row_number() OVER (PARTITION BY dir ORDER BY spot, kind, n) - 1 AS place, line FROM (
          SELECT dir, n AS spot, 0 AS kind, n, CASE WHEN n = 1 THEN '= ' || dir END AS line FROM numbered
          UNION ALL SELECT dir, n, 1, n, CASE WHEN opens THEN h END FROM numbered
          UNION ALL SELECT dir, n, 2, n, CASE WHEN meta IS NOT NULL THEN name END FROM numbered
          UNION ALL SELECT dir, max(n) OVER (PARTITION BY dir, section), 3, n, CASE WHEN event_id % 10 = 0 THEN '- ' || stem END FROM numbered
          UNION ALL SELECT dir, max(n) OVER (PARTITION BY dir), 4, n, CASE WHEN event_id % 50 = 0 THEN '. ' || stem END FROM numbered) WHERE line IS NOT NULL""",
    "output_actions": """
        SELECT path, output, CASE WHEN there OR later THEN 'skip' ELSE 'write' END AS new, CASE WHEN later THEN 'append' ELSE 'write' END AS append_new
        FROM (SELECT path, output, output IN (SELECT output FROM outputs WHERE event_id % 97 = 0) AS there, row_number() OVER (PARTITION BY output ORDER BY path) > 1 AS later FROM outputs)""",
    "report_columns": """
        SELECT row_number() OVER (ORDER BY CASE WHEN every THEN lpad(place::VARCHAR, 20, '0') ELSE lower(tag) END) - 1 AS place, tag
        FROM (SELECT *, bool_and(place IS NOT NULL) OVER () AS every FROM (
          SELECT event_type AS tag, min(event_id) FILTER (user_id = (SELECT min(user_id) FROM events)) AS place FROM events GROUP BY event_type))""",
    "group_priority": """
        SELECT source_file, tag, group0, file_order FROM tags WHERE group0 IN ('XMP', 'EXIF') QUALIFY row_number() OVER (PARTITION BY source_file, tag ORDER BY group0 = 'EXIF', file_order) = 1""",
    "group_removal": "SELECT file_order, tag, group0 FROM tags WHERE group0 <> 'EXIF' OR tag IN ('DateTimeOriginal', 'CreateDate', 'ModifyDate')",
    "alternate_files": "SELECT file_order, ['Main', 'File1', 'File2'][least(file_order % 4, 2) + 1] AS group8 FROM tags",
    "raw_and_printed": "SELECT source_file, tag, coalesce(printed, value) AS value, false AS raw FROM tags UNION ALL SELECT source_file, tag, raw, true FROM tags",
    "tag_headings": "SELECT file_order, group0 || ':Main:0x' || lpad(printf('%x', file_order), 4, '0') || ' ' || tag AS long, label FROM tags",
    "description_order": "SELECT file_order, row_number() OVER (PARTITION BY source_file ORDER BY lower(label), file_order) AS rank FROM tags",
    "documents_inside": """
        SELECT user_id, CASE WHEN document IS NOT NULL THEN 'Doc' || row_number() OVER (PARTITION BY user_id ORDER BY document) END AS doc, document
        FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 3 != 0 THEN event_type END AS document FROM events)""",
    "tag_catalogue": "SELECT group0, tag, count(DISTINCT source_file) AS files FROM tags GROUP BY ALL",
    "status_lists": "SELECT 'overwritten' AS status, path FROM contested QUALIFY path <> max(path) OVER (PARTITION BY target_path)",
    "folder_rows": "SELECT dir, count(*) AS files, sum(event_id)::BIGINT AS length FROM media WHERE regexp_matches(lower(path), '^album_1[^/]/[^/]*\\.jp[^/]*g$') GROUP BY dir",
    "deleted_values": """
        SELECT path, CASE WHEN n <> 1 THEN name END AS name, CASE WHEN n = 0 THEN 'typed in' ELSE meta END AS meta FROM checked""",
    "nearest_large_place": f"""
        SELECT c_custkey, s_suppkey, round(km, 2) AS km FROM (SELECT c_custkey, s_suppkey, {_PLACE} AS km FROM cust, supp JOIN supplier USING (s_suppkey) WHERE floor(s_acctbal) >= 2000 AND s_nationkey % 3 < 2)
        WHERE km <= 700 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) = 1""",
    "places_by_patterns": """
        SELECT s_name AS city, floor(s_acctbal)::BIGINT AS population FROM supplier WHERE floor(s_acctbal) >= 0 AND s_nationkey % 4 = 1 AND s_nationkey % 3 < 2 AND NOT regexp_matches(s_name, '[05]$')""",
    "interpolate_spans": """
        SELECT event_id, round(CASE position WHEN 'between' THEN CASE WHEN s = s0 THEN v0 ELSE v0 + (s - s0) / (s1 - s0) * (v1 - v0) END WHEN 'nearest' THEN CASE near WHEN 'before' THEN v0 ELSE v1 END END, 4) AS value, position
        FROM (SELECT *, CASE WHEN s = s0 OR s1 - s0 <= CASE WHEN e1 % 6 = 0 THEN 60000 ELSE 20000 END OR day(t0) = day(t1) THEN 'between' WHEN CASE near WHEN 'before' THEN s - s0 ELSE s1 - s END <= 60000 THEN 'nearest' END AS position
          FROM (SELECT *, CASE WHEN s1 IS NULL OR s - s0 <= s1 - s THEN 'before' ELSE 'after' END AS near
            FROM (SELECT p.event_id, a.value AS v0, b.value AS v1, a.ts AS t0, b.ts AS t1, b.event_id AS e1, floor(epoch(p.t))::DOUBLE AS s, floor(epoch(a.ts))::DOUBLE AS s0, floor(epoch(b.ts))::DOUBLE AS s1
              FROM point p ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 2 = 0) a ON p.device = a.user_id AND p.t >= a.ts
              ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 2 = 0) b ON p.device = b.user_id AND p.t < b.ts)))""",
    "content_digests": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents",
}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {_VIEWS} {sql}" for name, sql in SQL.items()}
