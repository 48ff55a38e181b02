"""DuckDB SQL for the text queries that SQL can express over whole tables."""

from __future__ import annotations

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEAR_DEDUP = f"""
    WITH RECURSIVE split AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
    sets AS (
        SELECT doc_id,
               CASE WHEN len(w) = 0 THEN []
                    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
               END AS s
        FROM split),
    shingles AS (SELECT doc_id, len(s) AS size, unnest(s) AS shingle FROM sets),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, a.size + b.size AS sizes, count(*) AS shared
        FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.size, b.size),
    links AS (SELECT a, b FROM common WHERE 100 * shared >= 80 * (sizes - shared)),
    reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
    SELECT doc_id, len(s) AS n_shingles, least(doc_id, min(b)) AS component_id, doc_id = least(doc_id, min(b)) AS kept
    FROM sets LEFT JOIN reached ON doc_id = a
    GROUP BY doc_id, len(s)"""

SUBSTRING_DEDUP = f"""
    WITH split AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM split),
    windows AS (
        SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos,
               unnest(list_transform(range(1, len(w) - 48), lambda i: sha256(array_to_string(w[i:i + 49], ' ')))) AS content
        FROM split),
    firsts AS (SELECT content, min(doc_id) AS first FROM windows GROUP BY content),
    repeated AS (SELECT doc_id, pos FROM windows JOIN firsts USING (content) WHERE first < doc_id),
    judged AS (
        SELECT doc_id, pos, word, max(repeated.pos) OVER before IS NOT NULL AS gone
        FROM words LEFT JOIN repeated USING (doc_id, pos)
        WINDOW before AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
    cut AS (
        SELECT doc_id, count(*) FILTER (WHERE gone) AS lost, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept
        FROM judged GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(lost, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM split LEFT JOIN cut USING (doc_id)"""

EXACT_DEDUP = f"""
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, {_FOLDED} AS t FROM documents)
    WINDOW w AS (PARTITION BY t)"""

SUFFIX_DEDUP = """
    WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    windows AS (
        SELECT doc_id, unnest(range(0, len(h) // 2 - 399)) AS pos,
               unnest(list_transform(range(0, len(h) // 2 - 399), lambda i: md5_number(substr(h, 2 * i + 1, 800)))) AS content
        FROM bytes),
    often AS (SELECT content FROM windows GROUP BY content HAVING count(*) > 1),
    repeated AS (SELECT doc_id, pos FROM windows SEMI JOIN often USING (content)),
    opened AS (
        SELECT doc_id, pos, coalesce(pos > lag(pos) OVER o + 400, true) AS opens
        FROM repeated WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    numbered AS (SELECT doc_id, pos, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM opened),
    runs AS (SELECT doc_id, min(pos) AS low, max(pos) + 400 AS high FROM numbered GROUP BY doc_id, run),
    gaps AS (
        SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before
        FROM runs),
    cut AS (
        SELECT doc_id, sum(high - low)::BIGINT AS lost, count(*) AS spans, max(high) AS done,
               string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (low - before))::BIGINT), '' ORDER BY low) AS head
        FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(lost, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
           sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(done, 0) + 1)::BIGINT))) AS kept_sha256
    FROM bytes LEFT JOIN cut USING (doc_id)"""

_NAMES = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RESAMPLING = f"""
    WITH RECURSIVE split AS (SELECT doc_id, {_NAMES.format(_FOLDED)} AS w FROM documents),
    raw AS (SELECT doc_id, unnest(w) AS word FROM split),
    aimed AS (SELECT unnest({_NAMES.format(_FOLDED)}) AS word FROM benchmark),
    codes AS (
        SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS code
        FROM range(256) AS r(n)),
    spelt AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM raw UNION ALL SELECT word FROM aimed)),
    rolled(word, h, i, crc) AS (
        SELECT word, h, 0, 4294967295 FROM spelt
        UNION ALL
        SELECT word, h, i + 1, xor(code, crc >> 8)
        FROM rolled JOIN codes ON n = xor(crc & 255, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)
        WHERE 2 * i < len(h)),
    hashed AS (SELECT word, xor(crc, 4294967295) % 10000 AS bucket FROM rolled WHERE 2 * i = len(h)),
    have AS (SELECT bucket, count(*)::DOUBLE AS s FROM raw JOIN hashed USING (word) GROUP BY bucket),
    want AS (SELECT bucket, count(*)::DOUBLE AS t FROM aimed JOIN hashed USING (word) GROUP BY bucket),
    totals AS (SELECT (SELECT count(*) FROM raw)::DOUBLE AS all_s, (SELECT count(*) FROM aimed)::DOUBLE AS all_t),
    gains AS (
        SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000)))) AS gain
        FROM have LEFT JOIN want USING (bucket), totals),
    weighed AS (
        SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight
        FROM raw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (
        SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w) AS n_words,
               (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
        FROM split LEFT JOIN weighed USING (doc_id)),
    ranked AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS drawn
        FROM scored WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
    FROM scored LEFT JOIN ranked USING (doc_id)"""

ORACLES = {
    "op1_near_dedup": NEAR_DEDUP,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op4_exact_dedup": EXACT_DEDUP,
    "op7_suffix_dedup": SUFFIX_DEDUP,
    "op13_resampling": RESAMPLING,
}
