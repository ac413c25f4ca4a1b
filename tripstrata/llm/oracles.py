"""The same answers in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
    WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    item_window AS (
        SELECT item_id, len(w) AS size, w AS win FROM item WHERE len(w) BETWEEN 1 AND 9
        UNION
        SELECT item_id, 10, w[i : i + 9] FROM item, unnest(range(1, len(w) - 8)) AS r(i) WHERE len(w) >= 10
    ),
    sizes AS (SELECT DISTINCT size FROM item_window),
    doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
    doc_window AS (
        SELECT rid, size, i, w[i : i + size - 1] AS win
        FROM doc, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)
        WHERE len(w) >= size
    ),
    hit AS (SELECT rid, d.size, i, item_id FROM doc_window d JOIN item_window t ON d.size = t.size AND d.win = t.win),
    covered AS (
        SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + size)) AS r(p) GROUP BY rid
    ),
    named AS (
        SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

OP10 = """
    WITH page AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest
        FROM pages
    ),
    first AS (SELECT digest, min(page_id) AS page_id FROM page WHERE n >= 100 GROUP BY digest)
    SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
        CASE WHEN p.page_id > f.page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN p.page_id > f.page_id THEN f.page_id END AS refers_to, true AS intact
    FROM page p LEFT JOIN first f ON p.digest = f.digest AND n >= 100
"""

OP2 = r"""
    WITH RECURSIVE message AS (
        SELECT conv_id, turn, role, trim(text, chr(10)) AS body,
            trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS said FROM conversations
    ),
    origin AS (SELECT conv_id, said, min(turn) AS turn FROM message WHERE said <> '' GROUP BY ALL),
    quote AS (
        SELECT m.conv_id, m.turn, back, o.turn AS origin
        FROM message m, (VALUES (1), (2)) AS b(back)
        JOIN message q ON q.conv_id = m.conv_id AND q.turn = m.turn - back AND q.said <> ''
        LEFT JOIN origin o ON o.conv_id = q.conv_id AND o.said = q.said AND o.turn < m.turn
    ),
    linked AS (
        SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked,
            max(origin) FILTER (back = 1) AS parent_turn
        FROM quote GROUP BY ALL
    ),
    full_message AS (SELECT * FROM message LEFT JOIN linked USING (conv_id, turn)),
    climb AS (
        SELECT conv_id, turn, turn AS at, parent_turn AS up, 0 AS depth FROM full_message
        UNION ALL
        SELECT c.conv_id, c.turn, f.turn, f.parent_turn, depth + 1
        FROM climb c JOIN full_message f ON c.conv_id = f.conv_id AND c.up = f.turn
    )
    SELECT f.conv_id, f.turn, role, f.parent_turn, c.at AS root_turn, CAST(depth AS BIGINT) AS depth,
        CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, body
    FROM full_message f JOIN climb c ON c.conv_id = f.conv_id AND c.turn = f.turn AND c.up IS NULL
"""

OP13 = rf"""
    WITH doc AS (
        SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    smallest AS (SELECT t, min(doc_id) AS first_id FROM doc GROUP BY t),
    label AS (
        SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good,
            coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic
        FROM labels GROUP BY doc_id
    ),
    failed AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
            + 4 * CAST(100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 3 * length(t) AS INTEGER)
            + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
            + 16 * coalesce(CAST(doc_id > first_id AS INTEGER), 0) AS mask
        FROM doc JOIN smallest USING (t) LEFT JOIN label USING (doc_id)
    ),
    counted AS (SELECT part, mask, good, toxic, count(*) AS n FROM failed GROUP BY ALL),
    f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
    ordered AS (
        SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
            AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
    ),
    steps AS (
        SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0) AS before
        FROM ordered, unnest(range(1, 6)) AS r(step)
    ),
    summed AS (
        SELECT part, filter_order, step, bit,
            coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit = 0), 0) AS kept,
            coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
            coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
            coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
            coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND good = 1), 0) AS good_lost,
            coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND toxic = 1), 0) AS toxic_lost
        FROM counted, (SELECT filter_order, step, bit, CAST(before AS INTEGER) AS before FROM steps) GROUP BY ALL
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
        CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
        CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
        CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM summed
"""

ORACLE: dict[str, str] = {
    "op2_chat_formatting": OP2,
    "op10_warc": OP10,
    "op6_benchmark_decontamination": OP6,
    "op13_filter_interaction_audit": OP13,
}
