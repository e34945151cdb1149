"""The queries' rows in SQL, where SQL can express them."""

from strandline.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, stride

OP2 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
    SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p
), r AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM r
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9 = f"""
WITH i AS (
    SELECT cast(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), iw AS (
    SELECT DISTINCT item, least(len(w), 10) AS span,
        array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
), d AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), h AS (
    SELECT doc_id, s, x.span, iw.item
    FROM (
        SELECT doc_id, span, s, array_to_string(w[s:s + span - 1], ' ') AS win
        FROM (
            SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS s
            FROM d, (SELECT DISTINCT span FROM iw) WHERE len(w) >= span
        )
    ) AS x JOIN iw ON iw.span = x.span AND iw.win = x.win
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + span)) AS p FROM h) GROUP BY doc_id
), it AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP3 = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), m AS (
    SELECT win, min(doc_id) AS least FROM s GROUP BY win HAVING min(doc_id) <> max(doc_id)
), g AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN m USING (win) WHERE doc_id > least
), k AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
    FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN g USING (doc_id, p)
    GROUP BY doc_id
)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP4 = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), s AS (
    SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h
    FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800)
), m AS (
    SELECT doc_id, i FROM s SEMI JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h)
), r AS (
    SELECT doc_id, min(i) AS a, max(i) + 400 AS b
    FROM (
        SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM m)
    ) GROUP BY doc_id, run
), k AS (
    SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(part, '' ORDER BY b) || substr(any_value(x), 2 * max(b) + 1) AS kept
    FROM (
        SELECT doc_id, x, a, b, substr(x, 2 * f + 1, 2 * (a - f)) AS part
        FROM (SELECT doc_id, x, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM r JOIN d USING (doc_id))
    ) GROUP BY doc_id
)
SELECT doc_id, len(x) // 2 AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_STEP = stride()

OP8 = f"""
WITH d AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), ph(phrase, label) AS (
    VALUES {", ".join(f"('{p}', '{label}')" for p, label in PHRASES)}
), pl AS (
    SELECT doc_id, i - 1 AS place, label
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) AS x
    JOIN ph ON array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase
), base AS (
    SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM pl GROUP BY doc_id
), t AS (
    SELECT label, list_distinct(string_split(template, ' ')) AS tw
    FROM (VALUES {", ".join(f"('{t}', '{label}')" for t, label in TEMPLATES)}) AS v(template, label)
), b AS (
    SELECT doc_id, list_distinct(w[i + 1:i + {2 * _STEP}]) AS bw
    FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {_STEP}, 1), {_STEP})) AS i FROM d)
), h AS (
    SELECT doc_id, label, len(list_intersect(bw, tw)) / len(tw) AS share FROM b, t WHERE len(list_intersect(bw, tw)) >= {THRESHOLD} * len(tw)
), l AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM pl) GROUP BY doc_id
), s AS (
    SELECT doc_id, max(share) AS score FROM h GROUP BY doc_id
)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP13 = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: cast(floor(256 * cast(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), s AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label,
        cast(list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.x) = len(r.x)
), p AS (
    SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, cast(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE s.label <> p.own AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

ORACLES = {"op13_hard_negatives": OP13, "op8_licenses": OP8, "op2_warc": OP2, "op3_substring_dedup": OP3, "op4_suffix_dedup": OP4, "op9_decontaminate": OP9}
