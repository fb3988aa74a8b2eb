"""The corpus operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from codelathe.llm import bpe, chosen_path, decontaminate, html, langid, ogg, quality, repeats, toxicity, warc

QUERIES = {
    "op1_html_extraction": html.query,
    "op2_quality_rules": quality.query,
    "op3_bpe_codec": bpe.query,
    "op4_suffix_dedup": repeats.query,
    "op5_warc_bundles": warc.query,
    "op6_toxicity_chain": toxicity.query,
    "op7_ogg_media": ogg.query,
    "op8_near_dedup": chosen_path.query,
    "op9_language_id": langid.query,
    "op10_decontamination": decontaminate.query,
}

ORACLES = {
    "op4_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT doc_id, o, substr(h, 1024 * o + 1, 1422) AS h FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 200) // 512 + 1)) AS o FROM d WHERE length(h) >= 400)),
s AS (SELECT doc_id, 512 * o + j AS i, md5(substr(h, 2 * j + 1, 400)) AS m FROM (SELECT doc_id, o, h, unnest(range(0, least(512, length(h) // 2 - 199))) AS j FROM o)),
p AS (SELECT doc_id, i FROM s WHERE m IN (SELECT m FROM s GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM p),
k AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
a AS (SELECT doc_id, min(i) AS b, max(i) + 200 AS e FROM k GROUP BY doc_id, run),
q AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM a),
x AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)
""",
    "op8_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT x AS v, x AS u FROM l UNION SELECT r.v, l.y FROM r JOIN l ON l.x = r.u),
c AS (SELECT v, min(u) AS component FROM r GROUP BY v)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept FROM s LEFT JOIN c ON v = doc_id
""",
    "op5_warc_bundles": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.url, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
""",
    "op10_decontamination": r"""
WITH lo AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
li AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[k:k + least(8, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS k FROM li WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM lo, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.k, dw.n, item FROM dw JOIN iw USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
diag AS (SELECT h.doc_id, h.item, h.k, h.n, o.k AS o FROM hits h JOIN (
           SELECT item, least(8, len(w)) AS n, k, array_to_string(w[k:k + least(8, len(w)) - 1], ' ') AS g
           FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS k FROM li WHERE len(w) > 0)) o
           ON o.item = h.item AND o.n = h.n JOIN dw ON dw.doc_id = h.doc_id AND dw.n = h.n AND dw.k = h.k AND dw.g = o.g),
runs AS (SELECT doc_id, item, k - o AS line, k, n, k - row_number() OVER (PARTITION BY doc_id, item, k - o ORDER BY k) AS r FROM (SELECT DISTINCT doc_id, item, k, n, o FROM diag)),
longest AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, count(*) - 1 + min(n) AS c FROM runs GROUP BY doc_id, item, line, r) GROUP BY doc_id)
SELECT lo.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM lo LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
""",
}
