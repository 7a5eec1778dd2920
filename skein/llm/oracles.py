"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP9 = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


#: Runs of digits, a-z after lower-casing A-Z, and non-ASCII characters.
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4 = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
spots AS (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM sized),
windows AS (SELECT DISTINCT n, array_to_string(w[i + 1 : i + n], ' ') AS gram, item_id FROM spots),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM docs, sizes),
hits AS (
  SELECT doc_id, i, places.n AS n, item_id
  FROM places JOIN windows ON windows.n = places.n AND gram = array_to_string(w[i + 1 : i + places.n], ' ')
),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1
),
owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

OP5 = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
ones AS (SELECT word, count(*) AS n FROM tokens GROUP BY 1),
total AS (SELECT sum(n) AS total FROM ones),
pairs AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM tokens),
twos AS (SELECT before, word, count(*) AS n FROM pairs WHERE i > 0 GROUP BY 1, 2),
scored AS (
  SELECT p.doc_id, CASE
      WHEN i = 0 THEN ln(one.n) - ln(total)
      WHEN two.n >= 2 THEN ln(two.n) - ln(prior.n)
      ELSE ln(0.4) + ln(one.n) - ln(total) END AS s
  FROM pairs p JOIN ones one ON one.word = p.word
  LEFT JOIN twos two ON two.before = p.before AND two.word = p.word
  LEFT JOIN ones prior ON prior.word = p.before, total
),
sums AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY 1)
SELECT doc_id, len(w) AS n_words, round(coalesce(s, 0), 6) AS log_score,
       CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_log_score
FROM docs LEFT JOIN sums USING (doc_id)
"""

#: The cut places and the form come from the hash of the id, the parts from a list of the units.
OP11 = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', doc_id)) AS h FROM documents
), d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, len(u) AS n,
    [CAST(concat('0x', h[8 * i + 1 : 8 * i + 8]) AS BIGINT) FOR i IN range(4)] AS r
  FROM t
), c AS (
  SELECT doc_id, text, n, CASE
      WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
      WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    u, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1 : a], '') AS prefix,
    array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

SQL = {
    "op4_decontamination": OP4,
    "op5_lm_score": OP5,
    "op9_exact_dedup": OP9,
    "op11_fill_middle": OP11,
}
