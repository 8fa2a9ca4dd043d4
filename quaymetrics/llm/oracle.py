"""DuckDB statements, written from the plain definitions."""

SUFFIX_DEDUP = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (
    SELECT doc_id, s, hash(substring(h, 2 * s + 1, 200)) AS k
    FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM bytes WHERE len(h) >= 200)),
repeated AS (SELECT k FROM places GROUP BY k HAVING count(*) > 1),
ranked AS (
    SELECT doc_id, s, row_number() OVER (PARTITION BY substring(h, 2 * s + 1, 200) ORDER BY doc_id, s) AS n
    FROM places JOIN repeated USING (k) JOIN bytes USING (doc_id)),
later AS (SELECT doc_id, s FROM ranked WHERE n > 1),
steps AS (SELECT doc_id, s, s - lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) > 100 AS starts FROM later),
numbered AS (SELECT doc_id, s, count(*) FILTER (starts) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM steps),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, k),
edges AS (SELECT doc_id, k, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM spans),
parts AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
           string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY k) AS kept
    FROM edges JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN parts USING (doc_id)
"""

_FILLED = r"regexp_matches(line, '[^\x20\x09-\x0D]')"

LINE_DEDUP = rf"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, lines[i] AS line, i FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM split)),
filled AS (
    SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM numbered WHERE {_FILLED}),
three AS (
    SELECT doc_id, p, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM filled
    WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
ranked AS (
    SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS n FROM three WHERE c IS NOT NULL),
covered AS (
    SELECT DISTINCT doc_id, p + k AS p FROM (SELECT *, unnest([0, 1, 2]) AS k FROM ranked WHERE n > 1)),
every AS (
    SELECT doc_id, i, line, {_FILLED} AS is_filled,
           count(*) FILTER ({_FILLED}) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM numbered),
marked AS (
    SELECT e.*, CASE WHEN is_filled THEN c.p IS NOT NULL ELSE c.p IS NOT NULL AND d.p IS NOT NULL END AS gone
    FROM every e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.p = c.p
    LEFT JOIN covered d ON e.doc_id = d.doc_id AND e.p + 1 = d.p),
texts AS (
    SELECT doc_id, count(*) FILTER (is_filled) AS n_lines, count(*) FILTER (is_filled AND gone) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id),
runs AS (
    SELECT doc_id, count(*) AS n_runs FROM covered c
    WHERE NOT EXISTS (SELECT 1 FROM covered b WHERE b.doc_id = c.doc_id AND b.p = c.p - 1) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN texts USING (doc_id) LEFT JOIN runs USING (doc_id)
"""


def _words(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(string_split_regex({lowered}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
items AS (SELECT item_id, {_words("text")} AS ws FROM benchmark),
grams AS (
    SELECT DISTINCT item_id, ws[i:i + 9] AS gram, len(ws[i:i + 9]) AS n
    FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
places AS (
    SELECT doc_id, i, n, ws[i:i + n - 1] AS gram
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM grams))),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN grams USING (gram, n)),
hit_words AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


_WRITTEN = "replace(replace({0}, '&', '&amp;'), '<', '&lt;')"
_TEXT, _ROLE = _WRITTEN.format("text"), "replace(" + _WRITTEN.format("role") + ", '>', '&gt;')"
CHAT_FORMAT = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn:>' || {_ROLE} || {_TEXT} || '</turn>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
    SELECT lang, k, ws[i:i + k - 1] AS gram
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, gram, count(*) AS n FROM grams GROUP BY lang, k, gram),
sizes AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cuts AS (
    SELECT c.lang, c.gram, c.n AS a, cut, l.n AS l, r.n AS r,
           CAST(1000000 AS HUGEINT) * c.n * c.n // (CAST(l.n AS HUGEINT) * r.n) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND n >= 10) c
    JOIN f l ON l.lang = c.lang AND l.gram = c.gram[1:cut] JOIN f r ON r.lang = c.lang AND r.gram = c.gram[cut + 1:c.k]),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) AS place FROM cuts),
longer AS (
    SELECT lang, gram[i:i + 1] AS gram, max(n) AS n FROM (SELECT *, unnest([1, 2]) AS i FROM f WHERE k = 3 AND n >= 10)
    GROUP BY 1, 2),
left_over AS (
    SELECT w.* FROM weakest w LEFT JOIN longer b ON b.lang = w.lang AND b.gram = w.gram
    WHERE place = 1 AND (b.n IS NULL OR 100 * b.n < 50 * a)),
ranked AS (
    SELECT *, array_to_string(gram, ' ') AS phrase,
           row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(gram, ' '))) AS rank
    FROM left_over)
SELECT lang, rank, phrase, a, l, r, s.n AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN sizes s USING (lang) WHERE rank <= 2000
"""


def _draw(k: int) -> str:
    return f"CAST('0x' || substring(digest, {8 * k + 1}, 8) AS UBIGINT)"


FILL_IN_MIDDLE = f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
drawn AS (
    SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, {_draw(0)} % (length(text) + 1) AS p, {_draw(1)} % (length(text) + 1) AS q,
           text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_draw(2)} % 100 >= 90 AS plain,
           {_draw(3)} % 100 < 20 AS spm
    FROM texts),
cut AS (SELECT *, CAST(least(p, q) AS BIGINT) AS a, CAST(greatest(p, q) AS BIGINT) AS b FROM drawn),
parts AS (
    SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM cut)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

EXACT_DEDUP = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY text)
"""
