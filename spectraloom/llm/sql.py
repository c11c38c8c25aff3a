"""SQL of the conversation repair and spelling queries."""

from __future__ import annotations

CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), "
    "lambda x: ('0x' || x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)


def _plus(key: str, cost: str, edits: str) -> str:
    """A (cost, audit) key with a cost and edits put in front."""
    return f"(lpad((substr({key}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{edits}' || substr({key}, 10))"


def _fit(symbol: str, key: str) -> str:
    """A turn kept or re-roled as ``symbol``; null where neither may be."""
    if symbol == "s":
        return f"CASE WHEN NOT gone AND head = 's' THEN {_plus(key, 'cut', 'K')} END"
    return (
        f"CASE WHEN gone THEN NULL WHEN head = '{symbol}' THEN {_plus(key, 'cut', 'K')} ELSE {_plus(key, 'cut + 1', 'R')} END"
    )


_KEY = CRC32.format("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")

CONVERSATIONS = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KEY} % 20 AS kind
    FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN ''
        WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM k, (VALUES (1), (2)) v(c) WHERE kind <> 0 AND (c = 1 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
    count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (SELECT *, left(role, 1) AS head, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before FROM o),
c AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut FROM f),
e AS (SELECT DISTINCT conv_id, n + 1 AS p, '000000000' AS e0, '000000010II' AS e1, '000000005I' AS e2, '000000000' AS e3 FROM c
    UNION ALL SELECT conv_id, p, least(x0, {_plus("x2", "5", "I")}, {_plus("x3", "10", "II")}),
        least(x1, {_plus("x2", "5", "I")}, {_plus("x3", "10", "II")}), least(x2, {_plus("x3", "5", "I")}), least(x3, {_plus("x2", "5", "I")})
    FROM (SELECT c.conv_id, c.p, least({_plus("e0", "2", "D")}, {_fit("s", "e1")}, {_fit("u", "e2")}) AS x0,
        least({_plus("e1", "2", "D")}, {_fit("u", "e2")}) AS x1, least({_plus("e2", "2", "D")}, {_fit("a", "e3")}) AS x2,
        least({_plus("e3", "2", "D")}, {_fit("u", "e2")}) AS x3
        FROM e JOIN c ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND c.p = e.p - 1)),
b AS (SELECT conv_id, substr(e0, 1, 9)::BIGINT AS cost, substr(e0, 10) AS audit FROM e WHERE p = 1),
w AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY q) AS p,
    count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY q) AS r
    FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS q FROM b WHERE audit <> '')),
m AS (SELECT w.conv_id, edit, q, r, c.role, c.text, bool_or(edit = 'K' AND r = 1 AND head = 's') OVER (PARTITION BY w.conv_id) AS led
    FROM w LEFT JOIN c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.p = c.p AND edit <> 'I' WHERE edit <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (r - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user'
        ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY q) AS body FROM m GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || head NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
    sha256(coalesce(body, '')) AS repaired_sha256
FROM a LEFT JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN t ON a.conv_id IS NOT DISTINCT FROM t.conv_id"""

_RUN = CRC32.format("concat(coalesce(doc_id::VARCHAR, ''), ':', run)")

SPELLING = f"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]{{5,}}')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, c, {_RUN} AS h FROM r),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS k FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.i = y.i AND x.k = y.k AND x.word <> y.word
    UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.k = v.word
    UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.k = v.word),
b AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM p
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
    CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, coalesce(form, word) AS root FROM f
    UNION SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, t.root, f.n, n_near, form_n FROM f JOIN t ON f.word = t.word
WHERE t.root IN (SELECT word FROM f WHERE form IS NULL)"""
