"""SQL of the corpus queries that SQL can express, for DuckDB: plain statements of what the operators must find."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_LOWERED = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"

# Sets of shingles, all pairs that share one, and classes by reachability.
JACCARD = rf"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
 regexp_extract_all({_LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
shingles AS (SELECT DISTINCT r, array_to_string(w[p:p + 4], ' ') AS s FROM
 (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
reach(r, other) AS (SELECT r, r FROM docs UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.other)
SELECT any_value(d.doc_id) AS doc_id, min(o.doc_id) AS class_id, (SELECT count(*) FROM links WHERE x = reach.r) AS n_links
FROM reach JOIN docs d ON d.r = reach.r JOIN docs o ON o.r = reach.other GROUP BY reach.r"""

_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Every window of every item against every window of that length of every document.
DECONTAMINATION = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + 9], ' ') AS k FROM
 (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM items WHERE len(w) > 0)),
grams AS (SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS k FROM
 (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM docs JOIN (SELECT DISTINCT size FROM windows) ON len(w) >= size)),
hits AS (SELECT r, p, size, item_id FROM grams JOIN windows USING (k, size)),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(generate_series(p, p + size - 1)) AS q FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""

# Every window of 35 words by its text.
REPEATED_WORDS = r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS k FROM
 (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS p FROM docs WHERE len(w) >= 35)),
repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(p, p + 34)) AS q FROM windows JOIN repeated USING (k)),
words AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS q FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""

# Every window of 100 bytes, in hexadecimal digits, by the MD5 of its bytes; texts are first cut into overlapping parts,
# so that no substring is looked for far into a long text.
REPEATED_BYTES = """WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT r, doc_id, base, substr(h, 2 * base + 1, 1198) AS h FROM
 (SELECT r, doc_id, h, unnest(generate_series(0, length(h) // 2 - 100, 500)) AS base FROM docs WHERE length(h) >= 200)),
windows AS (SELECT r, doc_id, base + p AS p, md5_number(substr(h, 2 * p + 1, 200)) AS k FROM
 (SELECT r, doc_id, base, h, unnest(generate_series(0, least(499, length(h) // 2 - 100))) AS p FROM parts)),
firsts AS (SELECT k, min(doc_id) AS first_doc, arg_min(p, (doc_id, p)) AS first_p FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(p, p + 99)) AS q FROM windows JOIN firsts USING (k) WHERE doc_id <> first_doc OR p <> first_p),
spans AS (SELECT r, count(*) AS n, sum(CAST(q - 1 > before AS INT)) AS n_spans FROM
 (SELECT r, q, coalesce(lag(q) OVER (PARTITION BY r ORDER BY q), -2) AS before FROM gone) GROUP BY r),
bytes AS (SELECT r, unnest(generate_series(0, length(h) // 2 - 1)) AS q, unnest(regexp_extract_all(h, '..')) AS b FROM docs SEMI JOIN gone USING (r)),
kept AS (SELECT r, string_agg(b, '' ORDER BY q) AS h FROM bytes ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, length(docs.h) // 2 AS n_bytes, coalesce(spans.n, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN spans.n IS NULL THEN docs.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM docs LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)"""


def _any_case(pattern: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern)


def _found(kind: str, rank: int, pattern: str, keep: str, group: int = 0) -> str:
    """Matches of a pattern with their places: what lies between matches tells where they start."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, {rank} AS rank, start, start + length(m) AS stop FROM (SELECT r, m, part,
 CAST(sum(length(part)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, g FROM
 (SELECT r, unnest(regexp_extract_all(t, '{quoted}')) AS m, unnest(regexp_extract_all(t, '{quoted}', {group})) AS g,
 unnest(string_split_regex(t, '{quoted}')[:len(regexp_extract_all(t, '{quoted}'))]) AS part,
 unnest(generate_series(1, len(regexp_extract_all(t, '{quoted}')))) AS i FROM docs) WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {keep}"""


_NAME = "(" + "|".join(_any_case(x) for x in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = _NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_WHO = "|".join(_any_case(x) for x in ("username", "user", "login", "account", "client_id", "access_key_id"))
_ACCOUNT = rf"""\b(?:{_WHO})["']?[ \t]*[:=][ \t]*["']?[A-Za-z0-9._@+-]{{3,}}"""
_KEY = "[A-Za-z0-9+/_=-]+"
_ENDPOINT = r"""\b[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]{4,}|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b"""
_OVERLAP = "{0}.start < {1}.stop AND {1}.start < {0}.stop"
_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"

# Strong spans by their patterns; weak ones by an interval join with the scopes of identifiers.
SECRETS = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_found("assign", 0, _ASSIGN, "length(g) >= 12", 2)} UNION ALL {_found("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18")}
 UNION ALL {_found("hex", 2, "[0-9a-f]+", "length(m) >= 16")}),
accounts AS ({_found("account", 3, _ACCOUNT, "true")}),
weak AS (SELECT * FROM ({_found("key", 4, _KEY, "length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}
 UNION ALL {_found("endpoint", 5, _ENDPOINT, "true")}) w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND {_OVERLAP.format("b", "w")})),
identifiers AS (SELECT * FROM base WHERE kind = 'access' UNION ALL SELECT * FROM accounts),
parts AS (SELECT * FROM base WHERE kind <> 'access' UNION ALL SELECT * FROM weak),
near AS (SELECT i.r, i.kind AS i_kind, i.start AS i_start, i.stop AS i_stop, p.* EXCLUDE (r) FROM identifiers i JOIN parts p ON p.r = i.r
 AND p.start < i.stop + 240 AND p.stop > i.start - 240 AND NOT ({_OVERLAP.format("p", "i")})),
complete AS (SELECT DISTINCT r, i_kind, i_start, i_stop FROM near WHERE kind IN ('assign', 'hex', 'key')),
linked AS (SELECT DISTINCT r, kind, rank, start, stop FROM near SEMI JOIN complete USING (r, i_kind, i_start, i_stop) WHERE kind IN ('key', 'endpoint')
 UNION SELECT DISTINCT r, 'account', 3, i_start, i_stop FROM complete WHERE i_kind = 'account'),
strong AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
 count(*) FILTER (kind = 'hex') AS n_hex, {_LISTED} AS listed FROM base GROUP BY r),
everything AS (SELECT r, {_LISTED} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN strong USING (r) LEFT JOIN everything USING (r)"""

_ESCAPED = r"length({0}) + length({0}) - length(replace({0}, '\', '')) + len(regexp_extract_all({0}, '</?s>|<</?SYS>>|\[/?INST\]'))"
_HARD = "</s>[INST] ok [/INST]"
_TURNS = "'' ORDER BY turn, role, text"

# Turns in order; what is trained on are the assistant's texts, and escapes add a character each.
CHAT = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '{_HARD}'), (-7, 1, 'assistant', '{_HARD}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), {_TURNS})) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, {_TURNS}) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(8 + {_ESCAPED.format("role")} + length(role) - length(replace(role, chr(10), '')) + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

ORACLES = {
    "op2_jaccard_join": JACCARD,
    "op3_decontamination": DECONTAMINATION,
    "op4_recompression_dedup": REPEATED_WORDS,
    "op7_secret_scan": SECRETS,
    "op8_suffix_dedup": REPEATED_BYTES,
    "op9_prefix_targets": CHAT,
}
