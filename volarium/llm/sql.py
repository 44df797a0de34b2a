"""SQL counterparts of the queries that SQL can express on whole tables."""

from __future__ import annotations

from volarium.llm.chat import ESCAPES, OTHER_CLOSING, OTHER_END, OTHER_OPENING, TEMPLATE
from volarium.llm.quality import STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words WHERE len(w) >= 13)),
marked AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS hit FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM marked WHERE hit),
lost AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM words),
kept AS (SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.j) AS t FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.j = g.j WHERE g.j IS NULL GROUP BY f.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN lost l ON w.doc_id = l.doc_id LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

OP5 = rf"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0),
runs AS (SELECT doc_id, i, word, lag(word) OVER d AS prev, lag(word, 2) OVER d AS prev2 FROM flat WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
uni AS (SELECT word, count(*) AS c FROM flat GROUP BY word),
bi AS (SELECT prev, word, count(*) AS c FROM runs WHERE prev IS NOT NULL GROUP BY prev, word),
tri AS (SELECT prev2, prev, word, count(*) AS c FROM runs WHERE prev2 IS NOT NULL GROUP BY prev2, prev, word),
n AS (SELECT count(*) AS total FROM flat),
scored AS (
  SELECT r.doc_id, CASE WHEN r.prev IS NULL THEN log10(u.c) - log10(n.total)
    WHEN r.prev2 IS NULL THEN CASE WHEN b.c IS NOT NULL THEN log10(b.c) - log10(v.c) ELSE log10(0.4) + log10(u.c) - log10(n.total) END
    WHEN t.c IS NOT NULL THEN log10(t.c) - log10(h.c)
    WHEN b.c IS NOT NULL THEN log10(0.4) + log10(b.c) - log10(v.c) ELSE 2 * log10(0.4) + log10(u.c) - log10(n.total) END AS s
  FROM runs r CROSS JOIN n JOIN uni u ON r.word = u.word LEFT JOIN uni v ON r.prev = v.word LEFT JOIN bi b ON r.prev = b.prev AND r.word = b.word
    LEFT JOIN bi h ON r.prev2 = h.prev AND r.prev = h.word LEFT JOIN tri t ON r.prev2 = t.prev2 AND r.prev = t.prev AND r.word = t.word),
sums AS (SELECT doc_id, sum(s) AS s, count(*) AS c FROM scored GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, round(x.s / x.c, 6) AS mean_log_score FROM words w LEFT JOIN sums x ON w.doc_id = x.doc_id
"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
sound AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
  SELECT a, min(b) AS component_id FROM r GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN reach r ON v.vec_id = r.a LEFT JOIN counts c ON v.vec_id = c.a
"""


def op7() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, unnest(generate_series(1, len(w) - 7)) AS i, w FROM words WHERE len(w) >= 8),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) > 1 AS again FROM windows),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 7)) AS j FROM grams WHERE again) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, len(string_split(t, chr(10))) AS all_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops FROM words),
m AS (
  SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS full_lines, all_lines, stops
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.005
    AND n_dup_lines / full_lines <= 0.5 AND (all_lines - full_lines) / all_lines <= 0.8 AS kept
FROM f
"""


def op8() -> str:
    def escaped(column: str) -> str:
        for plain, code in ESCAPES:
            column = f"replace({column}, '{plain}', '{code}')"
        return column
    marks = " ".join(f"WHEN '{r.name}' THEN {len(r.opening) + len(r.closing)}" for r in TEMPLATE)
    other = f"{len(OTHER_OPENING) + len(OTHER_END) + len(OTHER_CLOSING)} + length({escaped('role')})"
    loss = " OR ".join(f"role = '{r.name}'" for r in TEMPLATE if r.loss)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
chats AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE {loss}), '') AS learned,
    sum(length({escaped('text')}) + CASE role {marks} ELSE {other} END) AS chars, string_agg(role, ',' ORDER BY turn, role, text) AS roles
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, '(system,)?user(,assistant,user)*(,assistant)?') AS valid
FROM chats
"""


OP11 = r"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
held AS (SELECT k, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT d.doc_id, d.i, d.line, coalesce(h.n >= 2 AND h.first <> d.doc_id, false) AS gone FROM keyed d LEFT JOIN held h ON d.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every distance to every entry, round by round; x(vec_id, part, j, v) holds the integers, b0, b1, ... the codebooks."""
    steps = [f"""
sound AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS j, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM sound)),
b0 AS MATERIALIZED (SELECT part, entry, j, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM sound) USING (vec_id) WHERE entry < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best
  FROM (SELECT x.vec_id, x.part, b.entry, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS d FROM x JOIN b{r} b ON x.part = b.part AND x.j = b.j GROUP BY ALL) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT x.part, a.best.entry AS entry, x.j, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{r} a ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY ALL),
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.j, CASE WHEN m.n IS NULL THEN b.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v
  FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry AND b.j = m.j)""")
    return f"""
WITH {",".join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM b{rounds})
SELECT s.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY s.label) AS BIGINT) AS label_error, k.codebooks_sha256
FROM sound s JOIN codes c ON s.vec_id = c.vec_id CROSS JOIN book k
"""


ORACLE = {"op2_substring_dedup": OP2, "op5_backoff_score": OP5, "op6_pivot_range_join": OP6, "op7_quality_table": op7(), "op8_chat_format": op8(),
          "op11_line_dedup": OP11, "op12_orchard_codes": op12()}
