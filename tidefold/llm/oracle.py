"""DuckDB SQL of the registered queries, written from their rules."""

from __future__ import annotations

from tidefold.llm.chat import CLOSE, OPEN, TRAINED_ROLE
from tidefold.llm.licenses import LEAST, NO_WORD, SHORT_NOTICES as SHORT, TEMPLATES
from tidefold.llm.linededup import MIN_SITES
from tidefold.llm.quality import RULES, STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORD = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
with d as (
    select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls
    from documents
),
placed as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from d),
windows as (
    select doc_id, i, concat_ws(' ', {", ".join(f"lead(word, {k}) over follow" for k in range(8))}) as seen
    from placed window follow as (partition by doc_id order by i)
    qualify lead(word, 7) over follow is not null
),
found as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, seen) as n from windows) where n > 1
),
repeated as (select doc_id, count(distinct i + j) as n from found, range(8) t(j) group by doc_id),
counts as (
    select d.doc_id, len(w) as n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
        length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
        len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, len(ls) as n_lines,
        len(list_filter(w, lambda x: lower(x) in ({_STOPS}))) as n_stop_words
    from d left join repeated r on d.doc_id = r.doc_id
),
based as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
    n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
    not base_failed and word_chars / n_words::double between {RULES["mean_word_chars"].least}
        and {RULES["mean_word_chars"].most}
        and n_symbols / n_words::double <= {RULES["symbols_per_word"].most}
        and n_stop_words / n_words::double >= {RULES["stop_word_share"].least}
        and case when n_lines > 0 then n_dup_lines / n_lines::double else 0 end <= {RULES["dup_line_share"].most} as kept
from based
"""

LINE_DEDUP = rf"""
with parts as (
    select doc_id, source, unnest(string_split(text, chr(10))) as line,
        unnest(range(len(string_split(text, chr(10))))) as pos
    from documents where text is not null
),
keyed as (select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as k from parts),
wide as (
    select k, min(doc_id) as first from keyed where k <> '' group by k
    having count(distinct source) + max(case when source is null then 1 else 0 end) >= {MIN_SITES}
),
judged as (
    select d.doc_id, d.pos, d.line, w.k is not null and d.doc_id <> w.first as gone
    from keyed d left join wide w on d.k = w.k
),
rebuilt as (
    select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text,
        count(*) filter (gone) as removed_lines
    from judged group by doc_id
)
select d.doc_id, r.text, coalesce(r.removed_lines, 0)::bigint as removed_lines
from documents d left join rebuilt r on d.doc_id = r.doc_id
"""

_HEAD = f"'{OPEN}' || coalesce(t.role, '') || chr(10)"
_BODY = f"coalesce(t.text, '') || '{CLOSE.strip()}' || chr(10)"


def _text(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: {_HEAD} || {_BODY}), '')"


def _mask(turns: str) -> str:
    flag = f"case when t.role = '{TRAINED_ROLE}' then '1:' else '0:' end"
    run = f"'0:' || length({_HEAD}) || ' ' || {flag} || length({_BODY})"
    return f"array_to_string(list_transform({turns}, lambda t: {run}), ' ')"


CHAT_FORMAT = f"""
with marked as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k,
        role is not distinct from '{TRAINED_ROLE}' as answer
    from conversations
),
lasts as (select conv_id, max(k) filter (answer) as last from marked group by conv_id),
worse as (
    select m.*, l.last,
        (select b.text from marked b where b.conv_id = m.conv_id and b.answer and b.k < l.last order by b.k desc limit 1)
            as earlier
    from marked m join lasts l on m.conv_id = l.conv_id
),
gathered as (
    select conv_id, list(struct_pack(role := role, text := text) order by k) as a,
        list(struct_pack(role := role, text := case when k = last then coalesce(earlier, '') else text end) order by k) as b,
        min(k) filter (k = last and coalesce(earlier, '') is distinct from text) as differs
    from worse group by conv_id
),
cut as (select conv_id as pair_id, a, b, coalesce(differs - 1, len(a)) as common from gathered)
select pair_id, common::bigint as prompt_turns, {_text("a[1 : common]")} as prompt,
    {_text("a[common + 1 :]")} as chosen, {_text("b[common + 1 :]")} as rejected,
    {_mask("a[common + 1 :]")} as chosen_mask, {_mask("b[common + 1 :]")} as rejected_mask
from cut
"""

LICENSES = rf"""
with t(license_id, body) as (values {", ".join("('" + n + "', '" + b.replace("'", "''") + "')" for n, b in TEMPLATES.items())}),
texts as (
    select 0 as side, null as doc_id, license_id, body from t
    union all select 1, doc_id, null, coalesce(text, '') from documents
),
placed as (
    select side, doc_id, license_id, unnest(w) as word, unnest(range(len(w))) as i
    from (select *, list_filter(string_split_regex(lower(body), '{NO_WORD}'), lambda x: x <> '') as w from texts)
),
shingled as (
    select side, doc_id, license_id, i, concat_ws(' ', {", ".join(f"lead(word, {k}) over follow" for k in range(5))}) as s
    from placed window follow as (partition by side, doc_id, license_id order by i)
    qualify lead(word, 4) over follow is not null
),
wanted as (select distinct license_id, s from shingled where side = 0),
sizes as (select license_id, count(*) as n from wanted group by license_id),
met as (
    select d.doc_id, w.license_id, count(distinct w.s) as shared, min(d.i) as first_word
    from shingled d join wanted w on d.s = w.s where d.side = 1 group by d.doc_id, w.license_id
)
select doc_id, license_id, shared::bigint as shared, shared / n::double as containment, first_word::bigint as first_word
from met join sizes using (license_id) where shared / n::double >= {LEAST}
"""

SHORT_NOTICES = rf"""
with t(license_id, notice) as (values {", ".join("('" + n + "', '" + b.replace("'", "''") + "')" for n, b in SHORT.items())}),
wanted as (
    select license_id, ' ' || trim(regexp_replace(lower(notice), '{NO_WORD}', ' ', 'g')) || ' ' as s from t
),
texts as (
    select doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '{NO_WORD}', ' ', 'g')) || ' ' as body
    from documents
),
met as (select doc_id, license_id, left(body, strpos(body, s)) as before from texts join wanted on contains(body, s))
select doc_id, license_id, 1::bigint as shared, 1::double as containment,
    (length(before) - length(replace(before, ' ', '')) - 1)::bigint as first_word
from met
"""


# Brute force over all pairs of an anchor and another row. Vectors are numbered by themselves: ids may repeat.
HARD_NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), component AS (
  SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM usable
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM component a JOIN component b ON a.pos = b.pos AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
  GROUP BY 1, 2, 3, 4
), ranked AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE label = anchor_label
), windowed AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM ranked p JOIN scored s ON p.anchor_id = s.anchor_id AND s.label <> s.anchor_label
  WHERE p.place <= 5 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM windowed WHERE rank <= 10
"""


def _clusters(rounds: int) -> str:
    """Every round as two tables: the nearest centroid of each vector, and the centroids after it."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT vec_id, CAST(c.cluster AS INTEGER) AS cluster, sum((p.x - c.x) * (p.x - c.x)) AS distance
  FROM component p JOIN centre{n} c ON p.pos = c.pos GROUP BY p.vec_id, c.cluster
), own{n} AS MATERIALIZED (
  SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS place FROM near{n}) WHERE place = 1
)""")
        if n < rounds:
            steps.append(f"""moved{n} AS MATERIALIZED (
  SELECT o.cluster, p.pos, sum(p.x) AS total, count(*) AS n
  FROM own{n} o JOIN component p ON o.vec_id = p.vec_id GROUP BY o.cluster, p.pos
), centre{n + 1} AS MATERIALIZED (
  SELECT c.cluster, c.pos, CASE WHEN m.n IS NULL THEN c.x
    ELSE CAST((m.total - ((m.total % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x
  FROM centre{n} c LEFT JOIN moved{n} m ON c.cluster = m.cluster AND c.pos = m.pos
)""")
    return ", ".join(steps)


CLUSTERS = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), component AS MATERIALIZED (
  SELECT vec_id, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM kept
), started AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) AS place FROM kept
), centre0 AS MATERIALIZED (
  SELECT s.place - 1 AS cluster, p.pos, p.x FROM started s JOIN component p ON s.vec_id = p.vec_id WHERE s.place <= 8
), {_clusters(10)}, named AS (
  SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM centre10 GROUP BY cluster
)
SELECT o.vec_id, o.cluster, o.distance,
       CAST(sum(o.distance) OVER (PARTITION BY o.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(o.distance) OVER () AS BIGINT) AS inertia, n.centroid_sha256
FROM own10 o JOIN named n ON o.cluster = n.cluster
"""


# Kind, expression, group whose length counts, and its least length, in the order of the kinds.
_SECRETS = (
    (
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        r"|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
        2, 6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    ("url_login", r"[a-z]{2,12}://[A-Za-z0-9._-]+:[A-Za-z0-9._%-]{6,}@", 0, 1),
)


def _secret_spans() -> str:
    """Every match of each kind: between the matches lie the parts that they split the text into."""
    parts = []
    for n, (kind, pattern, group, least) in enumerate(_SECRETS):
        parts.append(f"""
  SELECT row, {n} AS n, '{kind}' AS kind, s."start" AS "start", s."end" AS "end" FROM (
    SELECT row, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
      'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(m[1:i], lambda g: length(g))) - length(m[i]),
      'end': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(m[1:i], lambda g: length(g))),
      'own': length(o[i])}})) AS s
    FROM (
      SELECT row, regexp_extract_all(body, '{pattern}') AS m, regexp_extract_all(body, '{pattern}', {group}) AS o,
             regexp_split_to_array(body, '{pattern}') AS gaps
      FROM texts WHERE regexp_matches(body, '{pattern}'))) WHERE s.own >= {least}""")
    return " UNION ALL ".join(parts)


SECRETS = f"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents
), span AS MATERIALIZED ({_secret_spans()}
), told AS (
  SELECT row, n, "start", kind || ':' || CAST("start" AS BIGINT) || ':' || CAST("end" AS BIGINT) AS told FROM span
), whole AS (
  SELECT row, string_agg(told, ',' ORDER BY "start", n) AS spans,
         string_agg(told, ',' ORDER BY "start", n) FILTER (WHERE n < 3) AS base,
         count(*) FILTER (WHERE n = 0) AS n_assign, count(*) FILTER (WHERE n = 1) AS n_access,
         count(*) FILTER (WHERE n = 2) AS n_hex
  FROM told GROUP BY row
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN whole w ON t.row = w.row
"""
