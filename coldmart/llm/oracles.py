"""What the registered queries of this subpackage return, said in SQL where SQL can."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


URL_FILTER = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parsed AS (
  SELECT page_id, {_lowered("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), met AS (
  SELECT page_id, arg_max(h || p, [length(h || p), length(h)]) AS rule,
         arg_max(v, [length(h || p), length(h)]) AS verdict
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN met USING (page_id)
"""

# Every turn: '<turn ', the role, '>' and a line, the text, '</turn>' and a line; what is escaped
# counts twice.
CHAT_FORMAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), learned AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(16 + length(role) + length(text)
           + length(regexp_replace(role || text, '[^\\<>]', '', 'g')))::BIGINT AS formatted_chars
FROM learned GROUP BY conv_id
"""

EXACT_TOPK = """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fit q JOIN fit c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, trim({_lowered('line')}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id,
       count(*) AS n_lines,
       count(*) FILTER (WHERE k IN (FROM common)) AS n_dropped,
       sha256(coalesce(
         string_agg(line, chr(10) ORDER BY place) FILTER (WHERE k NOT IN (FROM common)), ''
       )) AS kept_sha256
FROM keyed GROUP BY doc_id
"""

MIXING = """
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT
           AS chance
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS s, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER o AS place,
         (SELECT sum(s) FROM sums) - 3 * (sum(s) OVER o - s) AS rest,
         (SELECT sum(w) FROM sums) - (sum(w) OVER o - w) AS open
  FROM sums WINDOW o AS (ORDER BY 3 * s / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT min(place) AS place, arg_min(rest, place) AS rest, arg_min(open, place) AS open
  FROM ordered WHERE w * rest <= 3 * s * open
), aimed AS (
  SELECT source, s, CASE WHEN o.place >= l.place THEN (w * l.rest)::DOUBLE / l.open ELSE (3 * s)::DOUBLE END AS target
  FROM ordered o, level l
), whole AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM aimed
), grains AS (
  SELECT source, chance, sum(size) AS g,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY chance) AS reached
  FROM sized GROUP BY source, chance
), edges AS (
  SELECT w.source, min(chance + CASE WHEN 2 * ((target - whole * s) - (reached - g)) >= g THEN 1 ELSE 0 END) AS below
  FROM grains JOIN whole w ON grains.source IS NOT DISTINCT FROM w.source
  WHERE target - whole * s > 0 AND reached >= target - whole * s AND reached - g < target - whole * s
  GROUP BY w.source
)
SELECT doc_id, size, w.s AS source_size, w.target,
       (size * (whole + CASE WHEN chance < coalesce(below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d
JOIN whole w ON d.source IS NOT DISTINCT FROM w.source
LEFT JOIN edges e ON d.source IS NOT DISTINCT FROM e.source
"""


def _licenses() -> str:
    # The phrases, the templates and the threshold, as the query states them.
    phrases = [
        ("under the mit license", "mit"),
        ("apache license version 2", "apache-2"),
        ("cc by nc", "cc-by-nc"),
    ]
    creative = "licensed under a creative commons attribution"
    templates = [
        ("mit", "released under the mit license", "mit license"),
        ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"
                " and associated documentation files to deal in the software without restriction",
         "permission is hereby granted"),
        ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
        ("apache-2", "licensed under the apache license you may not use this file except in compliance"
                     " with the license", "under the apache license"),
        ("cc-by", "licensed under cc by 4 0", "cc by 4"),
        ("cc-by", f"{creative} 4 0 international license", "attribution 4"),
        ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4"),
        ("cc-by-sa", f"{creative} sharealike 4 0 international license", "attribution sharealike 4"),
        ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4"),
        ("cc-by-nc", f"{creative} noncommercial 4 0 international license", "attribution noncommercial 4"),
        ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd 4"),
        ("cc-by-nd", f"{creative} noderivatives 4 0 international license", "attribution noderivatives 4"),
        ("gpl-3", "this work is licensed under the gnu general public license version 3",
         "gnu general public license version 3"),
        ("gpl-3", "free software you can redistribute it and or modify it under the terms of the gnu general"
                  " public license as published by the free software foundation", "gnu general public license"),
        ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"
                " provided that the following conditions are met",
         "redistribution and use in source and binary forms"),
    ]
    step = max(len(t.split()) for _, t, _ in templates)
    said = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in phrases)
    held = ", ".join(f"('{label}', list_distinct(string_split('{t}', ' ')), ' {telling} ')" for label, t, telling in templates)
    return f"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_lowered("coalesce(text, '')")},
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS t
  FROM documents
), phrases(label, p) AS (VALUES {said}
), templates(label, p, telling) AS (VALUES {held}
), places AS (
  SELECT doc_id, label, i - 1 AS word
  FROM texts, phrases, unnest(generate_series(1, len(t) - len(p) + 1)) AS g(i)
  WHERE t[i] = p[1] AND t[i : i + len(p) - 1] = p
), based AS (
  SELECT doc_id, count(*) AS n, min(word) AS a, max(word) AS b, list_distinct(list(label)) AS labels
  FROM places GROUP BY doc_id
), windows AS (
  SELECT doc_id, list_distinct(t[i + 1 : i + {2 * step}]) AS held,
         ' ' || array_to_string(t[i + 1 : i + {2 * step}], ' ') || ' ' AS said
  FROM texts, unnest(generate_series(0, greatest(len(t) - 1 - {step}, 0), {step})) AS g(i)
  WHERE list_has_any(t, list_distinct(flatten((SELECT list(p) FROM templates))))
), met AS (
  SELECT doc_id, label, len(list_intersect(p, held)) AS n, len(p) AS whole
  FROM windows, templates
  WHERE len(list_intersect(p, held)) >= CASE WHEN len(p) < 10 THEN len(p) ELSE ceil(0.85 * len(p) - 1e-9) END
    AND contains(said, telling)
), joined AS (
  SELECT doc_id, list_distinct(list(label)) AS labels, max(n / whole) AS share FROM met GROUP BY doc_id
)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word,
       b::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(based.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(
         coalesce(based.labels, []), coalesce(joined.labels, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM texts LEFT JOIN based USING (doc_id) LEFT JOIN joined USING (doc_id)
"""


def _terms(text: str) -> str:
    return f"regexp_extract_all({_lowered(text)}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


LEXICAL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS place, doc_id, {_terms('text')} AS t FROM documents WHERE text IS NOT NULL
), whole AS (
  SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM texts WHERE len(t) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest({_terms('text')}) AS term FROM benchmark WHERE text IS NOT NULL
), counted AS (
  SELECT place, doc_id, len(t) AS n, term, count(*) AS tf
  FROM texts, unnest(t) AS u(term) WHERE term IN (SELECT term FROM asked) GROUP BY place, doc_id, len(t), term
), weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(w.n) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM counted, whole w GROUP BY term
), impacts AS (
  SELECT place, doc_id, term,
         weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * c.n * w.n) // w.l))) AS impact
  FROM counted c JOIN weighed USING (term), whole w
), scored AS (
  SELECT item_id, place, doc_id, sum(impact)::BIGINT AS score
  FROM asked JOIN impacts USING (term) GROUP BY item_id, place, doc_id HAVING sum(impact) > 0
)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scored
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER best <= 50
"""


def _leaf(text: str) -> str:
    fields = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


# ``up`` holds the nodes of all trees by level, ``top`` those over the subroots; ``folded`` walks
# from every leaf to its subroot and ``ended`` from there to the root.
MERKLE = f"""
WITH RECURSIVE digits AS (
  SELECT *, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS d FROM documents
), told AS (
  SELECT doc_id, lang, {_leaf('text')} AS leaf, {_leaf(_lowered('text'))} AS lowered,
         xor(4294967295, list_reduce(list_concat([4294967295], d),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
  FROM digits
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, leaf,
         CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM told
), up AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 8, n
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS lvl, pos, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY lvl, pos // 8, n
), near AS (
  SELECT u.tree, l.pos AS leaf, u.lvl, u.pos, u.digest
  FROM leaves l JOIN up u ON l.tree = u.tree AND u.n > 1
   AND u.pos // 8 = l.pos // (8 ** (u.lvl + 1))::BIGINT AND u.pos <> l.pos // (8 ** u.lvl)::BIGINT
), far AS (
  SELECT s.tree, t.lvl, t.pos, t.digest
  FROM subroots s JOIN top t ON t.n > 1
   AND t.pos // 8 = s.pos // (8 ** (t.lvl + 1))::BIGINT AND t.pos <> s.pos // (8 ** t.lvl)::BIGINT
), siblings AS (
  SELECT tree, leaf, 0 AS part, lvl, pos, digest FROM near
  UNION ALL SELECT l.tree, l.pos, 1, f.lvl, f.pos, f.digest FROM leaves l JOIN far f ON l.tree = f.tree
), proofs AS (
  SELECT tree, leaf AS pos, string_agg(digest, '' ORDER BY part, lvl, pos) AS proof FROM siblings GROUP BY tree, leaf
), folded AS (
  SELECT tree, pos AS leaf, 0 AS lvl, pos, n, claimed AS digest FROM leaves
  UNION ALL
  SELECT f.tree, f.leaf, f.lvl + 1, f.pos // 8, (f.n + 7) // 8,
         sha256(coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos < f.pos), '') || f.digest
             || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos > f.pos), ''))
  FROM folded f LEFT JOIN near s ON s.tree = f.tree AND s.leaf = f.leaf AND s.lvl = f.lvl
  WHERE f.n > 1 GROUP BY f.tree, f.leaf, f.lvl, f.pos, f.n, f.digest
), ended AS (
  SELECT f.tree, f.leaf, 0 AS lvl, s.pos, s.n, f.digest FROM folded f JOIN subroots s ON f.tree = s.tree WHERE f.n = 1
  UNION ALL
  SELECT f.tree, f.leaf, f.lvl + 1, f.pos // 8, (f.n + 7) // 8,
         sha256(coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos < f.pos), '') || f.digest
             || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos > f.pos), ''))
  FROM ended f LEFT JOIN far s ON s.tree = f.tree AND s.lvl = f.lvl
  WHERE f.n > 1 GROUP BY f.tree, f.leaf, f.lvl, f.pos, f.n, f.digest
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       e.digest AS folded_root, e.digest = t.digest AS verified
FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN top t ON t.n = 1
JOIN ended e ON e.tree = l.tree AND e.leaf = l.pos AND e.n = 1
LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": URL_FILTER,
        "op3_exact_topk": EXACT_TOPK,
        "op7_chat_format": CHAT_FORMAT,
        "op5_line_dedup": LINE_DEDUP,
        "op9_license_scan": _licenses(),
        "op10_mixing": MIXING,
        "op11_merkle": MERKLE,
        "op12_lexical": LEXICAL,
    }
