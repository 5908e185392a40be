"""DuckDB SQL of the chunkers: relational folds over units, where the chunkers work on one text.

Each function takes SQL for (module, source_file, file_ord, content) and gives the rows of
``catalogue._rows``. Chunks of one part of a text are found by recursion over its units.
"""

from __future__ import annotations


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))::BIGINT"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def slug(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(trim(lower({text})), '[^\\pL\\pN_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g')"


def orphan(text: str) -> str:
    return f"len(list_filter(string_split({text}, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^#{{1,6}}\\s+\\S'))) = 0"


def _budget(limit: int, overlap: int) -> str:
    """CTEs from ``parts(key, text)`` to ``budgeted(key, k, content)``: pieces within the limit, or cut."""
    fits = lambda x: f"len(list_filter({x}, lambda y: {words('y')} > 0)) > 1 AND list_max(list_transform({x}, lambda y: {words('y')})) <= {limit}"
    step = max(limit - overlap, 1)
    return f"""
paras AS (SELECT key, i, p, {words('p')} AS tk FROM (SELECT key, unnest(range(len(l))) AS i, unnest(l) AS p FROM (SELECT key, list_transform(string_split(text, chr(10) || chr(10)), lambda x: {strip('x')}) AS l FROM parts)) WHERE p <> ''),
-- paragraphs over the limit are barriers: what lies between two of them is one run, and each is a run of its own
runs AS (SELECT *, tk > {limit} AS big, sum(CASE WHEN tk > {limit} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS bars FROM paras),
cut AS (SELECT key, bars, p, string_split(p, chr(10)) AS ls, string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)) AS ss FROM runs WHERE big),
way AS (SELECT *, CASE WHEN {fits('ls')} THEN 'lines' WHEN {fits('ss')} THEN 'sentences' ELSE 'windows' END AS way FROM cut),
units AS (SELECT key, 2 * bars AS run, chr(10) || chr(10) AS joiner, i, p AS t FROM runs WHERE NOT big
  UNION ALL SELECT key, 2 * bars - 1, CASE way WHEN 'lines' THEN chr(10) ELSE ' ' END, unnest(range(len(x))), unnest(x) FROM (SELECT *, CASE way WHEN 'lines' THEN ls ELSE ss END AS x FROM way WHERE way <> 'windows')),
sized AS (SELECT key, run, joiner, t, row_number() OVER (PARTITION BY key, run ORDER BY i) AS n, {words('t')} AS tk FROM units),
cum AS (SELECT *, sum(tk) OVER (PARTITION BY key, run ORDER BY n) AS upto FROM sized),
fold AS (SELECT key, run, n, 1::BIGINT AS start, NULL::BIGINT AS closed FROM cum WHERE n = 1
  UNION ALL SELECT c.key, c.run, c.n, CASE WHEN c.upto - (s.upto - s.tk) > {limit} THEN
      coalesce((SELECT min(z.n) FROM cum z WHERE z.key = c.key AND z.run = c.run AND z.n >= f.start AND z.n < c.n AND (c.upto - c.tk) - (z.upto - z.tk) <= {overlap}), c.n) ELSE f.start END,
    CASE WHEN c.upto - (s.upto - s.tk) > {limit} THEN f.start END
  FROM fold f JOIN cum c ON c.key = f.key AND c.run = f.run AND c.n = f.n + 1 JOIN cum s ON s.key = f.key AND s.run = f.run AND s.n = f.start),
bounds AS (SELECT key, run, closed AS a, n - 1 AS b FROM fold WHERE closed IS NOT NULL
  UNION ALL SELECT key, run, start, n FROM (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY n DESC) AS r FROM fold) WHERE r = 1),
pieces AS (SELECT b.key, b.run, b.b AS stop, {strip("replace(string_agg(c.t, chr(31) ORDER BY c.n), chr(31), any_value(c.joiner))")} AS content
    FROM bounds b JOIN cum c ON c.key = b.key AND c.run = b.run AND c.n BETWEEN b.a AND b.b GROUP BY b.key, b.run, b.a, b.b
  UNION ALL SELECT key, 2 * bars - 1, s, array_to_string(w[s + 1:s + {limit}], ' ')
    FROM (SELECT *, unnest(range(0, (greatest(len(w) - {limit}, 0) + {step - 1}) // {step} * {step} + 1, {step})) AS s FROM (SELECT *, regexp_extract_all(p, '\\S+') AS w FROM way WHERE way = 'windows'))),
budgeted AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY run, stop) - 1 AS k, content FROM pieces WHERE content <> '')"""


def _rows(title: str) -> str:
    """The last CTEs and the rows, from ``leaves(key, module, source_file, path, o1, o2, text, tk, plain, by_heading, source)``."""
    return f"""
found AS (SELECT l.*, NULL::BIGINT AS k, l.text AS content FROM leaves l WHERE plain
  UNION ALL SELECT l.*, b.k, b.content FROM leaves l JOIN budgeted b ON b.key = l.key WHERE NOT plain),
named AS (SELECT *, array_to_string(list_concat([module || '/' || regexp_replace(source_file, '[.]md$', '')], list_transform(path, lambda p: {slug('p')}), CASE WHEN k IS NULL THEN [] ELSE [k::VARCHAR] END), '/') AS id FROM found)
SELECT id, module, source_file, array_to_string(path, ' > ') AS section, md5(array_to_string(regexp_extract_all(content, '\\S+'), ' ')) AS content,
  CASE WHEN by_heading AND plain THEN len(path)::VARCHAR END AS heading_level, CASE WHEN NOT plain THEN path[-1] WHEN by_heading AND len(path) > 1 THEN path[-2] END AS parent_section,
  {title} AS doc_title, substr(sha256(source_file), 1, 12) AS file_id, false AS has_code, NULL::VARCHAR AS language, {words('content')}::INTEGER AS token_count,
  (row_number() OVER d - 1)::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY module, source_file))::INTEGER AS total_chunks, lag(id) OVER d AS prev_chunk_id, lead(id) OVER d AS next_chunk_id
FROM named WINDOW d AS (PARTITION BY module, source_file ORDER BY o1, o2, k)"""


_STEM = "upper(substr(source_file, 1, 1)) || regexp_replace(substr(source_file, 2), '[.]md$', '')"
_TITLE = f"coalesce(nullif(trim(regexp_extract(source, '(?m)^# (.+)', 1)), ''), {_STEM})"


def fixed(docs: str, limit: int, overlap: int) -> str:
    return f"""WITH RECURSIVE docs AS ({docs}), parts AS (SELECT module || source_file AS key, content AS text FROM docs),{_budget(limit, overlap)},
leaves AS (SELECT module || source_file AS key, module, source_file, []::VARCHAR[] AS path, 0 AS o1, 0 AS o2, content AS text, false AS plain, false AS by_heading, '' AS source FROM docs),{_rows(_STEM)}"""


def _split(lines: str, keys: str, text: str, level: int, name: str) -> str:
    """CTEs to ``name(keys, s, heading, content, heads)``: sections at headings of a level, 0 what stands before."""
    head = f"regexp_matches(line, '^#{{{level}}}\\s+.+$')"
    return f"""
{name}_lines AS (SELECT {keys}, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT {keys}, string_split({text}, chr(10)) AS l FROM {lines})),
{name}_at AS (SELECT *, sum(CASE WHEN {head} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY n) AS {name}_s FROM {name}_lines),
{name} AS (SELECT {keys}, {name}_s, min(CASE WHEN {head} THEN trim(regexp_extract(line, '^#+\\s+(.+)$', 1)) END) AS {name}_head, {strip('string_agg(line, chr(10) ORDER BY n)')} AS {name}_text FROM {name}_at GROUP BY {keys}, {name}_s)"""


def heading(docs: str, limit: int, overlap: int) -> str:
    """Sections of level 2; those over the limit by level 3 where that gives several, and what is over it still by budget."""
    path = "list_filter([sec_head, sub_head], lambda x: x IS NOT NULL)"
    return f"""WITH RECURSIVE docs AS ({docs}),{_split('docs', 'module, source_file', 'content', 2, 'sec')},
long AS (SELECT *, {words('sec_text')} > {limit} AS big FROM sec WHERE NOT ({orphan('sec_text')})),{_split('(SELECT * FROM long WHERE big)', 'module, source_file, sec_s', 'sec_text', 3, 'sub')},
several AS (SELECT module, source_file, sec_s FROM sub WHERE sub_s > 0 OR NOT ({orphan('sub_text')}) GROUP BY ALL HAVING count(*) > 1),
leaf AS (SELECT module, source_file, sec_s, 0 AS sub_s, sec_head, NULL::VARCHAR AS sub_head, sec_text AS text FROM long WHERE NOT big OR (module, source_file, sec_s) NOT IN (SELECT (module, source_file, sec_s) FROM several)
  UNION ALL SELECT module, source_file, sec_s, sub_s, sec_head, sub_head, sub_text FROM sub JOIN several USING (module, source_file, sec_s) JOIN (SELECT module, source_file, sec_s, sec_head FROM sec) USING (module, source_file, sec_s) WHERE NOT ({orphan('sub_text')})),
leaves AS (SELECT concat_ws(':', l.module, l.source_file, sec_s, sub_s) AS key, l.module, l.source_file, {path} AS path, sec_s AS o1, sub_s AS o2, text, {words('text')} <= {limit} AS plain, true AS by_heading, content AS source FROM leaf l JOIN docs USING (module, source_file)),
parts AS (SELECT key, text FROM leaves WHERE NOT plain),{_budget(limit, overlap)},{_rows(_TITLE)}"""


def definition(docs: str, limit: int, overlap: int) -> str:
    """Definitions under headings of level 3 or 4, or else those that open with bold words, packed to the limit; texts without any by budget."""
    bold = "^\\*\\*(.+?)\\*\\*[:\\s—–-]"
    return f"""WITH RECURSIVE docs AS ({docs}),{_split('docs', 'module, source_file', 'content', '3,4', 'h')},
enough AS (SELECT module, source_file FROM h WHERE h_s > 0 GROUP BY ALL HAVING count(*) > 1),
b_lines AS (SELECT module, source_file, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT *, string_split(content, chr(10)) AS l FROM docs ANTI JOIN enough USING (module, source_file))),
b_at AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{bold}') THEN 1 ELSE 0 END) OVER (PARTITION BY module, source_file ORDER BY n) AS s FROM b_lines),
defs AS (SELECT module, source_file, h_s AS s, h_head AS term, h_text AS block FROM h JOIN enough USING (module, source_file) WHERE h_s > 0
  UNION ALL SELECT module, source_file, s, min(CASE WHEN regexp_matches(line, '{bold}') THEN trim(regexp_extract(line, '{bold}', 1)) END), {strip('string_agg(line, chr(10) ORDER BY n)')} FROM b_at WHERE s > 0 GROUP BY module, source_file, s),
weighed AS (SELECT *, {words('block')} AS tk FROM defs),
packs AS (SELECT module, source_file, s, tk AS total, 0 AS g FROM weighed WHERE s = 1
  UNION ALL SELECT w.module, w.source_file, w.s, CASE WHEN p.total + w.tk > {limit} THEN w.tk ELSE p.total + w.tk END, CASE WHEN p.total + w.tk > {limit} THEN p.g + 1 ELSE p.g END
  FROM packs p JOIN weighed w ON w.module = p.module AND w.source_file = p.source_file AND w.s = p.s + 1),
groups AS (SELECT module, source_file, g, arg_min(term, s) AS term, string_agg(block, chr(10) || chr(10) ORDER BY s) AS text FROM packs JOIN weighed USING (module, source_file, s) GROUP BY module, source_file, g),
leaf AS (SELECT module, source_file, g, [term] AS path, text, {words('text')} <= {limit} AS plain FROM groups
  UNION ALL SELECT module, source_file, 0, []::VARCHAR[], content, false FROM docs ANTI JOIN defs USING (module, source_file)),
leaves AS (SELECT concat_ws(':', l.module, l.source_file, g) AS key, l.module, l.source_file, path, g AS o1, 0 AS o2, text, plain, false AS by_heading, content AS source FROM leaf l JOIN docs USING (module, source_file)),
parts AS (SELECT key, text FROM leaves WHERE NOT plain),{_budget(limit, overlap)},{_rows(_TITLE)}"""


def packed(docs: str, chosen: str, limit: int, overlap: int) -> str:
    """All strategies, each over the documents that ``chosen(module, source_file, strategy)`` gives it."""
    of = lambda name: f"SELECT d.* FROM ({docs}) d JOIN ({chosen}) c ON c.module = d.module AND c.source_file = d.source_file WHERE c.strategy = '{name}'"
    return "\nUNION ALL ".join(f"SELECT * FROM ({cut(of(cut.__name__), limit, overlap)})" for cut in (fixed, heading, definition))
