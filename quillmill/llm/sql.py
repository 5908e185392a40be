"""DuckDB SQL with the results of the operators, written on its own."""

from __future__ import annotations

from . import pii, warc


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def link_propagation(rules, link: str, damping: float, threshold: float) -> str:
    """The walk as a sum over its steps, until no host gets more than a trillionth from a step."""
    fits = lambda h, p: f"((host = {_q(h)} OR host LIKE {_q('%.' + h)}) AND starts_with(path, {_q('/' + p)}))"
    longest = sorted(rules, key=lambda r: -len(r[0]) - len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {_q(f'{h}/{p}')}" for h, p, _ in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {_q(v)}" for h, p, v in longest) + " END"
    return f"""
WITH RECURSIVE split AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
judged AS (SELECT page_id, host, path, html, {rule} AS rule, {ruled} AS ruled FROM split),
links AS (SELECT src, dst, count(*) AS n FROM
  (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, {_q(link)}, 2), lambda h: lower(h)))) AS dst FROM judged)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
every AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
edges AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM every),
hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM judged GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host, allowed / pages AS score FROM hosts WHERE allowed > 0 UNION ALL SELECT 'distrust', host, blocked / pages FROM hosts WHERE blocked > 0),
steps AS (SELECT 0 AS step, kind, host, score FROM seeds
  UNION ALL SELECT step + 1, r.kind, e.dst, sum(r.score * e.share * {damping}) FROM steps r JOIN edges e ON e.kind = r.kind AND e.src = r.host
  GROUP BY step, r.kind, e.dst HAVING sum(r.score * e.share * {damping}) > 1e-12),
scores AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM steps GROUP BY host)
SELECT page_id, j.host, path, rule,
  coalesce(ruled, CASE WHEN distrust >= {threshold} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores s ON s.host = j.host"""


# the same steps as the operator's, in patterns of their own
_MARKUP = (
    (r"<!--(?:.|\n)*?(?:-->|\z)", " "),
    (r"(?i)<(?:script|style)(?:|[\s/][^>]*)(?:\z|>(?:.|\n)*?(?:\z|</(?:script|style)\s*>))", " "),
    (r"(?i)<(?:/|)(?:address|article|aside|blockquote|body|br|d[dlt]|div|footer|form|h[1-6r]|head|header|html|li|main|nav|[ou]l|p|pre|section|table|t[dhr]|title)(?:|\s[^>]*)(?:>|/>|\z)", "\n"),
    (r"<(?:[a-z]|[A-Z]|[/!?])[^>]*(?:>|\z)", ""),
)


def warc_derivatives() -> str:
    # hexadecimal digits as a number, by Horner's rule
    hexadecimal = "list_reduce(list_prepend(0, list_transform(string_split(lower(regexp_extract(e, '^&#[xX](.*);$', 1)), ''), lambda c: strpos('0123456789abcdef', c) - 1)), lambda a, b: a * 16 + b)"
    number = f"CASE WHEN starts_with(lower(e), '&#x') THEN {hexadecimal} ELSE regexp_extract(e, '^&#([0-9]+);$', 1)::BIGINT END"
    char = f"coalesce(list_extract(map_extract(names, '#' || ({number})::VARCHAR), 1), CASE WHEN ({number}) BETWEEN 1 AND 55295 OR ({number}) BETWEEN 57344 AND 1114111 THEN chr(({number})::INTEGER) ELSE '\ufffd' END)"
    one = f"CASE WHEN starts_with(e, '&#') THEN {char} ELSE coalesce(list_extract(map_extract(names, e[2:-2]), 1), e) END"
    reference = "'&(?:#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6})|[A-Za-z][A-Za-z0-9]{1,31});'"
    names = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in warc.references().items()) + "}"
    decoded = f"array_to_string(list_transform(list_zip(string_split_regex(marked, {reference}), list_append(list_transform(regexp_extract_all(marked, {reference}), lambda e: {one}), '')), lambda z: z[1] || z[2]), '')"
    text = f"regexp_replace(regexp_replace(regexp_replace(CASE WHEN contains(marked, '&') THEN {decoded} ELSE marked END, '[ \\t\\r\\f' || chr(160) || ']+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    marked = "payload"
    for pattern, by in _MARKUP:
        marked = f"regexp_replace({marked}, {_q(pattern)}, {'chr(10)' if by == chr(10) else _q(by)}, 'g')"
    letter = lambda at, shift: f"substr('{warc.ALPHABET}', ((('0x' || substr(h, {at}, 5))::INTEGER >> {shift}) & 31) + 1, 1)"
    digest = lambda v: "'sha1:' || " + " || ".join(letter(at, s).replace("(h,", f"(sha1({v}),") for at in range(1, 41, 5) for s in (15, 10, 5, 0))
    uuid = lambda v: f"'<urn:uuid:' || substr(sha1({v}), 1, 8) || '-' || substr(sha1({v}), 9, 4) || '-5' || substr(sha1({v}), 14, 3) || '-a' || substr(sha1({v}), 18, 3) || '-' || substr(sha1({v}), 21, 12) || '>'"
    crlf = "chr(13) || chr(10)"
    return f"""
WITH base AS (
  SELECT page_id, url AS target_uri, '2024-01-01T00:00:00Z' AS date, coalesce(html, '') AS payload,
    {uuid("concat_ws('|', 'response', page_id::VARCHAR, coalesce(url, ''))")} AS refers_to FROM pages),
names AS (SELECT {names} AS names),
bare AS (SELECT *, {marked} AS marked FROM base, names),
parts AS (SELECT * EXCLUDE (names, marked), {text} AS text, {digest("payload")} AS source_digest,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload)::VARCHAR AS source_headers FROM bare),
records AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'source-digest: ' || source_digest || {crlf} || 'source-length: ' || strlen(payload)::VARCHAR || {crlf} || 'text-length: ' || strlen(text)::VARCHAR || {crlf}
      || 'source-headers: ' || regexp_replace(source_headers, '[\\r\\n]+', ' | ', 'g') || {crlf} AS block FROM parts
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM parts),
named AS (SELECT *, {uuid("concat_ws('|', record_type, refers_to)")} AS record_id, strlen(block)::BIGINT AS content_length, {digest("block")} AS block_digest FROM records)
SELECT page_id, record_type, record_id, refers_to, target_uri, date, source_headers, source_digest, content_type, content_length, block_digest,
  'WARC/1.1' || {crlf} || 'WARC-Type: ' || record_type || {crlf} || 'WARC-Record-ID: ' || record_id || {crlf} || 'WARC-Refers-To: ' || refers_to
    || coalesce({crlf} || 'WARC-Target-URI: ' || replace(replace(target_uri, chr(13), '%0D'), chr(10), '%0A'), '') || {crlf} || 'WARC-Date: ' || date || {crlf} || 'WARC-Block-Digest: ' || block_digest
    || {crlf} || 'WARC-Source-Payload-Digest: ' || source_digest || {crlf} || 'Content-Type: ' || content_type || {crlf} || 'Content-Length: ' || content_length::VARCHAR
    || {crlf} || {crlf} AS header, block
FROM named"""


def mixing(weights, share: float, epochs: int, seed: int) -> str:
    case = lambda level: "CASE " + " ".join(f"WHEN {level} = {_q(k)} THEN {w}" for k, w in weights[level].items()) + " ELSE 1 END" if weights.get(level) else "1"
    names = ["domain", "lang", "source"]
    ctes, given = [], f"(SELECT floor(sum(tokens) * {share}) FROM docs)"
    for depth in range(1, 4):
        here, parent = names[:depth], names[: depth - 1]
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        last = here[-1]
        source = f"SELECT {', '.join(here)}, sum(tokens) * {epochs} AS supply, {case(last)} AS weight FROM docs GROUP BY {', '.join(here)}"
        above = f"SELECT a.*, p.given AS budget FROM ({source}) a JOIN f{depth - 1} p USING ({', '.join(parent)})" if parent else f"SELECT a.*, {given} AS budget FROM ({source}) a"
        ctes.append(f"""
s{depth} AS (SELECT *, greatest(budget - coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::DOUBLE
    / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
  FROM ({above}) WINDOW w AS ({by} ORDER BY supply::DOUBLE / weight, {last})),
f{depth} AS (SELECT {', '.join(here)}, CASE WHEN supply <= weight * share THEN supply
    ELSE floor(weight * max(CASE WHEN supply > weight * share THEN share END) OVER ({by})) END::BIGINT AS given FROM s{depth})""")
    return f"""
WITH docs AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS tokens, md5(coalesce(text, '')) AS text,
    'd' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 4)::VARCHAR AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
{','.join(ctes)},
plan AS (SELECT f.*, t.tokens AS leaf_tokens, CASE WHEN t.tokens > 0 THEN given // t.tokens ELSE 0 END AS whole
  FROM f3 f JOIN (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL) t USING (domain, lang, source)),
ordered AS (SELECT d.*, whole, given - whole * leaf_tokens AS rest,
    sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{seed}', (whole + 1)::VARCHAR, coalesce(doc_id::VARCHAR, ''))), text RANGE UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN plan USING (domain, lang, source))
SELECT doc_id, unnest(range(1, whole + 1))::BIGINT AS epoch, tokens, domain, lang, source FROM ordered
UNION ALL SELECT doc_id, (whole + 1)::BIGINT, tokens, domain, lang, source FROM ordered WHERE upto <= rest"""


_USABLE = """usable AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


def nearest(k: int) -> str:
    return f"""
WITH {_USABLE},
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def embedding_duplicates(threshold: float) -> str:
    return f"""
WITH RECURSIVE {_USABLE},
unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM usable),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= {threshold}),
reach(id, other) AS (SELECT vec_id, vec_id FROM unit UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
parts AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) e LEFT JOIN parts p ON p.id = e.vec_id LEFT JOIN degree d ON d.id = e.vec_id"""


def personal_data() -> str:
    grouped = "|".join(f"{c}[0-9]{{2}}" + "[ -][A-Z0-9]{4}" * ((n - 4) // 4) + (f"[ -][A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, cs in pii.LENGTHS.items() for c in cs.split())
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": rf"\b(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{grouped})\b",
        "secret": r"""\b(?:A[KS]IA[A-Z0-9]{16}\b|(?i:password|passwd|secret|token|api_key|api-key|apikey) {0,2}[:=] {0,2}["']?[A-Za-z0-9+/_.~!@#$%^&*=-]{8,})""",
    }
    octet = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (substr(reverse({digits}), i, 1)::INTEGER * 2) // 10 + (substr(reverse({digits}), i, 1)::INTEGER * 2) % 10 ELSE substr(reverse({digits}), i, 1)::INTEGER END)) % 10 = 0"
    whole = "regexp_replace(v, '[ -]', '', 'g')"
    turned = f"concat(substr({whole}, 5), substr({whole}, 1, 4))"
    spelled = f"array_to_string(list_transform(range(1, length({turned}) + 1), lambda i: CASE WHEN substr({turned}, i, 1) BETWEEN '0' AND '9' THEN substr({turned}, i, 1) ELSE (ascii(substr({turned}, i, 1)) - 55)::VARCHAR END), '')"
    mod97 = f"list_reduce(list_transform(range(1, length({spelled}) + 1), lambda i: substr({spelled}, i, 1)::INTEGER), lambda a, b: (a * 10 + b) % 97) = 1"
    valid = {
        "email": "true",
        "ip": f"regexp_matches(v, '^{octet}([.]{octet}){{3}}$')",
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": mod97,
        "secret": "starts_with(v, 'AKIA') OR starts_with(v, 'ASIA') OR regexp_matches(v, '[0-9]')",
    }
    parts = []
    for k, (kind, p) in enumerate(patterns.items()):
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {k} AS ord, m[i] AS v, lower(right(g[i], 40)) AS before, lower(left(g[i + 1], 40)) AS after,
      list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, {_q(p)}) AS m, string_split_regex(t, {_q(p)}) AS g FROM d WHERE regexp_matches(t, {_q(p)})))""")
    check = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in valid.items()) + " END"
    near = lambda side, words: f"regexp_matches({side}, '(^|[^a-z])({words})')"
    raised = "CASE kind " + " ".join(f"WHEN '{k}' THEN {near('before', w)} OR {near('after', w)}" for k, w in pii.CONTEXT.items()) + " END"
    score = f"{pii.START} + CASE WHEN {raised} THEN {pii.RAISE} ELSE 0 END - CASE WHEN {near('before', pii.AGAINST)} THEN {pii.LOWER} ELSE 0 END"
    joined = lambda cond: f"coalesce(string_agg(concat_ws(':', kind, start, start + length(v)), ',' ORDER BY ord, start) FILTER ({cond}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in pii.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
proposed AS ({" UNION ALL ".join(parts)}),
kept AS (SELECT * FROM (SELECT *, {score} AS score FROM proposed WHERE {check}) WHERE ord < 4 OR score >= 50)
SELECT d.doc_id, {counts}, sha256({joined("ord < 4")}) AS base_sha256, {joined("kind IS NOT NULL")} AS spans, coalesce(string_agg(score::INTEGER::VARCHAR, ',' ORDER BY ord, start), '') AS scores
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id"""
