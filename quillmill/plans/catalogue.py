"""The queries by name, each over whole tables, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..operators import chunk, fold, infer, layout, retrieve, segment, state
from ..sources import files, render
from ..streaming import incremental
from . import chunk_sql, corpora
from .corpora import SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = r"\S+"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{WORDS}'))::BIGINT"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


# --- counts and splits -------------------------------------------------------------


@query(f"SELECT doc_id, {_count('text')} AS tokens FROM documents")
def doc_token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", K.count_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT doc_id, unnest(range(len(l)))::INTEGER AS ord, md5(unnest(l)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def line_segments(spark, sf_dir):
    return segment.lines(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "ord", F.md5("line").alias("line"))


@query(r"""SELECT doc_id, unnest(range(len(l)))::INTEGER AS ord, md5(unnest(l)) AS sentence
FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\s\x{1c}-\x{1f}\x{85}\x{a0}]+', '\1' || chr(30), 'g'), chr(30)) AS l FROM documents)""")
def sentence_segments(spark, sf_dir):
    return segment.sentences(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "ord", F.md5("sentence").alias("sentence"))


@query(f"""WITH parts AS (SELECT file_ord, unnest(list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')) AS p FROM ({SQL['books']}))
SELECT file_ord, count(*) AS paragraphs, sum(length(p))::BIGINT AS chars FROM parts GROUP BY file_ord""")
def paragraph_segments(spark, sf_dir):
    parts = segment.paragraphs(corpora.books(spark, sf_dir), "content")
    return parts.groupBy("file_ord").agg(F.count("*").alias("paragraphs"), F.sum(F.length("paragraph")).alias("chars"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{WORDS}') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, (greatest(len(w) - 500, 0) + 449) // 450 * 450 + 1, 450)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, start::INTEGER AS start_token, len(w[start + 1:start + 500])::INTEGER AS token_count, md5(array_to_string(w[start + 1:start + 500], ' ')) AS words FROM s""")
def token_windows(spark, sf_dir):
    found = segment.token_windows(_docs(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "start_token", "token_count", F.md5(F.array_join(F.regexp_extract_all("window", F.lit(f"({WORDS})"), F.lit(1)), " ")).alias("words"))


@query(r"""WITH d AS (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS n, list_transform(string_split(text, chr(10)), lambda l: len(regexp_extract_all(l, '\S+'))) AS lines,
  list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda l: len(regexp_extract_all(l, '\S+'))) AS sents FROM documents)
SELECT doc_id, CASE WHEN n <= 500 THEN 'whole' WHEN len(list_filter(lines, lambda k: k > 0)) > 1 AND list_max(lines) <= 500 THEN 'lines'
  WHEN len(list_filter(sents, lambda k: k > 0)) > 1 AND list_max(sents) <= 500 THEN 'sentences' ELSE 'windows' END AS how FROM d""")
def oversize_split_choice(spark, sf_dir):
    sizes = lambda parts: F.transform(parts, lambda x: K.count_tokens(x))
    d = _docs(spark, sf_dir).select("doc_id", K.count_tokens(F.col("text")).alias("n"), sizes(F.split("text", "\n", -1)).alias("lines"), sizes(F.split("text", segment.SENTENCE, -1)).alias("sents"))
    fits = lambda c: (F.size(F.filter(c, lambda k: k > 0)) > 1) & (F.array_max(c) <= 500)
    return d.select("doc_id", F.when(F.col("n") <= 500, "whole").when(fits("lines"), "lines").when(fits("sents"), "sentences").otherwise("windows").alias("how"))


# --- greedy packing ------------------------------------------------------------------

_LINES = "lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), sized AS (SELECT *, len(regexp_extract_all(line, '\\S+')) AS tk FROM lines)"


@query(f"""WITH RECURSIVE {_LINES},
fold AS (SELECT doc_id, n, tk AS total, 0 AS g FROM sized WHERE n = 1
  UNION ALL SELECT s.doc_id, s.n, CASE WHEN f.total + s.tk > 100 THEN s.tk ELSE f.total + s.tk END, CASE WHEN f.total + s.tk > 100 THEN f.g + 1 ELSE f.g END
  FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.n = f.n + 1),
chunks AS (SELECT doc_id, g, max(total) AS tokens FROM fold GROUP BY ALL)
SELECT doc_id, g::INTEGER AS chunk_index, tokens::BIGINT AS token_count, count(*) OVER d AS total_chunks, 'doc' || doc_id || '/' || g AS id,
  lag('doc' || doc_id || '/' || g) OVER (d ORDER BY g) AS prev_chunk_id, lead('doc' || doc_id || '/' || g) OVER (d ORDER BY g) AS next_chunk_id
FROM chunks WINDOW d AS (PARTITION BY doc_id)""")
def greedy_line_chunks(spark, sf_dir):
    """Lines of each document packed to 100 tokens, with ids and neighbours; no shuffle."""
    sizes = F.transform(F.split("text", "\n", -1), lambda x: K.count_tokens(x))
    d = _docs(spark, sf_dir).select("doc_id", fold.group_sums(sizes, 100).alias("sums"))
    each = d.select("doc_id", F.size("sums").alias("total"), F.posexplode("sums").alias("chunk_index", "token_count"))
    name = lambda k: F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("/"), k.cast("string"))
    k = F.col("chunk_index")
    return each.select("doc_id", "chunk_index", "token_count", F.col("total").cast("long").alias("total_chunks"), name(k).alias("id"),
                       F.when(k > 0, name(k - 1)).alias("prev_chunk_id"), F.when(k + 1 < F.col("total"), name(k + 1)).alias("next_chunk_id"))


_OVERLAP = f"""WITH RECURSIVE {_LINES},
cum AS (SELECT *, sum(tk) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM sized),
fold AS (SELECT doc_id, n, 1::BIGINT AS start, NULL::BIGINT AS closed FROM cum WHERE n = 1
  UNION ALL SELECT c.doc_id, c.n, CASE WHEN c.upto - (s.upto - s.tk) > 100 THEN
      coalesce((SELECT min(z.n) FROM cum z WHERE z.doc_id = c.doc_id AND z.n >= f.start AND z.n < c.n AND (c.upto - c.tk) - (z.upto - z.tk) <= 20), c.n) ELSE f.start END,
    CASE WHEN c.upto - (s.upto - s.tk) > 100 THEN f.start END
  FROM fold f JOIN cum c ON c.doc_id = f.doc_id AND c.n = f.n + 1 JOIN cum s ON s.doc_id = f.doc_id AND s.n = f.start),
bounds AS (SELECT doc_id, closed AS a, n - 1 AS b FROM fold WHERE closed IS NOT NULL
  UNION ALL SELECT doc_id, start, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM fold) WHERE r = 1)
SELECT b.doc_id, (row_number() OVER (PARTITION BY b.doc_id ORDER BY b.b) - 1)::INTEGER AS chunk_index, (b.a - 1)::INTEGER AS first_line, b.b::INTEGER AS end_line, (y.upto - x.upto + x.tk)::BIGINT AS token_count
FROM bounds b JOIN cum x ON x.doc_id = b.doc_id AND x.n = b.a JOIN cum y ON y.doc_id = b.doc_id AND y.n = b.b"""


@query(_OVERLAP)
def fixed_overlap_chunks(spark, sf_dir):
    """Lines packed to 100 tokens with an overlap of 20, by the fold that the chunkers use."""
    @F.pandas_udf("array<struct<a:int,b:int,t:long>>")
    def packed(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: [(int(a), int(b), int(sum(s[a:b]))) for a, b in fold.ranges(list(s), 100, 20)])

    d = _docs(spark, sf_dir).select("doc_id", packed(F.transform(F.split("text", "\n", -1), lambda x: K.count_tokens(x))).alias("r"))
    return d.select("doc_id", F.posexplode("r").alias("chunk_index", "r")).select("doc_id", "chunk_index", F.col("r.a").alias("first_line"), F.col("r.b").alias("end_line"), F.col("r.t").alias("token_count"))


@query(f"SELECT count(*) AS chunks, max(token_count) AS max_tokens, min(token_count) AS min_tokens, count(*) FILTER (token_count < 30) AS small_chunks FROM ({_OVERLAP})")
def chunk_stats(spark, sf_dir):
    return infer.chunk_statistics(fixed_overlap_chunks(spark, sf_dir))


# --- headings and definitions ---------------------------------------------------------

def _sections(corpus: str, level: str) -> str:
    head = f"regexp_matches(line, '^#{{{level}}}\\s+.+$')"
    return f"""lines AS (SELECT file_ord, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT file_ord, string_split(content, chr(10)) AS l FROM ({SQL[corpus]}))),
numbered AS (SELECT *, sum(CASE WHEN {head} THEN 1 ELSE 0 END) OVER (PARTITION BY file_ord ORDER BY n) AS s FROM lines),
sections AS (SELECT file_ord, s, min(CASE WHEN {head} THEN trim(regexp_extract(line, '^#+\\s+(.+)$', 1)) END) AS heading,
  regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\\s+|\\s+$', '', 'g') AS content FROM numbered GROUP BY ALL)"""


_ORPHAN = r"""len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^#{1,6}\s+\S'))) = 0"""


@query(f"WITH {_sections('books', '2')} SELECT file_ord, (row_number() OVER (PARTITION BY file_ord ORDER BY s) - 1)::INTEGER AS ord, heading, md5(content) AS content FROM sections WHERE s > 0 OR NOT {_ORPHAN}")
def heading_sections(spark, sf_dir):
    return _hashed(segment.heading_sections(corpora.books(spark, sf_dir).withColumnRenamed("content", "text")))


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("file_ord", "ord", "heading", F.md5("content").alias("content"))


@query(f"WITH {_sections('books', '2')} SELECT file_ord, {_ORPHAN} AS orphan FROM sections WHERE s = 0")
def orphan_preambles(spark, sf_dir):
    before = F.get(F.split("content", r"(?md)(?=^#{2}\s+.+$)", -1), F.lit(0))
    return corpora.books(spark, sf_dir).select("file_ord", T.is_orphan(before).alias("orphan"))


@query(f"WITH {_sections('talks', '3,4')} SELECT file_ord, (row_number() OVER (PARTITION BY file_ord ORDER BY s) - 1)::INTEGER AS ord, heading AS term, md5(content) AS block FROM sections WHERE s > 0")
def heading_definitions(spark, sf_dir):
    return segment.heading_definitions(corpora.talks(spark, sf_dir), "content").select("file_ord", "ord", "term", F.md5("block").alias("block"))


_BOLD = f"""lines AS (SELECT file_ord, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT file_ord, string_split(content, chr(10)) AS l FROM ({SQL['glossary']}))),
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\*\\*(.+?)\\*\\*[:\\s—–-]') THEN 1 ELSE 0 END) OVER (PARTITION BY file_ord ORDER BY n) AS s FROM lines),
defs AS (SELECT file_ord, (s - 1)::BIGINT AS ord, min(CASE WHEN regexp_matches(line, '^\\*\\*(.+?)\\*\\*[:\\s—–-]') THEN regexp_extract(line, '^\\*\\*(.+?)\\*\\*', 1) END) AS term,
  regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\\s+|\\s+$', '', 'g') AS block FROM numbered WHERE s > 0 GROUP BY file_ord, s)"""


@query(f"WITH {_BOLD} SELECT file_ord, ord, term, md5(block) AS block FROM defs")
def bold_definitions(spark, sf_dir):
    found = segment.bold_definitions(corpora.glossary(spark, sf_dir), ["file_ord"], "content")
    return found.select("file_ord", F.col("ord").cast("long").alias("ord"), "term", F.md5("block").alias("block"))


@query(f"""WITH RECURSIVE {_BOLD}, sized AS (SELECT file_ord, ord, term, {_count('block')} AS tk FROM defs),
fold AS (SELECT file_ord, ord, tk AS total, 0 AS g FROM sized WHERE ord = 0
  UNION ALL SELECT s.file_ord, s.ord, CASE WHEN f.total + s.tk > 60 THEN s.tk ELSE f.total + s.tk END, CASE WHEN f.total + s.tk > 60 THEN f.g + 1 ELSE f.g END
  FROM fold f JOIN sized s ON s.file_ord = f.file_ord AND s.ord = f.ord + 1)
SELECT file_ord, g::INTEGER AS chunk_index, arg_min(term, ord) AS term, count(*) AS definitions, max(total)::BIGINT AS tokens FROM fold JOIN sized USING (file_ord, ord) GROUP BY file_ord, g""")
def definition_groups(spark, sf_dir):
    defs = segment.bold_definitions(corpora.glossary(spark, sf_dir), ["file_ord"], "content").withColumn("tk", K.count_tokens(F.col("block")))
    ordered = defs.groupBy("file_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "term", "tk"))).alias("d"))
    zipped = F.arrays_zip(F.col("d"), fold.group_numbers(F.transform("d", lambda x: x.tk), 60).alias("g"))
    each = ordered.select("file_ord", F.explode(zipped).alias("z")).select("file_ord", F.col("z.g").alias("chunk_index"), "z.d.*")
    return each.groupBy("file_ord", "chunk_index").agg(F.min_by("term", "ord").alias("term"), F.count("*").alias("definitions"), F.sum("tk").cast("long").alias("tokens"))


def _rows(chunks: DataFrame) -> DataFrame:
    """Chunks with a hash of their words for their content."""
    m = "metadata."
    content = F.md5(F.array_join(F.regexp_extract_all("content", F.lit(f"({WORDS})"), F.lit(1)), " "))
    return chunks.select(
        "id", "module", "source_file", F.array_join("section_path", " > ").alias("section"), content.alias("content"),
        F.col(m + "heading_level").cast("string").alias("heading_level"), *[F.col(m + c).alias(c) for c in ("parent_section", "doc_title", "file_id", "has_code", "language", "token_count", "chunk_index", "total_chunks", "prev_chunk_id", "next_chunk_id")])


@query(chunk_sql.fixed(SQL["plain"], 500, 50))
def fixed_chunks(spark, sf_dir):
    """Documents by a budget of 500 tokens with an overlap of 50."""
    return _rows(chunk.chunk(corpora.plain(spark, sf_dir)))


@query(chunk_sql.heading(SQL["books"], 500, 50))
def heading_chunks(spark, sf_dir):
    """Books by their sections, those over 500 tokens cut further."""
    return _rows(chunk.chunk(corpora.books(spark, sf_dir).withColumn("strategy", F.lit("heading"))))


@query(chunk_sql.heading(SQL["volumes"], 120, 20))
def nested_heading_chunks(spark, sf_dir):
    """Volumes of talks: sections over 120 tokens by their turns, and turns over it by budget."""
    return _rows(chunk.chunk(corpora.volumes(spark, sf_dir).withColumn("strategy", F.lit("heading")), limit=120, overlap=20))


@query(chunk_sql.definition(f"{SQL['glossary']} UNION ALL {SQL['talks']}", 12, 3))
def definition_chunks(spark, sf_dir):
    """Bold definitions and turns of talks, packed to 12 tokens, longer ones by budget."""
    docs = corpora.glossary(spark, sf_dir).unionByName(corpora.talks(spark, sf_dir))
    return _rows(chunk.chunk(docs.withColumn("strategy", F.lit("definition")), limit=12, overlap=3))


_ALL = f"SELECT * FROM ({SQL['plain']}) UNION ALL SELECT * FROM ({SQL['books']}) UNION ALL SELECT * FROM ({SQL['talks']}) UNION ALL SELECT * FROM ({SQL['glossary']})"
_CHOSEN = f"""SELECT module, source_file, file_ord, CASE WHEN n <= 500 THEN 'fixed' WHEN bold >= 3 AND bold > h2 THEN 'definition' WHEN h34 >= 3 AND h34 > 2 * h2 THEN 'definition' WHEN h2 >= 2 THEN 'heading' ELSE 'fixed' END AS strategy
FROM (SELECT *, {_count('content')} AS n, len(regexp_extract_all(content, '(?m)^## .+')) AS h2, len(regexp_extract_all(content, '(?m)^#{{3,4}} .+')) AS h34, len(regexp_extract_all(content, '\\*\\*[^*]+\\*\\*\\s*[:—–-]')) AS bold FROM ({_ALL}))"""


@query(chunk_sql.packed(_ALL, _CHOSEN, 500, 50))
def packed_chunks(spark, sf_dir):
    """All corpora by the strategy each text calls for, 500 tokens with an overlap of 50."""
    docs = corpora.books(spark, sf_dir).unionByName(corpora.talks(spark, sf_dir)).unionByName(corpora.glossary(spark, sf_dir)).unionByName(corpora.plain(spark, sf_dir))
    return _rows(chunk.chunk(docs.withColumn("strategy", infer.strategy_of("content"))))


# --- names, titles, code ---------------------------------------------------------------


@query(f"""SELECT p_partkey, {chunk_sql.slug("p_name || ' - ' || p_type")} AS slug,
  regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(trim(p_name || ' - ' || p_type), '[\\s_]+', '-', 'g'), '[^\\pL\\pN_-]', '', 'g'), '-{{2,}}', '-', 'g')), '^-+|-+$', '', 'g') AS kebab FROM part""")
def slug_kebab(spark, sf_dir):
    name = F.concat("p_name", F.lit(" - "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(name).alias("slug"), T.kebab(name).alias("kebab"))


@query("""SELECT doc_id, 'Doc ' || doc_id || ' ' || upper(substr(source, 1, 1)) || substr(source, 2) AS title, substr(sha256('content/doc-' || doc_id || '_' || source || '.md'), 1, 12) AS file_id FROM documents""")
def doc_titles(spark, sf_dir):
    path = F.concat(F.lit("content/doc-"), F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), F.lit(".md"))
    return _docs(spark, sf_dir).select("doc_id", T.title_of_path(path).alias("title"), T.file_id(path).alias("file_id"))


_FENCED = "p_name || chr(10) || '```' || CASE WHEN p_size % 3 = 0 THEN 'python x' WHEN p_size % 3 = 1 THEN '' ELSE 'C++' END || chr(10) || p_type || chr(10) || CASE WHEN p_size % 5 = 0 THEN '' ELSE '```' END"


@query(f"""SELECT p_partkey, n >= 2 AND n % 2 = 0 AS has_code, CASE WHEN n >= 2 AND n % 2 = 0 THEN nullif(regexp_extract(lower(trim(f[1])), '^(\\S+)', 1), '') END AS language
FROM (SELECT p_partkey, regexp_extract_all(t, '(?m)^```(.*)$', 1) AS f, len(regexp_extract_all(t, '(?m)^```(.*)$', 1)) AS n FROM (SELECT p_partkey, {_FENCED} AS t FROM part))""")
def code_detection(spark, sf_dir):
    size = F.col("p_size")
    t = F.concat(F.col("p_name"), F.lit("\n```"), F.when(size % 3 == 0, "python x").when(size % 3 == 1, "").otherwise("C++"), F.lit("\n"), F.col("p_type"), F.lit("\n"), F.when(size % 5 == 0, "").otherwise("```"))
    return table(spark, sf_dir, "part").select("p_partkey", T.has_code(t).alias("has_code"), T.code_language(t).alias("language"))


# --- inference ---------------------------------------------------------------------------


def _chosen(spark, sf_dir) -> DataFrame:
    docs = corpora.plain(spark, sf_dir).unionByName(corpora.books(spark, sf_dir)).unionByName(corpora.talks(spark, sf_dir)).unionByName(corpora.glossary(spark, sf_dir))
    return docs.select("module", "source_file", "file_ord", infer.strategy_of("content").alias("strategy"))


@query(f"SELECT module, source_file, strategy FROM ({_CHOSEN})")
def strategy_selection(spark, sf_dir):
    return _chosen(spark, sf_dir).select("module", "source_file", "strategy")


@query(f"SELECT module, strategy FROM (SELECT module, strategy, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC, min(file_ord)) AS r FROM ({_CHOSEN}) GROUP BY module, strategy) WHERE r = 1")
def majority_strategy(spark, sf_dir):
    return infer.majority_strategy(_chosen(spark, sf_dir), ["module"])


_TERMS = """terms AS (SELECT DISTINCT file_ord, w FROM (SELECT file_ord, unnest(regexp_extract_all(lower(h), '[a-z][a-z0-9]*')) AS w FROM (
  SELECT file_ord, unnest(list_concat(regexp_extract_all(content, '(?m)^#{1,3} (.+)', 1), regexp_extract_all(content, '\\*\\*([^*]+)\\*\\*', 1))) AS h FROM (CORPUS)))
  WHERE length(w) >= 3 AND w NOT IN (STOP))""".replace("STOP", ", ".join(f"'{w}'" for w in T.STOP_WORDS))


@query(f"WITH {_TERMS.replace('CORPUS', SQL['talks'])} SELECT w AS term, count(*) AS docs FROM terms GROUP BY w")
def doc_frequency(spark, sf_dir):
    return infer.document_frequency(corpora.talks(spark, sf_dir))


@query(f"WITH {_TERMS.replace('CORPUS', SQL['glossary'])} SELECT w AS term, count(*) AS docs FROM terms GROUP BY w HAVING count(*) >= 2 ORDER BY count(*) DESC, w LIMIT 5")
def top_tags(spark, sf_dir):
    return infer.document_frequency(corpora.glossary(spark, sf_dir)).where("docs >= 2").orderBy(F.desc("docs"), "term").limit(5)


@query(f"SELECT coalesce(arg_min(h, file_ord), 'Context module packed from books') AS description FROM (SELECT file_ord, trim(regexp_extract(content, '(?m)^# (.+)', 1)) AS h FROM ({SQL['books']})) WHERE h <> '' AND NOT (length(h) >= 20 AND NOT contains(h, ' '))")
def module_description(spark, sf_dir):
    return infer.description(corpora.books(spark, sf_dir), "Context module packed from books")


# --- state --------------------------------------------------------------------------------

_FILES = "SELECT source AS module, 'doc' || doc_id || '.md' AS rel_path, text AS content FROM documents"
_HASHES = f"SELECT module, sha256(string_agg(sha256(concat(rel_path, chr(0), content)), '' ORDER BY rel_path)) AS source_hash FROM ({_FILES}) GROUP BY module"


def _files(spark, sf_dir) -> DataFrame:
    return corpora.plain(spark, sf_dir).select("module", F.col("source_file").alias("rel_path"), "content")


@query(_HASHES)
def module_hash(spark, sf_dir):
    return state.module_hashes(_files(spark, sf_dir))


@query(f"SELECT h.module, h.source_hash FROM ({_HASHES}) h WHERE NOT (ascii(substr(h.source_hash, 1, 1)) % 2 = 0)")
def stale_modules(spark, sf_dir):
    """Every module whose hash's first digit is even has been recorded."""
    hashes = state.module_hashes(_files(spark, sf_dir))
    meta = hashes.where(F.ascii(F.substring("source_hash", 1, 1)) % 2 == 0)
    return state.stale(hashes, meta).select("module", "source_hash")


@query("""SELECT s_name AS module, p::INTEGER AS pos, d AS dependency FROM (SELECT s_name, unnest([0, 1]) AS p, unnest(['supplier-' || (s_suppkey * 7 % 1300) || '@1.0', 'Part-' || s_nationkey]) AS d FROM supplier)
WHERE NOT EXISTS (SELECT 1 FROM supplier x WHERE 'supplier-' || x.s_suppkey = regexp_extract(d, '^([a-zA-Z0-9_-]+)', 1))""")
def unmet_deps(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    asks = F.array(F.concat(F.lit("supplier-"), (F.col("s_suppkey") * 7 % 1300).cast("string"), F.lit("@1.0")), F.concat(F.lit("Part-"), F.col("s_nationkey").cast("string")))
    return state.unmet_dependencies(s.select(F.col("s_name").alias("module"), asks.alias("depends_on")), s.select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("module")))


_ASKED = "SELECT doc_id, source, text, CASE WHEN bool_or(doc_id % 3 = 0) OVER (PARTITION BY source, text) THEN 'About ' ELSE 'New in ' END || source AS context FROM documents"


def _contexts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A third of the contexts are in the cache, found by hash; the others are asked for."""
    d = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("document"), F.col("text").alias("content"))
    cache = d.where("doc_id % 3 = 0").select(T.cache_key(F.lit("m"), "document", "content").alias("key"), F.concat(F.lit("About "), F.col("document")).alias("context"), F.lit("m").alias("model"))
    return state.contextualize(d, cache.dropDuplicates(["key"]), "m", lambda document, content: f"New in {document}")


@query(f"SELECT doc_id, true AS contextualized, md5(context || chr(10) || chr(10) || text) AS content, len(regexp_extract_all(context || chr(10) || chr(10) || text, '\\S+'))::INTEGER AS token_count FROM ({_ASKED})")
def context_cache_join(spark, sf_dir):
    return _contexts(spark, sf_dir)[0].select("doc_id", "contextualized", F.md5("content").alias("content"), "token_count")


@query(f"SELECT DISTINCT sha256('m' || chr(0) || source || chr(0) || text) AS key, context, 'm' AS model FROM ({_ASKED}) WHERE starts_with(context, 'New')")
def context_cache_misses(spark, sf_dir):
    """What was asked for, to be stored."""
    return _contexts(spark, sf_dir)[1]


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0) OR (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 = 0)""")
def changed_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    old = d.where("id % 7 != 0")
    new = d.where("id % 5 != 0").withColumn("content", F.when(F.col("id") % 11 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    return retrieve.changes(old, new)


# --- retrieval ------------------------------------------------------------------------------


@query("SELECT conv_id, turn, md5(string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS around FROM conversations")
def neighbour_window(spark, sf_dir):
    return retrieve.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", F.md5("around").alias("around"))


@query("SELECT conv_id, turn, r::INTEGER AS rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r <= 2")
def diversified_topk(spark, sf_dir):
    return retrieve.diversified(table(spark, sf_dir, "conversations"), "conv_id", F.length("text"), 2, "turn").select("conv_id", "turn", "rank")


@query("SELECT module, file_ord, content FROM (SELECT source AS module, doc_id AS file_ord, substr(text, 1, 500) AS content FROM documents WHERE contains(lower(text), 'tion the') ORDER BY source, doc_id LIMIT 5)")
def substring_search(spark, sf_dir):
    return retrieve.search(corpora.plain(spark, sf_dir), "tion THE", order=["module", "file_ord"]).select("module", "file_ord", "content")


@query("SELECT doc_id AS file_ord, substr(text, 1, 300) AS content FROM documents WHERE contains(lower(text), 'tion') AND source = 'src3'")
def module_search(spark, sf_dir):
    return retrieve.search(corpora.plain(spark, sf_dir), "tion", order=["file_ord"], most=None, cut=300, module="src3").select("file_ord", "content")


# --- extraction -----------------------------------------------------------------------------

_PATHS = "SELECT page_id, url, 'in/' || CASE WHEN page_id % 9 = 0 THEN '.cache/' WHEN page_id % 8 = 0 THEN '_old/' ELSE 'a.b/' END || CASE WHEN page_id % 7 = 0 THEN '~$' ELSE 'f' END || page_id || ['.MD', '.txt', '.pdf', '.doc', '.htm', '.yml', '.tmp', '', '.docm', '.boxnote', '.py~'][page_id % 11 + 1] AS p FROM pages"


@query(f"""SELECT page_id, regexp_matches(p, '(^|/)[._]') AS hidden, regexp_matches(b, '^~\\$|^[.]_|^[.]DS_Store$|[.](tmp|swp|swo)$|~$') AS temporary,
  coalesce(map {{'md': 'markdown', 'txt': 'plaintext', 'pdf': 'pdf', 'htm': 'html', 'yml': 'structured', 'docm': 'docx', 'boxnote': 'boxnote'}}[lower(regexp_extract(b, '^.+[.]([^.]+)$', 1))], 'unsupported') AS classification,
  replace(regexp_replace(p, '([^/])[.][^./]*$', '\\1'), '/', '__') || '.md' AS flat,
  substr(coalesce(nullif(regexp_replace(regexp_replace(s, '[^\\pL\\pN_.-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'page'), 1, 80) AS stem
FROM (SELECT *, string_split(p, '/')[-1] AS b, coalesce(nullif(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '/')[-1], ''), regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS s FROM ({_PATHS}))""")
def classify_paths(spark, sf_dir):
    n = F.col("page_id")
    ends = F.array(*map(F.lit, [".MD", ".txt", ".pdf", ".doc", ".htm", ".yml", ".tmp", "", ".docm", ".boxnote", ".py~"]))
    p = F.concat(F.lit("in/"), F.when(n % 9 == 0, ".cache/").when(n % 8 == 0, "_old/").otherwise("a.b/"), F.when(n % 7 == 0, "~$").otherwise("f"), n.cast("string"), F.get(ends, (n % 11).cast("int")))
    d = table(spark, sf_dir, "pages").select("page_id", "url", p.alias("p"))
    return d.select("page_id", files.is_hidden("p").alias("hidden"), files.is_temporary("p").alias("temporary"), files.classify("p").alias("classification"), files.flat_name("p").alias("flat"), T.url_stem("url").alias("stem"))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '---' || chr(10) || 'title: x' || chr(10) || text ELSE text END) AS body FROM documents""")
def frontmatter_strip(spark, sf_dir):
    """Closed blocks go, unclosed ones and texts without one stay."""
    t, n = F.col("text"), F.col("doc_id")
    made = F.when(n % 3 == 0, F.concat(F.lit("---\ntags: [a]\n---\n\n"), t)).when(n % 3 == 1, F.concat(F.lit("---\ntitle: x\n"), t)).otherwise(t)
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.strip_frontmatter(made)).alias("body"))


@query("SELECT event_id, '# e' || event_id || '.json' || chr(10) || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) AS structured, '# e' || event_id || chr(10) || chr(10) || event_type AS plain FROM events")
def structured_wrap(spark, sf_dir):
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.structured_as_markdown(F.concat(name, F.lit(".json")), "props").alias("structured"), T.plain_as_markdown(name, "event_type").alias("plain"))


_DIRTY = "replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)), ', ', ' <!-- Image --> ![x](y.png) ')"


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS even, md5(regexp_replace(t, '(?i)<!--\s*image\s*-->', '', 'g')) AS icons,
  md5(regexp_replace(regexp_replace(t, '!\[.*?\]\(.*?\)', '', 'g'), '(?i)<!--\s*image\s*-->', '', 'g')) AS images FROM (SELECT doc_id, {_DIRTY} AS t FROM documents)""")
def text_cleanup(spark, sf_dir):
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\n\n")), F.lit(", "), F.lit(" <!-- Image --> ![x](y.png) "))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.even_blank_lines(t)).alias("even"), F.md5(T.without_icons(t)).alias("icons"), F.md5(T.without_images(t)).alias("images"))


@query("SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE b IS DISTINCT FROM line GROUP BY doc_id")
def dedupe_lines(spark, sf_dir):
    kept = segment.without_repeats(segment.lines(_docs(spark, sf_dir).select("doc_id", "text")), ["doc_id"])
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


_SPANS = "SELECT doc_id AS doc, 'd' || doc_id AS title, n // 40 AS page, n % 40 AS ord, CASE WHEN n % 9 = 0 THEN 15.0 WHEN n % 5 = 0 THEN 12.0 ELSE 10.0 END AS size, trim(line) AS text FROM (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(f"""WITH s AS ({_SPANS}), bodies AS (SELECT doc, arg_max(size, n * 1000 - size) AS body FROM (SELECT doc, size, count(*) AS n FROM s GROUP BY ALL) GROUP BY doc),
k AS (SELECT *, lag(text) OVER (PARTITION BY doc ORDER BY page, ord) AS b FROM s),
m AS (SELECT k.*, CASE WHEN size >= body * 1.4 THEN chr(10) || '## ' WHEN size >= body * 1.15 THEN chr(10) || '### ' END AS mark FROM k JOIN bodies USING (doc) WHERE text IS DISTINCT FROM b),
g AS (SELECT *, count(mark) OVER (PARTITION BY doc ORDER BY page, ord) AS g FROM m),
parts AS (SELECT doc, title, g, coalesce(min(mark), '') || string_agg(text, ' ' ORDER BY page, ord) AS t FROM g GROUP BY doc, title, g)
SELECT doc, md5('# ' || title || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY g) || chr(10)) AS markdown FROM parts GROUP BY doc, title""")
def layout_to_markdown(spark, sf_dir):
    """Lines of documents as a page layout with made-up sizes."""
    each = segment.lines(_docs(spark, sf_dir).select("doc_id", "text")).withColumn("n", F.col("ord"))
    size = F.when(F.col("n") % 9 == 0, 15.0).when(F.col("n") % 5 == 0, 12.0).otherwise(10.0)
    rows = each.select(F.col("doc_id").alias("doc"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.expr("n div 40").alias("page"), (F.col("n") % 40).alias("ord"), size.alias("size"), F.trim("line").alias("text"))
    return layout.to_markdown(rows).select("doc", F.md5("markdown").alias("markdown"))


@query("SELECT doc_id AS file_ord, sha256('m' || chr(0) || source || chr(0) || text) AS key FROM documents")
def cache_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("file_ord"), T.cache_key(F.lit("m"), "source", "text").alias("key"))


# written for these pages alone: marks of a bold run that is never closed end with the article
_PLAIN = "regexp_replace(replace(regexp_replace({}, '\\s+', ' ', 'g'), '&quot;', '\"'), '&amp;?', '&', 'g')"
_PAGE = f"""SELECT page_id, {_PLAIN.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, {_PLAIN.format("""regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's')""")} AS ad,
  trim({_PLAIN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")}) AS h1, {_PLAIN.format("regexp_extract(html, '</h1>(.*)</article>', 1, 's')")} AS rest FROM pages"""


@query(rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(title || '<p>' || ad || '<p># ' || h1 || regexp_replace(rest, '(<br>|</?p>| )+$', '') || repeat('**', len(regexp_extract_all(rest, '<b>'))),
  '<br> ?(</?p> ?)+', '  ' || chr(10) || chr(10), 'g'), '<br>', '  ' || chr(10), 'g'), ' ?</?p>( ?</?p>)* ?', chr(10) || chr(10), 'g'), '<b> ?', '**', 'g') AS markdown FROM ({_PAGE})""")
def html_to_markdown(spark, sf_dir):
    """Pages as markdown, without scripts and navigation."""
    @F.pandas_udf("string")
    def shown(html: pd.Series) -> pd.Series:
        return html.map(render.page, na_action="ignore")

    return table(spark, sf_dir, "pages").select("page_id", shown("html").alias("markdown"))


@query("""SELECT conv_id, '# talk' || chr(10) || chr(10) || string_agg(CASE WHEN turn % 2 = 0 THEN '**' || text || '**' ELSE '*' || text || '*' END, chr(10) ORDER BY turn) || chr(10) AS markdown FROM conversations GROUP BY conv_id""")
def boxnote_render(spark, sf_dir):
    """Conversations as note trees, rendered."""
    @F.pandas_udf("string")
    def shown(tree: pd.Series) -> pd.Series:
        return tree.map(lambda t: render.box_note("talk.boxnote", t.encode()))

    node = F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.array(F.struct(F.when(F.col("turn") % 2 == 0, "bold").otherwise("italic").alias("type"))).alias("marks"))).alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", node.alias("node")))), lambda x: x.node)
    trees = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.lit("doc").alias("type"), ordered.alias("content")).alias("doc"))).alias("tree"))
    return trees.select("conv_id", shown("tree").alias("markdown"))


@query(chunk_sql.fixed(SQL["plain"], 500, 50))
def jsonl_roundtrip(spark, sf_dir):
    """Chunks of documents written as JSON lines, a folder for each module, and read again."""
    at = f"{incremental.shared(spark)}/lines"
    files.write_jsonl(chunk.chunk(corpora.plain(spark, sf_dir)), at)
    return _rows(files.read_jsonl(spark, at))


_TWICE = f"SELECT module, source_file, file_ord, CASE WHEN file_ord % 7 = 0 THEN content || ' changed.' ELSE content END AS content FROM ({SQL['plain']})"


@query(chunk_sql.fixed(_TWICE, 500, 50))
def changed_documents(spark, sf_dir):
    """Documents arrive, then some of them again with other texts; chunks of the last versions."""
    at = incremental.shared(spark)
    docs = corpora.plain(spark, sf_dir).select("module", "source_file", "content")
    changed = corpora.plain(spark, sf_dir).where("file_ord % 7 = 0").withColumn("content", F.concat("content", F.lit(" changed.")))
    for rows in (docs, changed.select(*docs.columns)):
        rows.write.mode("append").parquet(f"{at}/in")
        incremental.chunk_changes(spark, f"{at}/in", docs.schema, f"{at}/out", f"{at}/state", done=f"{at}/done")
    return _rows(incremental.current(spark, f"{at}/out", done=f"{at}/done"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'url' ELSE 'markdown' END AS kind, '---' || chr(10) || 'source_url: ' || url || chr(10) || 'fetched_at: 2024-01-02T03:04:05Z' || chr(10) || 'refresh: weekly' || chr(10) || '---' || chr(10) || chr(10) AS head,
  substr(sha256(url || '#' || CASE WHEN page_id % 2 = 0 THEN 'HEAD' ELSE 'v1' END), 1, 16) AS cache_key, 'Page ' || page_id AS heading FROM pages""")
def source_headers(spark, sf_dir):
    """Kinds of sources, leading blocks of fetched pages, keys of cached clones, first headings."""
    n = F.col("page_id")
    source = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit(".PDF"))).when(n % 3 == 1, F.col("url")).otherwise(F.concat(n.cast("string"), F.lit(".md")))
    fetched = F.lit("2024-01-02 03:04:05").cast("timestamp")
    page = F.concat(F.lit("text\n  ## Page "), n.cast("string"), F.lit("\n# other"))
    return table(spark, sf_dir, "pages").select(
        "page_id", files.source_type(source).alias("kind"), T.url_frontmatter("url", fetched, F.lit("weekly")).alias("head"), T.git_cache_key("url", F.when(n % 2 == 1, "v1")).alias("cache_key"), T.first_heading_line(page).alias("heading"))


@query(rf"""SELECT doc_id, md5('# d' || doc_id || chr(10) || chr(10) || regexp_replace(regexp_replace(array_to_string(list_transform(string_split({_DIRTY}, chr(10)), lambda l: trim(l)), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10)) AS markdown FROM documents""")
def laid_out_pages(spark, sf_dir):
    """Lines of a page layout under a title."""
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\n\n")), F.lit(", "), F.lit(" <!-- Image --> ![x](y.png) "))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.laid_out_as_markdown(F.concat(F.lit("d"), F.col("doc_id").cast("string")), t)).alias("markdown"))


@query(f"""SELECT p_partkey, language FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'python' WHEN p_size % 3 = 2 THEN 'c++' END AS language FROM part WHERE p_size % 5 <> 0) WHERE language IS NULL OR language = 'python'""")
def code_filter(spark, sf_dir):
    """Chunks with code in one language, or in one that is not named."""
    size = F.col("p_size")
    t = F.concat(F.col("p_name"), F.lit("\n```"), F.when(size % 3 == 0, "python x").when(size % 3 == 1, "").otherwise("C++"), F.lit("\n"), F.col("p_type"), F.lit("\n"), F.when(size % 5 == 0, "").otherwise("```"))
    chunks = table(spark, sf_dir, "part").select("p_partkey", F.struct(T.has_code(t).alias("has_code"), T.code_language(t).alias("language")).alias("metadata"))
    return retrieve.with_code(chunks, "python").select("p_partkey", "metadata.language")


@query("SELECT epoch(time_bucket(INTERVAL 15 minutes, ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def incremental_stream(spark, sf_dir):
    """Events as a stream: counts of each quarter of an hour and type, with a watermark."""
    return incremental.event_counts(spark, sf_dir)


@query("SELECT source AS module, CASE WHEN n <= 500 THEN 'fits' ELSE 'split' END AS size_class, count(*) AS documents, sum(n)::BIGINT AS tokens FROM (SELECT source, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) GROUP BY ROLLUP (source, CASE WHEN n <= 500 THEN 'fits' ELSE 'split' END)")
def corpus_report(spark, sf_dir):
    n = K.count_tokens(F.col("text"))
    d = _docs(spark, sf_dir).select(F.col("source").alias("module"), n.alias("n")).withColumn("size_class", F.when(F.col("n") <= 500, "fits").otherwise("split"))
    return d.rollup("module", "size_class").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))

