"""Markdown and naming functions as column expressions, without Python code per row.

Patterns use ``(?md)``, so that only a line feed ends a line, and ``(?U)`` where words or
white space mean Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that are no tags
STOP_WORDS = tuple(
    """a an the and or but in on at to for of with by from up as is are was were be been being have has had do does did
    will would could should may might shall can not no nor so yet both either this that these those it its their our
    your my his her we you they he she all any each more also into then than about over after""".split()
)
ORPHAN = r"(?U)\A\s*(?:\z|#{1,6}\s+\S[^\n]*(?:\n\s*#{1,6}\s+\S[^\n]*)*\s*\z)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(c: Column | str, pattern: str, by: str) -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(by))


def strip(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return sub(c, r"(?U)\A\s+|\s+\z", "")


def slug(c: Column | str) -> Column:
    """Lower-case words joined by hyphens; hyphens in a row stay."""
    kept = sub(strip(F.lower(col(c))), r"(?U)[^\w\s-]", "")
    return sub(sub(kept, r"(?U)[\s_]+", "-"), r"\A-+|-+\z", "")


def kebab(c: Column | str) -> Column:
    """Lower-case name whose words are joined by single hyphens."""
    joined = sub(sub(strip(c), r"(?U)[\s_]+", "-"), r"(?U)[^\w-]", "")
    return sub(F.lower(sub(joined, "-{2,}", "-")), r"\A-+|-+\z", "")


def title_case(c: Column | str) -> Column:
    """The first letter of every run of letters upper case, the others lower case."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def file_stem(path: Column | str) -> Column:
    """The last component without a literal ``.md``."""
    return sub(base_name(path), r"\.md\z", "")


def file_id(path: Column | str) -> Column:
    return F.substring(F.sha2(col(path), 256), 1, 12)


def title_of_path(path: Column | str) -> Column:
    stem = sub(base_name(path), r"(?s)(?<=.)\.[^.]*\z", "")
    return title_case(sub(stem, "[_-]", " "))


def first_h1(text: Column | str) -> Column:
    """The first level-1 heading, null if there is none."""
    return F.nullif(strip(F.regexp_extract(col(text), r"(?md)^#\s+(.+)$", 1)), F.lit(""))


def code_fences(text: Column | str) -> Column:
    """What stands behind each fence at the start of a line."""
    fences = F.regexp_extract_all(col(text), F.lit(r"(?md)^```(.*)$"), F.lit(1))
    return F.when(F.contains(col(text), F.lit("```")), fences).when(col(text).isNotNull(), F.array().cast("array<string>"))  # most texts have none


def has_code(text: Column | str) -> Column:
    n = F.size(code_fences(text))
    return (n >= 2) & (n % 2 == 0)


def code_language(text: Column | str) -> Column:
    """First word behind the first fence, where fences pair."""
    word = F.lower(F.regexp_extract(strip(F.get(code_fences(text), F.lit(0))), r"(?U)\A(\S+)", 1))
    return F.when(has_code(text), F.nullif(word, F.lit("")))


def is_orphan(text: Column | str) -> Column:
    """Nothing but headings and blank lines."""
    return col(text).rlike(ORPHAN)


def is_file_artifact(text: Column | str) -> Column:
    """A UUID, or a long name without a blank."""
    c = col(text)
    uuid = c.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return uuid | ((F.instr(c, " ") == 0) & (F.length(c) >= 20))


def tag_words(text: Column | str) -> Column:
    """Words of at least three letters that are no stop words."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z][a-z0-9]*)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def tag_terms(text: Column | str) -> Column:
    """Distinct tag words of headings to level 3 and of bold spans."""
    heads = F.regexp_extract_all(col(text), F.lit(r"(?md)^#{1,3} (.+)"), F.lit(1))
    bold = F.regexp_extract_all(col(text), F.lit(r"\*\*([^*]+)\*\*"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(F.concat(heads, bold), tag_words)))


def strip_frontmatter(text: Column | str) -> Column:
    """Without a closed leading block between ``---`` lines; an unclosed one stays."""
    return sub(text, r"(?s)\A---.*?\n---\n*", "")


def yaml_scalar(c: Column | str) -> Column:
    """Quoted only where YAML needs it."""
    c = col(c)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(F.length(c) == 0, F.lit('""')).when(c.rlike("[:#\n\"']") | (c != strip(c)), quoted).otherwise(c)


def first_heading_line(text: Column | str) -> Column:
    """Text of the first line that starts with ``#``, null where that line has no more."""
    return F.nullif(strip(F.regexp_extract(col(text), r"(?md)^[\t\x0B\f\r ]*#+(.*)$", 1)), F.lit(""))


def plain_as_markdown(stem: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("# "), col(stem), F.lit("\n\n"), col(text))


def structured_as_markdown(name: Column | str, text: Column | str) -> Column:
    lang = F.when(F.lower(col(name)).rlike(r"\.ya?ml$"), "yaml").otherwise("json")
    return F.concat(F.lit("# "), col(name), F.lit("\n\n```"), lang, F.lit("\n"), col(text), F.lit("\n```\n"))


def laid_out_as_markdown(title: Column | str, text: Column | str) -> Column:
    """Lines of a page layout stripped, at most one blank line in a row, under a title."""
    lines = F.array_join(F.transform(F.split(col(text), "\n"), strip), "\n")
    return F.concat(F.lit("# "), col(title), F.lit("\n\n"), strip(sub(lines, "\n{3,}", "\n\n")), F.lit("\n"))


def without_icons(text: Column | str) -> Column:
    return sub(text, r"(?i)<!--\s*image\s*-->", "")


def without_images(text: Column | str) -> Column:
    return without_icons(sub(text, r"!\[.*?\]\(.*?\)", ""))


def even_blank_lines(text: Column | str) -> Column:
    return strip(sub(text, "\n{3,}", "\n\n"))


def url_stem(url: Column | str) -> Column:
    """A file name for a url: its last path segment, or else its host."""
    path = sub(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    host = F.regexp_extract(col(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    named = F.when(F.length(last) > 0, last).otherwise(host)
    clean = sub(sub(named, r"(?U)[^\w.-]", "-"), r"\A-+|-+\z", "")
    return F.substring(F.when(F.length(clean) > 0, clean).otherwise(F.lit("page")), 1, 80)


def url_frontmatter(url: Column | str, fetched: Column, refresh: Column | None = None) -> Column:
    when = F.date_format(fetched, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    again = F.coalesce(F.concat(F.lit("refresh: "), refresh, F.lit("\n")), F.lit("")) if refresh is not None else F.lit("")
    return F.concat(F.lit("---\nsource_url: "), col(url), F.lit("\nfetched_at: "), when, F.lit("\n"), again, F.lit("---\n\n"))


def cache_key(model: Column | str, document: Column | str, chunk: Column | str) -> Column:
    """Hash of three texts that no shift of a boundary leaves alike."""
    return F.sha2(F.concat_ws("\0", col(model), col(document), col(chunk)), 256)


def parse_dependency(c: Column | str) -> Column:
    """``name[@version]`` as a struct, null where malformed."""
    c = col(c)
    name, version = F.regexp_extract(c, "^([a-zA-Z0-9_-]+)(@.+)?$", 1), F.regexp_extract(c, "^[a-zA-Z0-9_-]+@(.+)$", 1)
    return F.when(c.rlike("^[a-zA-Z0-9_-]+(@.+)?$"), F.struct(name.alias("name"), F.nullif(version, F.lit("")).alias("version")))


def parse_git_ref(c: Column | str) -> Column:
    """``url[#folder][@ref]`` as a struct. Behind a ``#`` the last ``@`` starts the ref; else the first after ``://``."""
    c = col(c)
    framed = F.instr(c, "#") > 0
    bare = r"^((?:.*?://)?[^@]*)(?:@(.*))?$"
    folder, at = F.regexp_extract(c, "^[^#]*#(.*?)(?:@([^@]*))?$", 1), F.regexp_extract(c, "^[^#]*#.*@([^@]*)$", 1)
    return F.struct(
        F.when(framed, F.regexp_extract(c, "^([^#]*)", 1)).otherwise(F.regexp_extract(c, bare, 1)).alias("url"),
        F.nullif(F.when(framed, at).otherwise(F.regexp_extract(c, bare, 2)), F.lit("")).alias("ref"),
        F.when(framed, F.nullif(folder, F.lit(""))).alias("folder"),
    )


def git_cache_key(url: Column | str, ref: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(col(url), F.lit("#"), F.coalesce(col(ref), F.lit("HEAD"))), 256), 1, 16)
