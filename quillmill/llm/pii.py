"""Personal data in whole texts, by DataFrame functions alone.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for
bank account numbers, octet and digit limits), and words near a span adjust its score.
E-mail, address, card and phone spans that pass their validator always stay; account
numbers and secrets, which the method adds, stay if their score reaches ``floor``. Near
are the last and first ``reach`` characters of what lies between a span and its
neighbours of the same kind.

Matches are leftmost and do not overlap within a kind. Repetitions are possessive where no
later match could need them given back, and a proposal starts at the start of a run or
where the last match ended, so the time is linear in the text and a long run of digits or
letters cannot exhaust the stack. Offsets are code points, the end exclusive, beside offsets
in bytes; both are sums of the lengths of the pieces before. The sums go block by block, so
the time is linear in the matches as well, whatever their number.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned as
often as they come; an empty table gives an empty result; columns besides the text keep
their values; ``find`` replaces a column of the name it is given, ``redact`` none but the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret")
BLOCK = 256  # matches whose offsets are summed at a time
# fixed values: lengths of account numbers by country, so that groups end where the number does
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _in_groups(length: int, countries: str) -> str:
    """A number in groups of four with single blanks or hyphens between them."""
    fours, rest = divmod(length - 4, 4)
    last = r"[\x20-][A-Z0-9]{%d}" % rest if rest else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[\x20-][A-Z0-9]{{4}}){{{fours}}}{last}"


# fixed values: what proposes a span of each kind
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9_])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{'|'.join(_in_groups(*x) for x in LENGTHS.items())})(?![A-Za-z0-9_])",
    "secret": r"""(?<![A-Za-z0-9_])(?:A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9_])|(?i:password|passwd|secret|token|api[_-]?key)[\x20]{0,2}+[:=][\x20]{0,2}+["']?+[A-Za-z0-9+/_.~!@#$%^&*=-]{8,}+)""",
}
# fixed values: what no span of a kind is without; most texts hold none, which a search for it tells soonest
NEEDS = {"email": ("@",), "ip": (".",), "phone": ("+",), "secret": ("=", ":", "AKIA", "ASIA")}
# fixed values: words within `reach` characters before or after a span that raise its score
CONTEXT = {
    "email": "mail|contact|write|reply",
    "ip": "server|host|address|login|ip",
    "card": "card|visa|credit|payment|pay",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
    "secret": "login|credential|auth|aws|private",
}
AGAINST = "order|serial|invoice|version|part|sku|isbn|example|sample"  # fixed value: words before it that lower it; after it they mostly start something else
START, RAISE, LOWER = 60, 30, 30  # in hundredths


def _valid(kind: str, value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":  # leading zeros do not count
        octet = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return f"{value} rlike '^{octet}([.]{octet}){{3}}$'"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    if kind == "card":
        doubled = "cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0)"
        luhn = f"aggregate(split(reverse({digits}), ''), named_struct('s', 0, 'i', 0), (a, c) -> named_struct('s', a.s + if(a.i % 2 = 1, {doubled}, cast(c as int)), 'i', a.i + 1), a -> a.s % 10 = 0)"
        return f"if(length({digits}) between 13 and 19, {luhn}, false)"
    if kind == "secret":  # words alone are no secret
        return f"{value} rlike '^A[KS]IA|[0-9]'"
    whole = f"translate({value}, ' -', '')"
    turned = f"concat(substring({whole}, 5), substring({whole}, 1, 4))"
    step = "if(c between '0' and '9', (r * 10 + cast(c as int)) % 97, (r * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(split({turned}, ''), 0, (r, c) -> {step}, r -> r = 1)"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _before_each(items: str, zero: str, step: Callable[[str, str], str]) -> str:
    """The fold of what stands before each item, block by block, so that no list grows with every item."""
    blocks = f"transform(sequence(0, cast((size({items}) - 1) div {BLOCK} as int)), k -> slice({items}, k * {BLOCK} + 1, {BLOCK}))"
    starts = f"aggregate(bl, array({zero}), (a, x) -> concat(a, array(aggregate(x, element_at(a, -1), (t, y) -> {step('t', 'y')}))))"
    within = f"aggregate(x, named_struct('at', s, 'all', slice(array(s), 1, 0)), (a, y) -> named_struct('at', {step('a.at', 'y')}, 'all', concat(a.all, array(a.at))), a -> a.all)"
    return _let("bl", blocks, f"flatten(zip_with(bl, slice({starts}, 1, size(bl)), (x, s) -> {within}))")


def spans_of(text: str, kind: str, reach: int = 40) -> str:
    """SQL for the confirmed spans of one kind in the SQL expression ``text``."""
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    beside = (
        "zip_with(zip_with(found, slice(gaps, 1, size(found)), (m, g) -> named_struct('m', m, 'g', g)), slice(gaps, 2, size(found)), (x, r) -> named_struct('m', x.m, "
        "'gap', cast(length(x.g) as bigint), 'n', cast(length(x.m) as bigint), 'gap_bytes', cast(octet_length(x.g) as bigint), 'bytes', cast(octet_length(x.m) as bigint), "
        f"'before', lower(right(x.g, {reach})), 'after', lower(left(r, {reach}))))"
    )
    sums = _before_each("beside", "named_struct('at', 0L, 'byte', 0L)", lambda a, y: f"named_struct('at', {a}.at + {y}.gap + {y}.n, 'byte', {a}.byte + {y}.gap_bytes + {y}.bytes)")
    near = f"(x.before rlike '(^|[^a-z])({CONTEXT[kind]})' or x.after rlike '(^|[^a-z])({CONTEXT[kind]})')"
    score = f"cast({START} + if({near}, {RAISE}, 0) - if(x.before rlike '(^|[^a-z])({AGAINST})', {LOWER}, 0) as double) / 100"
    span = (
        f"if({_valid(kind, 'x.m')}, named_struct('kind', '{kind}', 'start', a.at + x.gap, 'stop', a.at + x.gap + x.n, 'value', x.m, 'score', {score}, "
        "'first_byte', a.byte + x.gap_bytes, 'end_byte', a.byte + x.gap_bytes + x.bytes), null)"
    )
    spans = _let("beside", beside, f"filter(zip_with(beside, {sums}, (x, a) -> {span}), s -> s is not null)")
    found = _let("found", f"regexp_extract_all({text}, '{pattern}', 0)", _let("gaps", f"split({text}, '{pattern}', -1)", spans))
    none = "cast(array() as array<struct<kind:string,start:bigint,stop:bigint,value:string,score:double,first_byte:bigint,end_byte:bigint>>)"
    needs = " or ".join(f"contains({text}, '{n}')" for n in NEEDS.get(kind, ())) or "true"
    return f"case when ({needs}) and {text} rlike '{pattern}' then {found} else {none} end"


def _found(text_col: str, floor: float, reach: int) -> str:
    text = f"coalesce(`{text_col}`, '')"
    parts = {k: spans_of(text, k, reach) for k in KINDS}
    return f"concat({', '.join(p if k in BASE else f'filter({p}, s -> s.score >= {floor})' for k, p in parts.items())})"


def find(docs: DataFrame, text_col: str = "text", *, floor: float = 0.5, reach: int = 40, name: str = "pii") -> DataFrame:
    """``docs`` with a column ``name``: an array of (kind, start, stop, value, score, first_byte, end_byte), by kind, then start."""
    return docs.withColumn(name, F.expr(_found(text_col, floor, reach)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the base spans, all spans as text, and their scores in hundredths."""
    base = F.filter("pii", lambda s: s.kind.isin(*BASE))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.expr("array_join(transform(pii, s -> cast(cast(round(s.score * 100) as int) as string)), ',')").alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text", *, floor: float = 0.5, reach: int = 40) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets.

    Spans of different kinds may overlap; an overlapping run is replaced once, by the kind
    that starts first. A null text stays null. The text is cut by its bytes.
    """
    ordered = "array_sort(transform(f, s -> named_struct('start', s.start, 'stop', s.stop, 'first_byte', s.first_byte, 'end_byte', s.end_byte, 'kind', s.kind)))"
    ends = _before_each("o", "named_struct('at', 0L, 'byte', 0L)", lambda a, y: f"named_struct('at', greatest({a}.at, {y}.stop), 'byte', greatest({a}.byte, {y}.end_byte))")
    cut = "cast(substring(raw, cast(a.byte + 1 as int), cast(y.first_byte - a.byte as int)) as string)"
    parts = f"zip_with(o, {ends}, (y, a) -> if(y.start < a.at, '', concat({cut}, '<', upper(y.kind), '>')))"
    rest = "cast(substring(raw, cast(array_max(transform(o, y -> y.end_byte)) + 1 as int)) as string)"
    whole = _let("raw", f"cast(`{text_col}` as binary)", _let("o", ordered, f"concat(array_join({parts}, ''), {rest})"))
    changed = _let("f", _found(text_col, floor, reach), f"if(size(f) = 0, `{text_col}`, {whole})")
    return docs.withColumn(text_col, F.expr(f"case when `{text_col}` is not null then {changed} end"))
