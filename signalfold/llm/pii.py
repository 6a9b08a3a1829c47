"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All of it is row-local SQL: one scan, no shuffle, no Python. A pattern P is applied as \\G.*?(P), which cuts a text into
pieces that each end with a match; the running sum of the pieces' lengths gives the matches' places (`_running`: n log n
steps). Parts of the text are taken from chunks of fixed size, so no match costs a walk from the text's start.
Quantifiers are possessive where giving back can't help, which keeps long runs linear. An `iban` is only found
by its head; its end is the one at its country's length, or for other countries the last one at a word boundary,
where mod 97 holds, so what follows it (a capitalised word, a number, another IBAN) does not hide it.

A score is PROPOSED for the pattern, the points of the kind's check (CHECKED: how much passing it says), and NEARBY for a
context word within CONTEXT characters before the match. The four base kinds are reported whenever their pattern and check
hold; of the further kinds those that reach THRESHOLD: an `iban` in capitals does so by itself and in small letters with
a context word alone, an `ssn` (no checksum) and a `secret` (a long run of letters and digits) only with one, unless
the secret has a known issuer's head.

Defined cases: a null text is empty; empty texts have no spans; long texts are read whole; repeated rows each get
their row; an empty table gives an empty result; spans of different kinds may overlap, and so may IBANs; spans of
equal start are in order of their kind; a column named like the result is replaced, and all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order: pattern, a cheap test whether a text can match at all, words that speak for the kind.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr({t}, '@') > 0", "mail|contact|write|courriel|correo"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"{t} rlike '[0-9]\\.[0-9]'", "ip|host|server|address|adresse"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", r"{t} rlike '[0-9][\\x20-]?[0-9][\\x20-]?[0-9]'", "card|visa|credit|payment|carte|karte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "instr({t}, '+') > 0", "phone|call|tel|fax|mobile|telefon|llamar"),
    "iban": (r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})|[a-z]{2}[0-9]{2}(?=(?:\x20?[a-z0-9]){11}))", r"{t} rlike '[A-Za-z][A-Za-z][0-9][0-9]'", "iban|account|bank|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"{t} rlike '[0-9]-[0-9][0-9]-[0-9]'", "ssn|social security"),
    "secret": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", r"{t} rlike '[A-Za-z0-9+/_=-]{{20}}'", "secret|token|passw|api.?key|credential|bearer|private.?key"),
}
BASE = ("email", "ip", "card", "phone")
#: Points (hundredths) of a match before its check, of its check by kind, and of a context word within CONTEXT characters;
#: what reports a span of a further kind.
PROPOSED, NEARBY, CONTEXT, THRESHOLD = 30, 30, 40, 60
CHECKED = {
    "email": "30", "ip": "10", "card": "20", "phone": "10", "iban": "if({m} rlike '^[A-Z]', 40, 20)", "ssn": "0",
    "secret": "if({m} rlike '^(?:AKIA|ASIA|gh[oprsu]_|github_pat_|glpat-|sk-|sk_live_|xox[abprs]-|AIza|eyJ)', 30, 0)",
}
#: Characters of an IBAN, blanks aside (ISO 13616), and its bounds in any country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LEAST, IBAN_MOST = 15, 34
#: Characters of a chunk, as a power of two.
CHUNK = 6

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(m: str) -> str:
    return rf"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    doubled = "if(i % 2 = 1, if(c > 4, 2 * c - 9, 2 * c), c)"
    return f"aggregate(transform(split(reverse({_digits(m)}), ''), (s, i) -> transform(array(cast(s as int)), c -> {doubled})[0]), 0, (a, c) -> a + c) % 10 = 0"


def _mod97(m: str) -> str:
    code = f"replace({m}, ' ', '')"
    moved = f"concat(substr({code}, 5), substr({code}, 1, 4))"
    value = "if(c between '0' and '9', ascii(c) - 48, ascii(c) - 55)"
    step = f"(r * if(c between '0' and '9', 10, 100) + {value}) % 97"
    return f"aggregate(split({moved}, ''), 0, (r, c) -> {step}) = 1"


#: Whether match m of a kind holds.
CHECKS = {
    "email": lambda m: "true",
    "ip": lambda m: rf"{m} rlike '^(?:{_OCTET}[.]){{3}}{_OCTET}$'",
    "card": _luhn,
    "phone": lambda m: f"length({_digits(m)}) between 10 and 15",
    "iban": lambda m: f"{m} <> ''",
    "ssn": lambda m: f"{m} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)'",
    "secret": lambda m: f"{m} rlike '[0-9]' and {m} rlike '[A-Za-z]'",
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body, in which `name` stands for value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(a: str, step: str = "x + {before}", rest: str = "0") -> str:
    """SQL: running sums (or another associative fold) of array a, by doubling the distance."""
    before = f"if(i >= shiftleft(1, r), s[i - shiftleft(1, r)], {rest})"
    return f"aggregate(sequence(0, cast(ceil(log2(greatest(size({a}), 1))) as int)), {a}, (s, r) -> transform(s, (x, i) -> {step.format(before=before)}))"


def _chunks(t: str) -> str:
    return f"regexp_extract_all({t}, '(?s).{{1,{1 << CHUNK}}}', 0)"


def _part(c: str, start: str, end: str) -> str:
    """SQL: characters start to end (exclusive) of the text in chunks c."""
    first = f"shiftright({start}, {CHUNK})"
    return f"if({end} <= {start}, '', substr(array_join(slice({c}, {first} + 1, shiftright({end} - 1, {CHUNK}) - {first} + 1), ''), {start} - shiftleft({first}, {CHUNK}) + 1, {end} - {start}))"


def _iban(w: str) -> str:
    """SQL: the IBAN that the text w begins with, or an empty text. (e: where it may end; n: its characters without blanks)"""
    more = rf"{{{IBAN_LEAST - 4},{IBAN_MOST - 4}}}+"
    body = rf"^(?:[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){more}|[a-z]{{2}}[0-9]{{2}}(?:\x20?[a-z0-9]){more})"
    lengths = "map(" + ", ".join(f"'{c}', {n}" for n, codes in IBAN_LENGTHS.items() for c in codes.split()) + ")"
    ends = f"""transform(filter(sequence({IBAN_LEAST}, greatest(length(regexp_extract({w}, {_quoted(body)}, 0)), {IBAN_LEAST})), e -> substr({w}, e, 1) <> ' ' and not substr({w}, e + 1, 1) rlike '[A-Za-z0-9]'),
        e -> named_struct('e', e, 'n', length(replace(substr({w}, 1, e), ' ', ''))))"""
    holds = f"y.n >= {IBAN_LEAST} and y.n = coalesce(try_element_at({lengths}, upper(substr({w}, 1, 2))), y.n) and {_mod97(f'upper(substr({w}, 1, y.e))')}"
    return f"substr({w}, 1, coalesce(array_max(filter({ends}, y -> {holds})).e, 0))"


def _spans(kind: str, no: int, t: str) -> str:
    """SQL: the spans of one kind in text t."""
    pattern, guard, words = KINDS[kind]
    whole = _quoted(r"(?s)\G.*?(" + pattern + ")")
    none = "cast(array() as array<struct<start:int,no:int,kind:string,end:int,score:double>>)"
    upto = _running(f"transform(regexp_extract_all({t}, {whole}, 0), p -> length(p))")
    found = f"zip_with(u, regexp_extract_all({t}, {whole}, 1), (e, m) -> named_struct('start', e - length(m), 'm', m))"
    if kind == "iban":
        window = _part("c", "x.start", f"x.start + {4 + 2 * (IBAN_MOST - 4) + 1}")
        found = f"transform({found}, x -> named_struct('start', x.start, 'm', {_let('w', window, _iban('w'))}))"
    near = f"lower({_part('c', f'greatest(x.start - {CONTEXT}, 0)', 'x.start')}) rlike '(?:{words})'"
    score = f"({PROPOSED} + {CHECKED[kind].format(m='x.m')} + if({near}, {NEARBY}, 0)) / 100D"
    spans = f"""transform(filter({found}, x -> {CHECKS[kind]('x.m')}),
        x -> named_struct('start', x.start, 'no', {no}, 'kind', '{kind}', 'end', x.start + length(x.m), 'score', {score}))"""
    if kind not in BASE:
        spans = f"filter({spans}, x -> x.score >= {THRESHOLD / 100}D)"
    return f"if({guard.format(t=t)}, {_let('u', upto, f'if(size(u) = 0, {none}, {_let(chr(99), _chunks(t), spans)})')}, {none})"


def _text(text: str) -> str:
    return "coalesce(`{}`, '')".format(text.replace("`", "``"))


def _all_spans(text: str) -> str:
    t = _text(text)
    return f"array_sort(concat({', '.join(_spans(k, i, t) for i, k in enumerate(KINDS))}))"


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column `out`: spans (start, no, kind, end, score) in order of start, then kind; code points, end exclusive."""
    return docs.withColumn(out, F.expr(_all_spans(text)))


def span_text(pii: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of each span (of `kinds`), comma-joined."""
    wanted = pii if kinds is None else f"filter({pii}, x -> x.kind in ({', '.join(map(repr, kinds))}))"
    return F.expr(f"array_join(transform({wanted}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def count_of(pii: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({pii}, x -> x.kind = '{kind}')) as long)")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each reported span replaced by <kind>; overlapping spans go together, under the kind of the first. A null text stays null."""
    t, column = _text(text), "`{}`".format(text.replace("`", "``"))
    # u: how far the spans up to each one reach; a span that begins beyond those before it begins a gap.
    reach = _running("transform(p, x -> x.end)", "greatest(x, {before})")
    heads = "filter(sequence(0, size(p) - 1), i -> i = 0 or p[i].start >= u[i - 1])"
    gaps = f"transform({heads}, i -> concat({_part('c', 'if(i = 0, 0, u[i - 1])', 'p[i].start')}, '<', p[i].kind, '>'))"
    tail = _part("c", "u[size(u) - 1]", f"length({t})")
    cut = _let("u", reach, _let("c", _chunks(t), f"concat(array_join({gaps}, ''), {tail})"))
    return docs.withColumn(text, F.expr(_let("p", _all_spans(text), f"if(size(p) = 0, {column}, {cut})")))
