"""The opN_<name> queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalfold.llm import bpe, langid, minhash, pii, quality, rans, toxicity
from signalfold.llm.bloom_dedup import BloomDedup
from signalfold.llm.compaction import ShardStore
from signalfold.llm.conversations import Repairer, damage
from signalfold.llm.store import scratch_path, table
from signalfold.llm.warc import archived
from signalfold.llm.whitening import Whitener
from signalfold.llm.winnow import contamination


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with the expected severity, the grade, P(grade > 0) and the decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four batches, each is appended and the store compacted; then all rows are read back."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, scratch_path(spark, "shards"))
    for batch in range(4):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == batch))
        store.compact()
    rows = store.read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with its set's size, its component of links at three-word shingles and 85 %, and whether it stays."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def vocabulary() -> str:
    """The tokenizer file; its library ships it to every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with the number of ids and digests of the ids and of the decoded text."""
    return bpe.tokenize(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with its words, how many benchmark windows cover, the number and a digest of the items found, and the decision."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with the row that stays of its group of equal texts, the group's size, and the text's digest."""
    return BloomDedup(table(spark, sf_dir, "documents")).classify()


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with counts and a digest of the base kinds' spans, all spans, and how many these are."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id", *(pii.count_of("pii", k).alias(f"n_{k}") for k in pii.BASE),
        F.sha2(pii.span_text("pii", pii.BASE), 256).alias("base_sha256"), pii.span_text("pii").alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def _crc(mod: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with its fold, the calibrated score and the decision; labels of the held-out fold teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(_crc(3) != 1))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (F.coalesce(_crc(3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with the place, number and checksum of its ids as read back from the files."""
    out = scratch_path(spark, "token-ids")
    rans.write_ids(table(spark, sf_dir, "documents"), vocabulary(), out)
    return rans.read_ids(spark, out)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with its fold, the predicted language and its probability; the held-out fold teaches nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where((_crc(4) != 2) & F.col("lang").isNotNull()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (F.coalesce(_crc(4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id with size and digest of its payload, and whether its record, read back from the packages, is a response or a revisit."""
    return archived(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and component with the whitened coordinate, the share of the variance, and the facts of the fit."""
    return Whitener(table(spark, sf_dir, "embeddings")).whiten()


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id with the faults of its damaged rows, the cost and audit of the cheapest repair, and a digest of what it gives."""
    return Repairer(damage(table(spark, sf_dir, "conversations")), gone="gone").repair()


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_sharding, op3_near_dedup, op4_bpe, op5_decontamination, op6_exact_dedup, op7_pii, op8_quality, op9_token_files, op10_language, op11_warc, op12_whitening, op13_conversation_repair)
}



# -- SQL -----------------------------------------------------------------------------------------------
#: Patterns of the oracle, whose regular expressions know no look-around: where the operator's have one, the pattern takes
#: the whole run of characters and the check looks at it.
_PII_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast('0' || right(p, 3) as integer) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", """length(replace(replace(m, ' ', ''), '-', '')) between 14 and 19 and list_sum(list_transform(range(1, length(replace(replace(m, ' ', ''), '-', '')) + 1),
        lambda i: list_extract(case when i % 2 = 0 then [0, 2, 4, 6, 8, 1, 3, 5, 7, 9] else [0, 1, 2, 3, 4, 5, 6, 7, 8, 9] end, 1 + cast(substr(replace(replace(m, ' ', ''), '-', ''), -i, 1) as integer)))) % 10 = 0"""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) between 10 and 15"),
    "iban": (r"[A-Za-z0-9]+", "regexp_matches(m, '^([A-Z]{2}|[a-z]{2})[0-9]{2}')"),
    "ssn": (r"[0-9-]{11,}", "regexp_matches(m, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') and not regexp_matches(m, '^(000|666|9)') and substr(m, 5, 2) <> '00' and right(m, 4) <> '0000'"),
    "secret": (r"[A-Za-z0-9+/_=-]{20,}", "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')"),
}


def _pii_sql() -> str:
    parts = []
    for k, (pattern, check) in _PII_SQL.items():
        parts.append(f"""{k}_m as (select r, text, m, start from (select r, text, ms[i] as m, sum(length(gaps[i])) over w + coalesce(sum(length(ms[i - 1])) over w, 0) as start
            from (select r, text, ms, gaps, unnest(range(1, len(ms) + 1)) as i from (select r, text, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as gaps from t) as x) as y
            window w as (partition by r order by i rows unbounded preceding)) as z where {check})""")
    lengths = "map {" + ", ".join(f"'{c}': {n}" for n, codes in pii.IBAN_LENGTHS.items() for c in codes.split()) + "}"
    value = "list_transform(string_split(upper(substr(code, 5) || substr(code, 1, 4)), ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)"
    parts.append(f"""iban_w as (select r, text, start, w, case when regexp_matches(w, '^[A-Z]') then regexp_extract(w, '^.{{4}}( ?[A-Z0-9]){{11,30}}') else regexp_extract(w, '^.{{4}}( ?[a-z0-9]){{11,30}}') end as body
            from (select r, text, start, substr(text, cast(start as integer) + 1, 65) as w from iban_m) as x),
        iban_e as (select r, text, start, w, e, replace(substr(w, 1, e), ' ', '') as code from (select r, text, start, w, unnest(range(15, length(body) + 1)) as e from iban_w) as x
            where substr(w, e, 1) <> ' ' and not regexp_matches(substr(w, e + 1, 1), '[A-Za-z0-9]')),
        iban_f as (select r, text, start, substr(any_value(w), 1, max(e)) as m from iban_e where length(code) >= 15 and length(code) = coalesce({lengths}[upper(substr(code, 1, 2))], length(code))
            and list_reduce({value}, lambda a, b: (a * (case when b > 9 then 100 else 10 end) + b) % 97) = 1 group by r, text, start)""")
    rows = []
    for no, k in enumerate(pii.KINDS):
        points = {"iban": "case when regexp_matches(m, '^[A-Z]') then 40 else 20 end", "secret": "case when regexp_matches(m, '" + pii.CHECKED["secret"].split("'")[1] + "') then 30 else 0 end"}.get(k, pii.CHECKED[k])
        near = f"case when regexp_matches(lower(substr(text, cast(greatest(start - {pii.CONTEXT}, 0) as integer) + 1, cast(least(start, {pii.CONTEXT}) as integer))), '{pii.KINDS[k][2]}') then {pii.NEARBY} else 0 end"
        wanted = "true" if k in pii.BASE else f"{pii.PROPOSED} + {points} + {near} >= {pii.THRESHOLD}"
        rows.append(f"select r, {no} as no, '{k}' as kind, cast(start as bigint) as s, cast(start as bigint) + length(m) as e from {'iban_f' if k == 'iban' else k + '_m'} where {wanted}")
    base = f"no < {len(pii.BASE)}"
    counts = ", ".join(f"coalesce(count(*) filter (kind = '{k}'), 0) as n_{k}" for k in pii.BASE)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' order by s, no)"
    return f"""with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents), {', '.join(parts)},
        span as ({' union all '.join(rows)}),
        per as (select r, {counts}, {joined} filter ({base}) as base, {joined} as spans, count(*) as n_spans from span group by r)
        select doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k in pii.BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_spans, 0) as n_spans
        from t left join per on per.r = t.r"""


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _warc_sql() -> str:
    """SHA-1 as base32: 32 digits of five bits, each cut out of three hex digits."""
    digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(sha1(h) || '0', {5 * i // 4 + 1}, 3) as integer) >> {7 - 5 * i % 4}) & 31), 1)" for i in range(32))
    return f"""
        with t as (select page_id, coalesce(html, '') as h from pages),
        g as (select page_id, h, row_number() over w as n, first_value(page_id) over w as first from t window w as (partition by h order by page_id nulls last))
        select page_id, cast(strlen(h) as bigint) as payload_bytes, {digits} as payload_digest, case when n = 1 then 'response' else 'revisit' end as record_type,
               case when n > 1 then first end as refers_to from g"""


def _repair_sql() -> str:
    """The cheapest edits row by row: for each state (the last initial so far; n for none) the least struct (cost, audit, turns),
    as structs sort by their fields in order."""
    follows, keeps = {"n": "u", "s": "u", "u": "a", "a": "u"}, {"n": "su", "s": "u", "u": "a", "a": "u"}
    named = {"u": "'user:'", "a": "'assistant:'"}

    def arc(state: str, cost: str, letter: str, turn: str | None = None) -> str:
        added = "" if turn is None else f" || case when regexp_matches({state}.audit, '[IKR]') then chr(10) else '' end || {turn}"
        return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'turns': {state}.turns{added}}}"

    steps = {k: [arc(k, "4", "D")] for k in follows}
    for k, to in follows.items():
        steps[to].append(f"case when not gone then {arc(k, 'case when cut then 6 else 3 end', 'R', named[to] + ' || text')} end")
        for i in keeps[k]:
            steps[i].append(f"case when not gone and initial = '{i}' then {arc(k, 'case when cut then 3 else 0 end', 'K', "role || ':' || text")} end")
    over_row = ", ".join(f"least({', '.join(steps[k])}) as {k}" for k in follows)
    lost = "{'cost': 1000000000, 'audit': '', 'turns': ''}"
    crc = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, length(k) + 1), lambda i: cast(ascii(substr(k, i, 1)) as bigint))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), cast([0, 0, 0, 0, 0, 0, 0, 0] as bigint[])), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""

    def inserted(source: str) -> str:
        """A turn put in after any state: to u, then to a."""
        to_u = f"select conv_id, i, n, s, least(u, {', '.join(arc(k, '3', 'I', named['u']) for k in 'nsa')}) as u, a from ({source}) as moved"
        return f"select conv_id, i, n, s, u, least(a, {arc('u', '3', 'I', named['a'])}) as a from ({to_u}) as begun"

    return f"""
        with recursive k as (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
        f as (select conv_id, turn, {crc} % 20 as fate, coalesce(role, ' ') as role, coalesce(text, ' ') as text from k),
        d as (select conv_id, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
              from f, (select unnest([0, 1]) as copy) as c where fate <> 0 and (copy = 0 or fate = 3)),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, left(role, 1) as initial,
              rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as shown from d),
        m as (select *, shown = '' as blank, shown <> '' and row_number() over (partition by conv_id, role, text order by i) > 1 as again, right(shown, 1) not in ('.', '!', '?') as open_end,
              lag(initial) over (partition by conv_id order by i) || initial as pair from o),
        rows_of as (select *, blank or again as gone, not blank and not again and open_end as cut from m),
        facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again) as duplicate,
              count(*) filter (cut) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n_rows from rows_of group by conv_id),
        every as (select distinct conv_id from conversations),
        r as ({inserted(f"select conv_id, cast(0 as bigint) as i, {{'cost': 0, 'audit': '', 'turns': ''}} as n, {lost} as s, {lost} as u, {lost} as a from every")}
            union all {inserted(f"select r.conv_id, r.i + 1 as i, {over_row} from r join rows_of as x on x.conv_id is not distinct from r.conv_id and x.i = r.i + 1")}),
        best as (select r.conv_id, least(n, a) as b from r left join facts on facts.conv_id is not distinct from r.conv_id where r.i = coalesce(n_rows, 0))
        select best.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               cast(b.cost as bigint) as cost, b.audit as audit, sha256(b.turns) as repaired_sha256
        from best left join facts on facts.conv_id is not distinct from best.conv_id"""


ORACLES = {
    "op13_conversation_repair": _repair_sql(),
    "op7_pii": _pii_sql(),
    "op11_warc": _warc_sql(),
    "op2_sharding": "select doc_id, lang, source, n_chars, sha256(coalesce(text, '')) as text_sha256 from documents",
    "op3_near_dedup": rf"""
        with recursive t as (select doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct doc_id, list_slice(w, i, i + 2) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from t where len(w) > 0) as x),
        n as (select doc_id, count(*) as n from s group by doc_id),
        common as (select a.doc_id as x, b.doc_id as y, count(*) as c from s as a join s as b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
        link as (select x, y from common join n as p on p.doc_id = x join n as q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
        edge as (select x, y from link union all select y, x from link),
        reach as (select doc_id as a, doc_id as b from t union select reach.a, edge.y from reach join edge on edge.x = reach.b),
        comp as (select a, min(b) as component_id from reach group by a)
        select t.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, t.doc_id = component_id as kept
        from t left join n on n.doc_id = t.doc_id join comp on comp.a = t.doc_id""",
    "op5_decontamination": rf"""
        with d as (select doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        i as (select cast(item_id as varchar) as item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
        iw as (select distinct item_id, least(len(w), 10) as size, list_slice(w, s, s + least(len(w), 10) - 1) as g
               from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)),
        sizes as (select distinct size from iw),
        dw as (select doc_id, s, size, list_slice(w, s, s + size - 1) as g
               from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as s from d, sizes where len(w) >= size)),
        hit as (select dw.doc_id, dw.s, dw.size, iw.item_id from dw join iw on dw.g = iw.g and dw.size = iw.size),
        n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from hit) as x group by doc_id),
        it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from hit) as x group by doc_id)
        select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join n on d.doc_id = n.doc_id left join it on d.doc_id = it.doc_id""",
    "op6_exact_dedup": r"""
        with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as x from documents),
        g as (select doc_id, x, first_value(doc_id) over (partition by x order by n desc, doc_id) as keep_id, count(*) over (partition by x) as group_size from t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(x) as text_sha256 from g""",
}
