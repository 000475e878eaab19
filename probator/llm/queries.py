"""The corpus operators as queries over the given tables: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import ctw, decontaminate, lz_dedup, mixing, ngram_join, pii, quality, suffix_dedup, token_counts, urls


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules over all documents. A null or empty text has no words and fails; rows with one id are rated one by one."""
    rated = quality.rate_documents(C.table(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte model's score of every document. A null or empty text is its end alone; rows with one id are scored one by one."""
    scored = ctw.score_documents(C.table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeats cover. A null or empty text, and one of fewer than 200 bytes, keeps all it has; exact copies remove each other."""
    return suffix_dedup.remove_repeats(C.table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that earlier passages have. Null ids come first; of rows with one id the earlier in the table counts as earlier. A null or empty text has no words."""
    return lz_dedup.remove_passages(C.table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document. A null or empty text has none; counts and base_sha256 are of the fixed patterns, spans also has what the field adds."""
    found = pii.find_pii(C.table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component. A null or empty text has an empty set and is alone; equal texts are one component."""
    return ngram_join.similar_documents(C.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. A null source is a source, last in order; a text without words is taken with no effect."""
    mixed = mixing.mix_sources(C.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files. A null or empty text has none."""
    return token_counts.count_tokens(C.table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. A null or empty text has no words; an item without words or id finds nothing."""
    found = decontaminate.find_contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url. A null url, or one without ://, has an empty host and path and is judged by the reputation of all."""
    return urls.filter_urls(C.table(spark, sf_dir, "pages"), C.table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_lm_scoring, op3_suffix_array_dedup, op4_substring_dedup, op5_pii, op6_ngram_jaccard_join, op7_mix_sources, op8_token_counts, op9_decontamination, op10_url_filters)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SYMBOLS = "length({0}) - length(regexp_replace({0}, '[#*$%&|<>]', '', 'g'))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _line_ok() -> str:
    count = r"length(regexp_extract_all(s, '[^\x20\x09-\x0D]+'))"
    symbols = _SYMBOLS.format("s")
    punctuation = f"(not contains({_quoted(quality.ENDS)}, right(rtrim(s, ' '), 1)) and {count} < {quality.SHORT_LINE}) or ({symbols}) > {quality.SYMBOL_SHARE} * {count}"
    return f"not ({punctuation} or regexp_matches(s, {_quoted(quality.NAVIGATION)}) or regexp_matches(s, {_quoted(quality.BOILERPLATE)}))"


_COMPONENTS = """
    edges as (select a, b from links union select b, a from links),
    reach(doc, other) as (select doc_id, doc_id from sizes union select r.doc, e.b from reach r join edges e on e.a = r.other)"""

ORACLE_SQL = {
    "op1_quality_rules": rf"""
        with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
        m as (select *, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) as lines from d),
        win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
        dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from win) where n > 1),
        rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from dup) group by doc_id),
        kept as (select doc_id, sum(length(regexp_extract_all(s, '[^\x20\x09-\x0D]+'))) as n from (select doc_id, unnest(lines) as s from m) where {_line_ok()} group by doc_id),
        r as (select m.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, ({_SYMBOLS.format('text')})::bigint as n_symbols,
              (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(kept.n, 0) as n_kept
              from m left join rep on rep.doc_id = m.doc_id left join kept on kept.doc_id = m.doc_id)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - n_kept <= {quality.MAX_LOSS} * n_words as kept from r""",
    "op3_suffix_array_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        n as (select doc_id, h, length(h) // 2 as n from d),
        win as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as k from (select doc_id, h, unnest(range(0, greatest(n - 199, 0))) as i from n)),
        hit as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as c from win) where c > 1),
        gaps as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before, lead(i) over (partition by doc_id order by i) as after from hit),
        firsts as (select doc_id, i as a, row_number() over (partition by doc_id order by i) as k from gaps where before is null or i > before + 200),
        lasts as (select doc_id, i + 200 as b, row_number() over (partition by doc_id order by i) as k from gaps where after is null or after > i + 200),
        runs as (select f.doc_id, a, b, k, lag(b, 1, 0) over (partition by f.doc_id order by k) as past from firsts f join lasts l using (doc_id, k)),
        parts as (select r.doc_id, string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' order by k) as kept, max(b) as tail, sum(b - a) as gone, count(*) as spans from runs r join n using (doc_id) group by r.doc_id)
        select n.doc_id, n.n::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
               sha256(unhex(coalesce(p.kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) as kept_sha256
        from n left join parts p using (doc_id)""",
    "op4_substring_dedup": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        win as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as i from d)),
        hit as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as c from win) where c > 1),
        gone as (select distinct doc_id, i + j as p from hit, (select unnest(range(0, 20)) as j)),
        kept as (select doc_id, string_agg(x, ' ' order by p) as text, count(*) as n from (select doc_id, w[p] as x, p from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)) anti join gone using (doc_id, p) group by doc_id)
        select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op6_ngram_jaccard_join": f"""
        with recursive d as (select doc_id, list_transform({_WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
        s as (select distinct doc_id, md5(array_to_string(w[i:i + 4], ' ')) as k from (select doc_id, w, unnest(range(1, case when len(w) = 0 then 1 else greatest(len(w) - 3, 2) end)) as i from d)),
        sizes as (select doc_id, count(k) as n from d left join s using (doc_id) group by doc_id),
        links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.k = y.k and x.doc_id < y.doc_id group by all)
                  join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 75 * (p.n + q.n - c)),{_COMPONENTS}
        select doc_id, n::bigint as n_shingles, m as component_id from sizes join (select doc, min(other) as m from reach group by doc) on doc = doc_id""",
    "op9_decontamination": r"""
        with d as (select doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_az from documents)),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        q as (select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + 9], ' ') as k from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from b where len(w) > 0)),
        win as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as k from (select doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) as i from d, (select distinct size from q))),
        hit as (select doc_id, i, win.size, item_id from win join q on q.k = win.k and q.size = win.size),
        words as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + size)) as p from hit) group by doc_id),
        items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
        select d.doc_id, len(d.w)::bigint as n_words, coalesce(words.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
        from d left join words using (doc_id) left join items using (doc_id)""",
}


def _url_sql() -> str:
    def level(name, child, keys, parent, prior_on):
        prior = f"select c.*, p.prior from {child} c join {parent} p {prior_on}"
        return f"""
        {name}_in as ({prior}),
        {name}_k as (select round(least({urls.MOST}, greatest({urls.LEAST}, coalesce(case when spread > 0 then pq / spread - 1 end, {urls.STRENGTH}))), 6) as strength from (
            select avg(case when n > 0 then prior * (1 - prior) end) as pq, (sum(case when n > 0 then n * (good / n - prior) * (good / n - prior) end) - sum(case when n > 0 then prior * (1 - prior) end)) / nullif(sum(n) - count(*) filter (n > 0), 0) as spread from {name}_in)),
        {name} as (select {keys}, n, strength, (good + strength * prior) / (n + strength) as prior from {name}_in, {name}_k)"""

    rules = sorted(urls.RULES, key=lambda r: -len(r[1]))
    fits = {r: f"(host = {_quoted(r.partition('/')[0])} or suffix(host, {_quoted('.' + r.partition('/')[0])})) and prefix(path, {_quoted('/' + r.partition('/')[2])})" for _, r in rules}
    rule = "case " + " ".join(f"when {fits[r]} then {_quoted(r)}" for _, r in rules) + " end"
    verdict = "case " + " ".join(f"when {fits[r]} then {_quoted(v)}" for v, r in rules) + f" when round(prior - {urls.Z} * sqrt(prior * (1 - prior) / (n + strength + 1)), 6) >= {urls.THRESHOLD} then 'allow' else 'block' end"
    return rf"""
        with u as (select page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
        o as (select doc_id, max(quality) as good from labels where quality in (0, 1) group by doc_id),
        v as (select *, regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g') as site from u),
        t as (select *, case when regexp_matches(site, '^[0-9]+(\.[0-9]+){{3}}$') then site when regexp_matches(site, '(^|\.)({'|'.join(urls.INNER)})\.[a-z][a-z]$') then array_to_string(string_split(site, '.')[-2:], '.') else string_split(site, '.')[-1] end as suffix from v),
        w as (select *, case when site = suffix then site else string_split(left(site, length(site) - length(suffix) - 1), '.')[-1] || '.' || suffix end as domain from t),
        h as (select site, suffix, domain, count(doc_id)::double as n, coalesce(sum(good), 0)::double as good from w left join o on page_id = doc_id group by all),
        d as (select suffix, domain, sum(n) as n, sum(good) as good from h group by suffix, domain),
        s as (select suffix, sum(n) as n, sum(good) as good from d group by suffix),
        whole as (select coalesce((sum(good) + 1) / (sum(n) + 2), 0.5) as prior from s),
        {level('sp', 's', 'suffix', 'whole', 'on true')}, {level('dp', 'd', 'suffix, domain', 'sp', 'using (suffix)').replace('c.*, p.prior', 'c.suffix, c.domain, c.n, c.good, p.prior')}, {level('hp', 'h', 'site', 'dp', 'using (suffix, domain)').replace('c.*, p.prior', 'c.site, c.n, c.good, p.prior')}
        select page_id, host, path, {rule} as rule, {verdict} as verdict from w join hp using (site)"""


ORACLE_SQL["op10_url_filters"] = _url_sql()
