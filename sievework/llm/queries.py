"""One query for each operator of this folder, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import brown, decontamination, language, lloyd, mixing, pages, passages, quality, secrets, sharding, simhash, tokens, trie
from sievework.llm.common import documents, is_remainder, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of each document under its language's and source's own limits."""
    found = quality.judged(documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", " ").alias("failed"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document in a public byte-level vocabulary."""
    import public_tokenizers

    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    table = load(spark, sf_dir, "pages")
    return pages.main_text(table, pages.fit(table), carry=["page_id", "url"])


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix(documents(spark, sf_dir), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from the documents that aren't held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", is_remainder(F.col("doc_id"), 3, 1))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.identify(docs, model, carry=["doc_id", "held_out"])


@query
def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal row counts, each with every source's share."""
    placed = sharding.shard(documents(spark, sf_dir), 8, carry=["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its best window."""
    found = decontamination.leaks(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", F.col("distance").cast("int").alias("distance"), F.col("at").alias("first_word"), F.col("size").alias("n_words"))


@query
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of passages that repeat across documents, and which of them go."""
    return passages.repeats(documents(spark, sf_dir))


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of each document under the class model and under word counts."""
    return brown.score(documents(spark, sf_dir), held_out=is_remainder(F.col("doc_id"), 5, 1), carry=["doc_id"])


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of each document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("root").alias("component_id"))


@query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each vector after ten exact rounds over column blocks."""
    return lloyd.cluster(load(spark, sf_dir, "embeddings"), k=8, dims=64, rounds=10, seed=3)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the conversations' prefix trie."""
    return trie.prefix_trie(load(spark, sf_dir, "conversations"))


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, from a ledger of contents that starts empty."""
    ledger = secrets.Ledger(spark)
    found = secrets.findings_of(secrets.scan(documents(spark, sf_dir), ledger, path="doc_id"), ledger)
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    base = F.filter(spans, lambda s: s["rank"] < len(secrets.BASE))
    counts = [secrets.count_of(spans, r.kind).alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, secrets.digest_of(base).alias("base_sha256"), secrets.listed(spans).alias("spans"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages from raw documents to shards."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op4_mix_sources"] = f"""
with d as (
    select doc_id, case when source is null then 'n' else 'a' || source end g, len({_WORDS})::bigint size,
        md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '')) k
    from documents),
s as (select g, sum(size)::bigint source_size, (row_number() over (order by g) - 1) % 3 + 1 w from d group by g),
r as (select *, 3.0::double * source_size cap, 3.0::double * source_size / w ratio from s),
l as (
    select *, (1.0::double * sum(source_size) over () - 3.0::double * coalesce(sum(source_size) over p, 0)::double)
            / (sum(w) over () - coalesce(sum(w) over p, 0))::double lev
    from r window p as (order by ratio, g rows between unbounded preceding and 1 preceding)),
f as (select arg_min(lev, (ratio, g)) lev from l where lev <= ratio),
t as (select g, source_size, least(cap, coalesce((select lev from f) * w, cap)) target from l),
e as (select g, source_size, target, case when source_size > 0 then floor(target)::bigint // source_size else 0 end epochs,
        case when source_size > 0 then floor(target)::bigint % source_size else 0 end rest from t),
b as (select *, sum(size) over (partition by g order by k, size rows unbounded preceding) - size before from d)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint taken
from b join e using (g)
"""

_BLANKS = r"[^\x20\x09-\x0D]"
_MEASURES = {
    "symbols": ("n_symbols", "word_chars"), "marks": ("n_marks", "word_chars"), "capitals": ("n_upper", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"), "variety": ("n_distinct", "n_words"),
}
_LONG = ", ".join(f"{{'m': '{m}', 'v': case when {b} > 0 then 1000 * {a} // {b} else 0 end}}" for m, (a, b) in _MEASURES.items())
_LEAST = "case m " + " ".join(f"when '{m}' then {quality.MEASURES[m][1]}" for m in _MEASURES) + " end"
_SIDE = "case m " + " ".join(f"when '{m}' then '{quality.MEASURES[m][0]}'" for m in _MEASURES) + " end"


def _limits(name: str, by: str) -> str:
    """Fences of the groups ``by``, from the bins of ``binned``."""
    keys = f"{by}, m" if by else "m"
    return f"""{name}_c as (select {keys}, bin, sum(n) over (partition by {keys} order by bin) upto, sum(n) over (partition by {keys}) total
        from (select {keys}, bin, sum(n) n from binned group by {keys}, bin)),
    {name}_q as (select {keys}, max(total) n, min(bin) filter (upto >= total * 0.25) q0, min(bin) filter (upto >= total * 0.75) q2 from {name}_c group by {keys}),
    {name} as (select {keys}, n, case when {_SIDE} = 'high' then -1 else q0 - 3 * greatest(q2 - q0, {_LEAST}) end low,
        case when {_SIDE} = 'low' then 4611686018427387904 else q2 + 3 * greatest(q2 - q0, {_LEAST}) end high from {name}_q)"""


def _missing(letters: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{letters}', '', 'g')))"


ORACLE["op1_quality_rules"] = f"""
with d as (
    select row_number() over () r, doc_id, coalesce(text, '') t, case when lang is null then 'n' else 'a' || lang end l, case when source is null then 'n' else 'a' || source end s,
        {_WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_BLANKS}')) ls from documents),
p as (select r, generate_subscripts(w, 1) i from d),
g as (select r, i, array_to_string(w[i:i + 4], ' ') g from (select r, w, unnest(generate_series(1, len(w) - 4)) i from d where len(w) >= 5)),
f as (select r, i from (select r, i, count(*) over (partition by r, g) c from g) where c > 1),
e as (select r, i, max(case when f.i is null then 0 else 1 end) over (partition by r order by i rows between 4 preceding and current row) x from p left join f using (r, i)),
n as (select r, count(*) n from e where x = 1 group by r),
c as (
    select r, doc_id, l, s, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, {_missing("[#*$%&|<>]")}::bigint n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n.n, 0)::bigint n_repeat_words, len(ls) n_lines, {_missing(r"\p{Lu}")} n_upper, {_missing("!")} n_marks, len(list_distinct(w)) n_distinct
    from d left join n using (r)),
k as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from c),
u as (select r, l, s, base_failed, x.m m, x.v v from (select r, l, s, base_failed, unnest([{_LONG}]) x from k)),
binned as (select l, s, m, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) bin, count(*) n from u where not base_failed group by all),
{_limits("mine", "l, s")},
{_limits("language", "l")},
{_limits("every", "")},
v as (
    select r, m, case when a.n >= 200 then v < a.low or v > a.high when b.n >= 200 then v < b.low or v > b.high else v < o.low or v > o.high end outside
    from u left join mine a using (l, s, m) left join language b using (l, m) left join every o using (m)),
x as (select r, coalesce(string_agg(m, ' ' order by list_position({list(_MEASURES)}, m)) filter (outside), '') failed from v group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed = '' kept, failed from k join x using (r)
"""

ORACLE["op6_shard"] = f"""
with tab as (select list(v order by n) tab from (
    select n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from (select unnest(range(256)) n))),
d as (select doc_id, case when source is null then 'n' else 'a' || source end g, hex(coalesce(text, '')) h, md5('{sharding.SEED}:' || coalesce(doc_id::varchar, '')) k from documents),
c as (select doc_id, g, k, length(h) // 2 + 1 size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) crc from d, tab),
r as (select *, ((row_number() over (partition by g order by k, crc, size) - 1) + ('0x' || substr(md5('{sharding.SEED}:' || g), 1, 8))::bigint / 4294967296.0::double) / count(*) over (partition by g) lie from c),
p as (select *, row_number() over (order by lie, g, k, crc, size) - 1 pos, count(*) over () n from r),
s as (select *, pos * 8 // n shard from p)
select doc_id, size::bigint size, crc::bigint text_crc32, 'rows' law, shard::int shard, (pos - (shard * n + 7) // 8)::bigint slot, null::int grown_shard from s
"""


def _round(i: int) -> str:
    """Clusters of the vectors under centroids ``i``, and centroids ``i + 1``."""
    return f"""a{i} as materialized (
        select v.r, v.vec_id, any_value(v.x) x, arg_min(c.cluster, (list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, c.cluster)) cluster,
            min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint) distance
        from v, c{i} c group by v.r, v.vec_id),
    m{i} as (select cluster, j, sum(e) s, count(*) n from (select cluster, unnest(x) e, generate_subscripts(x, 1) j from a{i}) group by all),
    c{i + 1} as materialized (
        select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by j) x from m{i} group by cluster
        union all select cluster, x from c{i} where cluster not in (select cluster from a{i}))"""


ORACLE["op11_centroid_clusters"] = f"""
with v as materialized (
    select row_number() over () r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) x from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
c0 as materialized (select row_number() over (order by h, x) - 1 cluster, x from (select sha256('3:' || coalesce(vec_id::varchar, '')) h, x from v order by h, x limit 8)),
{", ".join(_round(i) for i in range(11))}
select vec_id, cluster::int cluster, distance, sum(distance) over (partition by cluster)::bigint cluster_inertia, sum(distance) over ()::bigint inertia,
    sha256(array_to_string(c.x, ',')) centroid_sha256
from a10 join c10 c using (cluster)
"""

_CRC_TABLE = "select list(v order by n) tab from (select n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from (select unnest(range(256)) n))"

ORACLE["op12_prefix_trie"] = f"""
with tab as ({_CRC_TABLE}),
t as (
    select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) pos,
        md5(md5(coalesce(text, '')) || coalesce(role, '')) m, length(coalesce(text, '')) n
    from conversations where conv_id is not null),
ids as (
    select c, c - c % 100 base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(c::varchar)), lambda i: ascii(substr(c::varchar, i + 1, 1))::bigint)),
        lambda x, b: xor(x >> 8, tab[xor(x & 255, b) + 1]))) % 6 h
    from (select distinct c from t), tab),
r as (
    select ids.c, 0 own, pos, m, n from ids join t on t.c = ids.base where pos <= h
    union all select ids.c, 1, pos, m, n from ids join t on t.c = ids.c where pos > h),
p as (select ids.c, coalesce(ms, []) ms, coalesce(ns, []) ns from ids left join (select c, list(m order by own, pos) ms, list(n order by own, pos) ns from r group by c) using (c)),
pre as (select c, d, len(ms) deep, case when d = 0 then '' else md5(array_to_string(ms[1:d], ',')) end k, case when d = 0 then 0 else ns[d] end n
    from (select *, unnest(range(len(ms) + 1)) d from p)),
up as (select *, lag(k) over (partition by c order by d) pk from pre),
nodes as (select k, d, any_value(pk) pk, min(c) c, count(*) convs, any_value(n) n, string_agg(c::varchar, ',' order by c) filter (deep = d) ends from up group by k, d),
kids as (select pk k, count(*) kids from nodes where d > 0 group by pk),
sub as (select pre.k, pre.d, sum((nodes.convs - 1) * nodes.n) saved, count(*) filter (kids is null) leaves
    from nodes left join kids on kids.k = nodes.k join pre on pre.c = nodes.c and pre.d <= nodes.d group by pre.k, pre.d)
select a.c conv_id, a.d::bigint depth, b.c parent_conv_id, a.convs::bigint n_convs, coalesce(kids, 0)::bigint n_children, leaves::bigint n_leaves,
    saved::bigint saved_tokens, sha256(coalesce(a.ends, '')) ends_sha256
from nodes a left join nodes b on b.k = a.pk and b.d = a.d - 1 left join kids on kids.k = a.k join sub on sub.k = a.k and sub.d = a.d
"""


def _spans(rank: int, rule: secrets.Rule) -> str:
    """(r, start, rank, kind, stop) of a rule: what lies between its matches gives their places."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
    select r, start, {rank} as rank, '{rule.kind}' as kind, start + length(m) as stop from (
        select r, unnest(ms) m, unnest(gs) g, unnest(list_transform(range(len(ms)), lambda i:
            coalesce(list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0)::bigint)) start
        from (select r, regexp_extract_all(t, '{pattern}') ms, regexp_extract_all(t, '{pattern}', {rule.group}) gs, string_split_regex(t, '{pattern}') gaps from d))
    where length(g) >= {rule.least}"""


_LISTED = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank)"
ORACLE["op13_secret_scan"] = f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
s as ({" union all ".join(_spans(i, r) for i, r in enumerate(secrets.RULES))})
select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
    sha256({_LISTED} filter (rank < {len(secrets.BASE)}), '')) base_sha256, {_LISTED} filter (rank is not null), '') spans
from d left join s using (r) group by r, doc_id
"""
