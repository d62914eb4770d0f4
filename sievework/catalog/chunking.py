"""Chunking jobs. The tables break paragraphs with single newlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.base import query
from sievework.functions.text import split_paragraphs, unnest
from sievework.operators import chunks
from sievework.plans.flows import clean_and_chunk

_PARAS = "list_filter([trim(y) for y in string_split(text, chr(10))], lambda z: z <> '')"


@query(
    "c01_split_paragraphs",
    f"select doc_id, unnest(l) as paragraph, cast(generate_subscripts(l, 1) - 1 as int) as pos from (select doc_id, {_PARAS} as l from documents)",
)
def c01(t):
    return unnest(t("documents"), ["doc_id"], split_paragraphs(F.col("text"), "\n"), "paragraph", "pos")


# Packing as a fold over the paragraphs: the last entry of the list is the open chunk, its
# paragraphs are joined by one control character, so its counted length can be read off it.
_OPEN = "length(acc[-1]) + 3 * (length(acc[-1]) - length(replace(acc[-1], chr(1), '')) + 1) + 1"
_ADD = "case when acc[-1] = '' then list_concat(acc[:-2], [x[1]]) else list_concat(acc[:-2], [concat(acc[-1], chr(1), x[1])]) end"


def _fixed_sql(text: str, step: int) -> str:
    return f"list_transform(range(0, length({text}), {step}), lambda o: substring({text}, o + 1, {step}))"


def _sentences_sql(text: str, size: int) -> str:
    """C04 as a fold; open chunks are joined by a space."""
    return rf"""list_filter(list_reduce(list_transform(string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda s: [s]),
      lambda acc, x: case when length(x[1]) > {size} then list_concat(acc, {_fixed_sql('x[1]', size)}, [''])
        when acc[-1] = '' then list_concat(acc[:-2], [x[1]])
        when length(acc[-1]) + 1 + length(x[1]) > {size} then list_append(acc, x[1])
        else list_concat(acc[:-2], [concat(acc[-1], ' ', x[1])]) end, ['']), lambda z: z <> '')"""


def _pack_sql(size: int, long: str, fresh: str = "x[1]") -> str:
    """Chunks of column ``ps`` (paragraphs)."""
    return f"""list_transform(list_filter(list_reduce(list_transform(ps, lambda s: [s]),
      lambda acc, x: case when length(x[1]) > {size} then list_concat(acc, {long}, [''])
        when acc[-1] <> '' and {_OPEN} + length(x[1]) > {size} then list_append(acc, {fresh})
        else {_ADD} end, ['']), lambda z: z <> ''), lambda z: replace(z, chr(1), chr(10) || chr(10)))"""


# the tail of the open chunk, newest paragraph first: [length so far, stop flag, joined tail]
_TAIL = """list_reduce(list_transform(list_reverse(string_split(acc[-1], chr(1))), lambda p: ['', '', p]),
    lambda t, p: case when t[2] = 'x' then t
      when cast(t[1] as int) + length(p[3]) > 300 and t[3] <> '' and cast(t[1] as int) + length(p[3]) > 600 then [t[1], 'x', t[3]]
      else [cast(cast(t[1] as int) + length(p[3]) + 4 as varchar), case when cast(t[1] as int) + length(p[3]) + 4 >= 300 then 'x' else '' end,
        case when t[3] = '' then p[3] else concat(p[3], chr(1), t[3]) end] end, ['0', '', ''])[3]"""


@query(
    "c02_chunk_text",
    f"""with p as (select doc_id, text, {_PARAS} as ps from documents),
    c as (select doc_id, case when len(ps) = 0 then [] when length(text) <= 2000 then [text] else {_pack_sql(2000, _sentences_sql('x[1]', 2000), f"concat({_TAIL}, chr(1), x[1])")} end as l from p)
    select doc_id, len(l) as total_chunks, unnest(l) as chunk, generate_subscripts(l, 1) - 1 as chunk_index from c""",
)
def c02(t):
    return chunks.chunk_text(t("documents", True), "doc_id", "text", 2000, 300, "\n")


_CUT = "select doc_id, cast(i as int) as pos, substring(text, i * 900 + 1, 900) as piece from documents, range(0, 200) r(i) where i * 900 < greatest(length(text), 1)"


@query("c03_split_fixed", _CUT)
def c03(t):
    return t("documents", True).select("doc_id", F.posexplode(chunks.cut_fixed(F.col("text"), 900)).alias("pos", "piece"))


@query(
    "c04_split_sentences_pack",
    f"with c as (select doc_id, {_sentences_sql('text', 400)} as l from documents) select doc_id, unnest(l) as piece, generate_subscripts(l, 1) - 1 as pos from c",
)
def c04(t):
    packed = chunks.split_sentences_pack(F.col("text"), 400)
    return unnest(t("documents", True), ["doc_id"], packed, "piece", "pos")


@query(
    "c05_overlap_tail",
    f"""with p as (select doc_id, unnest(l) as x, len(l) - generate_subscripts(l, 1) + 1 as i from (select doc_id, {_PARAS} as l from documents)),
    c as (select *, length(x) as n, coalesce(sum(length(x) + 4) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as b from p),
    f as (select *, (b + n <= 300 and b < 300) as fits from c),
    s as (select *, coalesce((select min(i) from f g where g.doc_id = f.doc_id and not g.fits), 1000000) as stop from f),
    k as (select * from s where i < stop or (i = stop and b < 300 and (i = 1 or b + n <= 600)))
    select d.doc_id, coalesce(string_agg(x, '|' order by i desc), '') as tail, coalesce(sum(n + 4), 0) as tail_length from documents d left join k using (doc_id) group by 1""",
)
def c05(t):
    tail = chunks.overlap_tail(split_paragraphs(F.col("text"), "\n"), 300)
    return t("documents", True).select("doc_id", F.array_join(tail["cur"], "|").alias("tail"), tail["n"].alias("tail_length"))


def _sourced(t):
    return t("documents", True).select(
        "source",
        "doc_id",
        "text",
        F.concat(F.lit("https://example.org/"), F.col("lang"), F.lit("/"), (F.col("doc_id") % 3).cast("string")).alias("url"),
        F.col("lang").alias("title"),
        F.lit("corpus").alias("search_query"),
    )


def _flat(df, group):
    sources = F.array_join(F.transform("sources", lambda s: F.concat(s["url"], F.lit(" "), s["title"])), "; ")
    return df.select(group, F.coalesce("part", F.lit(-1)).alias("part"), "chunk_index", "total_chunks", "chunk", sources.alias("sources"))


def _batch_sql(texts: str, size: int, pattern: str = "chr(10)") -> str:
    """C06 one paragraph after the other: ``texts`` has g, o, text, url, title; of a source its URL and title are shown."""
    return f"""with recursive t as (select *, row_number() over (partition by g order by o) k from ({texts}) where trim(text, chr(9) || chr(10) || chr(13) || ' ') <> ''),
    tot as (select g, sum(length(text)) + (count(*) - 1) * 6 <= {size} fits from t group by g),
    line as (select g, k, '--- SOURCE: ' || coalesce(title, 'Unknown') || ' | URL: ' || coalesce(url, 'Unknown') || ' ---' l from t),
    item as (
      select g, row_number() over (partition by g order by k, i) j, p, length(p) n, url, title from (
        select t.g, k, unnest(ps) p, generate_subscripts(ps, 1) i, url, title from (select *, list_filter([trim(y) for y in string_split(text, {pattern})], lambda z: z <> '') ps from t) t
        union all select g, k, l, 0, null, null from line where k > 1) join tot using (g) where not fits),
    walk as (
      select g, j, j s, case when n > {size} then 0 else n + 4 end acc, n > {size} long from item where j = 1
      union all
      select i.g, i.j, case when i.n > {size} or w.long or w.acc + i.n > {size} then i.j else w.s end,
        case when i.n > {size} then 0 when w.long or w.acc + i.n > {size} then i.n + 4 else w.acc + i.n + 4 end, i.n > {size}
      from walk w join item i on i.g = w.g and i.j = w.j + 1),
    kept as (select g, s, url, min(j) place, arg_max(title, j) title from walk join item using (g, j) where not long and url <> '' group by all),
    told as (select g, s, string_agg(url || ' ' || title, '; ' order by place) sources from kept group by all),
    made as (
      select g, s, 0::bigint piece, string_agg(p, chr(10) || chr(10) order by j) chunk, coalesce(any_value(sources), '') sources from walk join item using (g, j) left join told using (g, s) where not long group by g, s
      union all select g, s, unnest(range(0, n, {size - 100})), unnest({_fixed_sql('p', size - 100)}), coalesce(url || ' ' || title, '') from walk join item using (g, j) where long
      union all select g, 1, 0, string_agg(case when k > 1 then l || chr(10) || chr(10) else '' end || text, chr(10) || chr(10) order by k), string_agg(url || ' ' || title, '; ' order by k)
        from t join line using (g, k) join tot using (g) where fits group by g)
    select g, -1 as part, row_number() over (partition by g order by s, piece) - 1 as chunk_index, count(*) over (partition by g) as total_chunks, chunk, sources from made"""


_TURNS = "select conv_id g, turn o, text, 'https://chat.example.org/' || role url, role title from conversations"


@query("c06_chunk_batch", f"select g as conv_id, * exclude (g) from ({_batch_sql(_TURNS, 1500)})")
def c06(t):
    """Conversations, the long ones packed block by block."""
    turns = t("conversations").select(
        "conv_id", "turn", "text",
        F.concat(F.lit("https://chat.example.org/"), "role").alias("url"), F.col("role").alias("title"), F.lit("chat").alias("search_query"),
    )
    return _flat(chunks.chunk_batch(turns, "conv_id", "turn", "text", 1500, "\n"), "conv_id")


@query(
    "c06_chunk_batch_large_groups",
    f"""with c as (select source, doc_id as part, concat('https://example.org/', lang, '/', doc_id % 3, ' ', lang) as sources,
      {_pack_sql(2000, _fixed_sql('x[1]', 1900))} as l from (select *, {_PARAS} as ps from documents))
    select source, part, sources, len(l) as total_chunks, unnest(l) as chunk, generate_subscripts(l, 1) - 1 as chunk_index from c""",
)
def c06_large(t):
    """Documents by source, above the limit from which texts are chunked apart."""
    return _flat(chunks.chunk_batch(_sourced(t), "source", "doc_id", "text", 2000, "\n", apart_above=5), "source")


_BY_SOURCE = "select source g, doc_id o, text, concat('https://example.org/', lang, '/', doc_id % 3) url, lang title from documents"


@query("c06_chunk_batch_streams", f"select g as source, * exclude (g) from ({_batch_sql(_BY_SOURCE, 2000)})")
def c06_streams(t):
    """Documents by source, each source one stream."""
    return _flat(chunks.chunk_batch(_sourced(t), "source", "doc_id", "text", 2000, "\n"), "source")


@query(
    "c07_chunk_each",
    f"""with c as (select doc_id, {_pack_sql(2000, _fixed_sql('x[1]', 1900))} as l from (select doc_id, {_PARAS} as ps from documents))
    select doc_id, len(l) as total_chunks, unnest(l) as chunk, generate_subscripts(l, 1) - 1 as chunk_index from c""",
)
def c07(t):
    return chunks.chunk_each(t("documents", True).select("doc_id", "text"), "doc_id", "text", 2000, "\n")


@query("c08_clean_and_chunk")
def c08(t):
    out = clean_and_chunk(t("pages").withColumn("site", F.col("page_id") % 50), "site", "page_id", 3000)
    return _flat(out, "site")


@query(
    "c09_chunk_stats",
    f"select count(*) as chunks, round(avg(length(piece)), 6) as avg_size, min(length(piece)) as min_size, max(length(piece)) as max_size from ({_CUT})",
)
def c09(t):
    pieces = t("documents", True).select(F.explode(chunks.cut_fixed(F.col("text"), 900)).alias("chunk"))
    return chunks.chunk_stats(pieces).withColumn("avg_size", F.round("avg_size", 6))


@query(
    "c10_chunk_overlap_check",
    f"""with c as (select doc_id, pos, piece, lead(piece) over (partition by doc_id order by pos) as nxt from ({_CUT.replace('900', '300')})),
    p as (select doc_id, pos as chunk_index, right(piece, 1000) as tail, left(nxt, 1000) as head from c where nxt is not null)
    select doc_id, chunk_index, coalesce(list_min(list_filter(range(1, least(1000, length(tail), length(head))), lambda n: contains(head, right(tail, n)))), 0) as overlap,
      coalesce(list_max(list_filter(range(1, least(1000, length(tail), length(head))), lambda n: contains(head, right(tail, n)))), 0) as longest,
      contains(head, '---') as has_separator from p""",
)
def c10(t):
    pieces = t("documents", True).select("doc_id", F.posexplode(chunks.cut_fixed(F.col("text"), 300)).alias("chunk_index", "chunk"))
    return chunks.chunk_overlap_check(pieces, "doc_id")


_RECORDS = """select s_nationkey g, s_suppkey o, s_suppkey::varchar url, 'record' title,
    '{' || chr(10) || '  "s_name" : "' || s_name || '",' || chr(10) || '  "s_nationkey" : ' || s_nationkey || ',' || chr(10) || '  "s_acctbal" : ' || s_acctbal || chr(10) || '}' text
  from supplier"""


@query("c11_rows_to_text_chunks", f"select g as grp, * exclude (g) from ({_batch_sql(_RECORDS, 800, 'chr(10) || chr(10)')})")
def c11(t):
    rows = t("supplier").withColumn("grp", F.col("s_nationkey"))
    return _flat(chunks.rows_to_text_chunks(rows, "grp", "s_suppkey", 800), "grp")


@query(
    "w03_chunk_positions",
    f"with c as ({_CUT}) select doc_id, pos, count(*) over (partition by doc_id) as total_chunks from c",
)
def w03(t):
    from sievework.operators.keys import chunk_positions

    pieces = t("documents").select("doc_id", F.posexplode(chunks.cut_fixed(F.col("text"), 900)).alias("pos", "piece"))
    return chunk_positions(pieces, "doc_id", "pos").select("doc_id", "pos", "total_chunks")
