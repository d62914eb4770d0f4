"""Similarity joins, grouping and dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework import rules
from sievework.catalog.base import query, sql_in
from sievework.catalog.fields import F02_SQL, named
from sievework.catalog.texts import NORMAL
from sievework.functions.text import extract_keywords
from sievework.operators import leaders, names, similarity as sim
from sievework.operators.positions import with_neighbours
from sievework.session import cut


def _part_names(t):
    """Distinct part names with a model number, by first part."""
    name = F.concat("p_name", F.lit(" "), "p_brand")
    return t("part").groupBy(name.alias("name")).agg(F.min("p_partkey").alias("id"))


@query("j09_fuzzy_edges")
def j09(t):
    return sim.fuzzy_edges(_part_names(t), "id", "name").withColumn("sim", F.round("sim", 6))


KEYWORD_SETS = f"""(select doc_id as id, list_sort(list_distinct([x for x in string_split({NORMAL}, ' ') if length(x) > 2 and x not in {sql_in(rules.QUERY_STOPWORDS)}])) as k from documents)"""


def greedy_sql(edges: str, nodes: str) -> str:
    """CTE ``kept``: ids a pass in order keeps, from ``edges(low, high)`` and ``nodes(id)``."""
    return f"""lows as (select n.id, list(e.low) filter (e.low is not null) as l from {nodes} n left join {edges} e on e.high = n.id group by 1),
    steps as (select list(list_prepend(id, coalesce(l, [])) order by id) as s from lows),
    kept as (select unnest(list_reduce(s, lambda acc, x: case when len(list_intersect(acc, x[2:])) > 0 then acc else list_append(acc, x[1]) end)) as id from
      (select list_prepend([s[1][1]], s[2:]) as s from steps))"""


def jaccard_sql(sets: str, threshold: float) -> str:
    """CTEs ``reps(id, n)`` and ``edges(low, high)`` over the distinct sets of ``sets(id, k)``."""
    return f"""reps as (select min(id) as id, k, len(k) as n from {sets} where len(k) > 0 group by k),
    words as (select id, n, unnest(k) as w from reps),
    shared as (select a.id as low, b.id as high, a.n as na, b.n as nb, count(*) as c from words a join words b on a.w = b.w and a.id < b.id
      and a.n > {threshold} * b.n and b.n > {threshold} * a.n group by 1, 2, 3, 4),
    edges as (select low, high from shared where c / (na + nb - c) > {threshold})"""


def _sets(t):
    return sim.keyword_sets(t("documents", True), "doc_id", extract_keywords(F.col("text")))


@query(
    "j10_jaccard_edges",
    f"""with s as (select min(id) as id, k, len(k) as n from {KEYWORD_SETS} where len(k) > 0 group by k),
    w as (select id, n, unnest(k) as w from s),
    c as (select a.id as low, b.id as high, a.n as na, b.n as nb, count(*) as c from w a join w b on a.w = b.w and a.id < b.id and a.n > 0.85 * b.n and b.n > 0.85 * a.n group by 1, 2, 3, 4)
    select low, high, round(c / (na + nb - c), 6) as sim from c where c / (na + nb - c) > 0.85""",
)
def j10(t):
    """Over distinct keyword sets; copies of a text stand behind their lowest id."""
    reps = cut(sim.distinct_sets(_sets(t)))
    return sim.jaccard_edges(reps, 0.85).withColumn("sim", F.round("sim", 6))


@query(
    "j10_copies",
    f"with s as (select id, k from {KEYWORD_SETS} where len(k) > 0) select id, min(id) over (partition by k) as rep from s",
)
def j10_copies(t):
    return sim.copies_of(_sets(t).filter("n > 0"))


@query(
    "j11_embedding_edges",
    """with v as (select min(vec_id) as id, embedding::double[] as v from embeddings group by embedding)
    select a.id as low, b.id as high, round(list_inner_product(a.v, b.v), 6) as sim from v a join v b on a.id < b.id where list_inner_product(a.v, b.v) > 0.35""",
)
def j11(t):
    vectors = sim.distinct_vectors(t("embeddings"), "vec_id", "embedding")
    return sim.embedding_between(vectors, vectors, 0.35, block=256).withColumn("sim", F.round("sim", 6))


@query("d01_group_names")
def d01(t):
    return names.group_names(_part_names(t), "id", "name")


@query("d02_pick_representative")
def d02(t):
    return names.pick_representative(names.group_names(_part_names(t), "id", "name"))


@query(
    "d03_greedy_leader_groups",
    """with o as (select o_orderkey as id, o_custkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as prev from orders),
    g as (select *, sum(case when prev is not null and id - prev < 3000 then 0 else 1 end) over (partition by o_custkey order by id) as run from o),
    n as (select *, row_number() over (partition by o_custkey, run order by id) as k from g)
    select id, case when k % 2 = 1 then id else prev end as leader from n""",
)
def d03(t):
    """An order is similar to the next one of its customer when their numbers are near."""
    orders = t("orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    steps = with_neighbours(orders, "id", ["o_custkey"], following={"high": "id"})
    edges = steps.filter("high - id < 3000").select(F.col("id").alias("low"), "high")
    return leaders.greedy_leader_groups(orders, edges)


@query(
    "d04_dedupe_jaccard",
    f"""with {jaccard_sql(KEYWORD_SETS, 0.85)}, {greedy_sql('edges', 'reps')}
    select id as doc_id from kept union all select id from {KEYWORD_SETS} where len(k) = 0""",
)
def d04(t):
    return sim.dedupe_jaccard(t("documents", True), "doc_id", "text", 0.85)


@query(
    "d05_dedupe_embedding",
    f"""with v as (select min(vec_id) as id, embedding::double[] as v from embeddings group by embedding),
    edges as (select a.id as low, b.id as high from v a join v b on a.id < b.id where list_inner_product(a.v, b.v) > 0.35), {greedy_sql('edges', 'v')}
    select id as vec_id from kept""",
)
def d05(t):
    return sim.dedupe_embedding(t("embeddings"), "vec_id", "embedding", 0.35)


def _most_linked_sql(k: int) -> str:
    """CTEs ``pick1`` .. ``pickk``: one greedy step each, over ``links(a, b, w, n)`` with weight and size of b."""
    steps = ["left0 as materialized (select * from links)"]
    for i in range(1, k + 1):
        steps += [
            f"best{i} as materialized (select a from left{i - 1} group by a order by sum(w) desc, a limit 1)",
            f"in{i} as materialized (select b, n from left{i - 1} where a in (select a from best{i}))",
            f"pick{i} as (select {i - 1} as cluster, b as id from in{i} order by n desc, b limit 1)",
            f"left{i} as materialized (select * from left{i - 1} where a not in (select b from in{i}) and b not in (select b from in{i}))",
        ]
    return ",\n    ".join(steps)


@query(
    "d06_cluster_simple",
    f"""with names as (select concat(p_name, ' ', p_brand) as name, min(p_partkey) as id from part group by 1),
    sets as (select id, list_sort(list_distinct([x for x in string_split({NORMAL.replace('text', 'name')}, ' ') if length(x) > 2 and x not in {sql_in(rules.QUERY_STOPWORDS)}])) as k from names),
    nodes as (select min(id) as id, k, len(k) as n, count(*) as w from sets where len(k) > 0 group by k),
    words as (select id, n, unnest(k) as t from nodes),
    near as (select a.id as a, b.id as b from words a join words b on a.t = b.t group by a.id, b.id, a.n, b.n having count(*) / (a.n + b.n - count(*)) > 0.3),
    links as (select near.a, near.b, nodes.w, nodes.n from near join nodes on nodes.id = near.b), {_most_linked_sql(5)},
    picks as ({" union all ".join(f"select * from pick{i}" for i in range(1, 6))})
    select cluster, id, name from picks join names using (id)""",
)
def d06(t):
    return sim.cluster_simple(_part_names(t), "id", "name")


@query("d07_cluster_kmeans")
def d07(t):
    return sim.cluster_kmeans(_part_names(t), "id", "name")


@query("d08_dedupe_companies")
def d08(t):
    return names.dedupe_companies(_part_names(t), "id", "name")


@query(
    "d09_dedupe_basic",
    f"with n as (select c_custkey, {F02_SQL} as k, c_acctbal from customer) select min(c_custkey) as c_custkey, arg_min(c_acctbal, c_custkey) as c_acctbal from n group by k",
)
def d09(t):
    rows = named(t).select("c_custkey", "name", "c_acctbal")
    return names.dedupe_basic(rows, "c_custkey", "name").select("c_custkey", "c_acctbal")


_QUERIES = f"(select id, name, {NORMAL.replace('text', 'name')} as q from (select concat(p_name, ' ', p_brand) as name, min(p_partkey) as id from part group by 1))"
_QUERY_SETS = f"""(select min(id) as id, arg_min(list_sort(list_distinct([x for x in string_split(q, ' ') if length(x) > 2 and x not in {sql_in(rules.QUERY_STOPWORDS)}])), id) as k
  from {_QUERIES} group by q)"""


@query(
    "d10_dedupe_queries",
    f"""with {jaccard_sql(_QUERY_SETS, 0.85)}, {greedy_sql('edges', 'reps')}
    select q.id, q.name from {_QUERIES} q where id in (select id from kept) or id in (select id from {_QUERY_SETS} where len(k) = 0)""",
)
def d10(t):
    return sim.dedupe_queries(_part_names(t), "id", "name")
