"""Exact similarity joins without all-pairs work (J09-J11) and the dedupes on them."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sievework.functions.text import extract_keywords, has_keyword, let, normalize_query, unnest
from sievework.operators.keys import first_per_key, join_totals
from sievework.operators.leaders import leaders_in_waves
from sievework.operators.nearsets import family_pairs, near_edges, near_sets
from sievework.operators.positions import with_position
from sievework.session import cut

#: Jaccard from which sets are compared by parts (nearsets); below, parts hold too few tokens to tell sets apart.
PARTS_FROM = 0.7

# --------------------------------------------------------------------------- keyword sets


def keyword_sets(df: DataFrame, id: str, tokens: Column) -> DataFrame:
    """(id, tokens, n) with sorted distinct tokens; empty sets never match anything."""
    return df.select(F.col(id).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("tokens")).withColumn(
        "n", F.size("tokens")
    )


def hashed(sets: DataFrame) -> DataFrame:
    """(id, tokens, n) with each token as a 64-bit hash, in order of the hashes."""
    tokens = F.array_sort(F.array_distinct(F.transform("tokens", lambda t: F.xxhash64(t))))
    return sets.select("id", tokens.alias("tokens")).withColumn("n", F.size("tokens"))


def distinct_sets(sets: DataFrame) -> DataFrame:
    """One row per distinct non-empty set of token hashes, under its lowest id.

    Copies are grouped by digest with map-side combining, so any number of copies of one
    text costs one row afterwards.
    """
    keyed = hashed(sets).withColumns({"_d": F.xxhash64("tokens"), "_e": F.hash("tokens")})
    reps = keyed.groupBy("_d", "_e", "n").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"))
    # on what the aggregate gives: a check of its key goes to the scan, where the tokens would be worked out twice
    return reps.filter(F.size("tokens") > 0).select("id", "tokens", "n")


def copies_of(sets: DataFrame) -> DataFrame:
    """(id, rep): the lowest id with the same set, for every row."""
    digests = cut(sets.select("id", F.md5(F.array_join("tokens", "\u0001")).alias("_d")))
    reps = digests.groupBy("_d").agg(F.min("id").alias("rep"))
    return join_totals(digests, reps, ["_d"]).select("id", "rep")


def rare_first(sets: DataFrame) -> DataFrame:
    """Tokens of each set as (frequency, token), rarest first."""
    rows = unnest(sets, ["id"], F.col("tokens"), "token")
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    ordered = join_totals(rows, counts, ["token"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("r"))
    return sets.join(ordered, "id").select("id", "n", "tokens", F.transform("r", lambda x: x["token"]).alias("ranked"))


def jaccard_postings(ranked: DataFrame, threshold: float) -> DataFrame:
    """Prefix of each set: two sets above the threshold share a token of their prefixes."""
    keep = F.col("n") - F.floor(F.col("n") * threshold - 1e-9).cast("int")
    prefix = F.slice("ranked", 1, F.least(keep, F.col("n")))
    return unnest(ranked, ["id", "n"], prefix, "token", "p")


def _postings_join(left: DataFrame, right: DataFrame, threshold: float, ordered: bool = True) -> DataFrame:
    """Candidate pairs (low, high), or in either order; lengths and token places are checked inside the join.

    All tokens that the prefixes share are counted: with those behind the prefixes they have to suffice.
    """
    a, b = left.alias("a"), right.alias("b")
    fits = (
        (F.col("a.token") == F.col("b.token"))
        & ((F.col("a.id") < F.col("b.id")) if ordered else (F.col("a.id") != F.col("b.id")))
        & (F.col("a.n") >= F.col("b.n") * threshold - 1e-9)
        & (F.col("b.n") >= F.col("a.n") * threshold - 1e-9)
        # tokens that can still be shared, counted from this one on
        & (
            F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")) + F.least("a.p", "b.p")
            >= (F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-9
        )
    )
    met = a.join(b, fits).groupBy(F.col("a.id").alias("low"), F.col("b.id").alias("high"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
    # behind the prefixes, the set whose prefix ends first has so many tokens left
    behind = F.floor(F.greatest("na", "nb") * threshold - 1e-9)
    enough = F.col("shared") + behind >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9
    return met.agg(F.count(F.lit(1)).alias("shared")).filter(enough).select("low", "high")


def token_counts(sets: DataFrame, slots: int = 1 << 18) -> np.ndarray:
    """How often tokens occur, summed by slot of their hash: a table of fixed size, whatever the vocabulary."""
    rows = unnest(sets, [], F.col("tokens"), "token")
    found = rows.groupBy(F.col("token").bitwiseAND(slots - 1).alias("slot")).agg(F.count(F.lit(1)).alias("f")).toPandas()
    counts = np.zeros(slots, dtype="int64")
    counts[found["slot"].to_numpy(dtype="int64")] = found["f"].to_numpy(dtype="int64")
    return counts


def rare_prefixes(sets: DataFrame, threshold: float, counts: np.ndarray) -> DataFrame:
    """(id, n, token, p): the prefix of each hashed set, rarest slot first; two sets above the threshold share one of its tokens.

    Any one order of all tokens will do, so no token has to be joined with its exact frequency.
    """
    given = sets.sparkSession.sparkContext.broadcast(counts)

    def first(batches):
        often = given.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                tokens, n = batch.column("tokens").flatten().to_numpy(), batch.column("n").to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((tokens, often[tokens & (len(often) - 1)], row))
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                early = place < np.repeat(n - np.floor(n * threshold - 1e-9).astype("int64"), n)
                held = pa.array(row[early])
                columns = [batch.column("id").take(held), batch.column("n").take(held), pa.array(tokens[order[early]]), pa.array(place[early].astype("int32"))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "token", "p"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "n", "tokens").mapInArrow(first, f"id {kind}, n int, token long, p int")


def jaccard_between(left: DataFrame, right: DataFrame, threshold: float, counts: np.ndarray) -> DataFrame:
    """Edges (low, high, sim) with Jaccard above ``threshold``; inputs from :func:`hashed`, counts of all their tokens."""
    first = rare_prefixes(left, threshold, counts)
    pairs = _postings_join(first, first if left is right else rare_prefixes(right, threshold, counts), threshold)
    a = left.select(F.col("id").alias("low"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    b = right.select(F.col("id").alias("high"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    both = pairs.join(a, "low").join(b, "high")
    common = F.size(F.array_intersect("ta", "tb"))
    scored = both.select("low", "high", (common / (F.col("na") + F.col("nb") - common)).alias("sim"))
    return scored.filter(F.col("sim") > threshold)


def jaccard_edges(sets: DataFrame, threshold: float) -> DataFrame:
    """J10 over sets of tokens, or over stored, non-empty sets of token hashes."""
    if sets.schema["tokens"].dataType.elementType != T.LongType():
        sets = cut(hashed(sets).filter("n > 0"))
    if threshold >= PARTS_FROM:
        return near_edges(sets, threshold)
    return jaccard_between(sets, sets, threshold, token_counts(sets))


def _leaders_of_near(sets: DataFrame, threshold: float, waves: int | None) -> DataFrame:
    """Ids of the sets that lead. Sets without a near one lead by themselves; only the others go through waves, and only families bring their tokens."""
    loose, members = near_sets(sets, threshold)
    loose = cut(loose.select("low", "high"))
    alone = loose.select(F.col("low").alias("id")).union(loose.select("high")).distinct().join(members.select("id"), "id", "left_anti")
    nodes = cut(members.unionByName(alone, allowMissingColumns=True))

    def between(left: DataFrame, right: DataFrame) -> DataFrame:
        known = loose.join(left.select(F.col("id").alias("low")), "low", "left_semi").join(right.select(F.col("id").alias("high")), "high", "left_semi")
        return known.select("low", "high").unionByName(family_pairs(left, right, threshold).select("low", "high"))

    lost = nodes.select("id").join(leaders_in_waves(nodes, between, waves).select("id"), "id", "left_anti")
    return sets.select("id").join(lost, "id", "left_anti")


def dedupe_jaccard(df: DataFrame, id: str, text: str, threshold: float = 0.85, waves: int | None = None) -> DataFrame:
    """Ids that are kept; copies of one text fall to its lowest id first."""
    reps = cut(distinct_sets(keyword_sets(df, id, extract_keywords(F.col(text)))))
    if threshold >= PARTS_FROM:
        kept = _leaders_of_near(reps, threshold, waves)
    else:
        counts = token_counts(reps)
        kept = leaders_in_waves(reps, lambda a, b: jaccard_between(a, b, threshold, counts), waves).select("id")
    empty = df.select(F.col(id).alias("id")).filter(~has_keyword(F.col(text)))
    return kept.unionByName(empty).withColumnRenamed("id", id)


def dedupe_queries(df: DataFrame, id: str, query: str, threshold: float = 0.85) -> DataFrame:
    """First of each normalised query, then the keyword dedupe."""
    first = cut(first_per_key(df.select(id, query), [normalize_query(F.col(query))], id))
    return first.join(dedupe_jaccard(first, id, query, threshold), id, "left_semi")


def neighbours(some: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """(id, other, weight): the sets of ``ranked`` whose Jaccard with one of ``some`` is above ``threshold``, itself left out."""
    pairs = _postings_join(jaccard_postings(some, threshold), jaccard_postings(ranked, threshold), threshold, ordered=False)
    a = some.select(F.col("id").alias("low"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    b = ranked.select(F.col("id").alias("high"), F.col("tokens").alias("tb"), F.col("n").alias("nb"), "weight")
    common = F.size(F.array_intersect("ta", "tb"))
    near = pairs.join(a, "low").join(b, "high").filter(common / (F.col("na") + F.col("nb") - common) > threshold)
    return near.select(F.col("low").alias("id"), F.col("high").alias("other"), "weight")


def degree_bounds(ranked: DataFrame, threshold: float) -> DataFrame:
    """(id, bound): no set has neighbours of more weight than that, itself included; no pair is made.

    For sets of one length class, three bounds hold at once: all of them; those that share a token of the prefixes,
    counted for each token; and the shared tokens in all, divided by the number that two near sets have to share.
    """
    kind = F.floor(F.log2("n") * 2).cast("int").alias("kind")
    sizes = ranked.groupBy(kind).agg(F.sum("weight").alias("all"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    keep = F.col("n") - F.floor(F.col("n") * threshold - 1e-9).cast("int")
    rows = unnest(ranked, ["id", "n", "weight"], F.col("ranked"), "token", "p").withColumn("early", F.col("p") < keep)
    there = rows.groupBy("token", kind).agg(F.sum("weight").alias("with"), F.sum(F.when(F.col("early"), F.col("weight")).otherwise(0)).alias("early_with"))
    by_token = there.groupBy("token").agg(F.collect_list(F.struct("kind", "with", "early_with")).alias("others"))  # one for each class
    met = join_totals(rows.select("id", "n", "token", "early"), by_token, ["token"])
    spread_out = met.select("id", "n", "early", F.explode("others").alias("o"))
    sums = spread_out.groupBy("id", "n", F.col("o.kind").alias("kind")).agg(
        F.sum("o.with").alias("shared"), F.sum(F.when(F.col("early"), F.col("o.early_with")).otherwise(0)).alias("early")
    )
    # a row for each doubling of the length, twice: some dozens at most
    fits = (F.col("hi") > F.col("n") * threshold - 1e-9) & (F.col("lo") * threshold < F.col("n") + 1e-9)
    least = F.floor((F.col("n") + F.col("lo")) * (threshold / (1 + threshold)) - 1e-9) + 1
    each = F.least(F.col("all"), F.col("early"), F.floor(F.col("shared") / F.greatest(least, F.lit(1))))
    return sums.join(F.broadcast(sizes), "kind").filter(fits).groupBy("id").agg(F.sum(each).cast("long").alias("bound"))


def _best_connected(left: DataFrame, bounds: DataFrame, threshold: float, first_look: int):
    """The set with most neighbours in ``left`` (ties: lowest id), and ``bounds`` with the degrees that were worked out.

    Degrees are worked out for the ``first_look`` sets of highest bound, then for those in the upper half between the best
    degree and the highest bound left, then for all that can still win; sets with a lower bound are never compared.
    """
    best = None
    for look in range(3):
        rest = bounds.filter(~F.col("exact"))
        if best is not None:
            rest = rest.filter((F.col("bound") > best["bound"]) | ((F.col("bound") == best["bound"]) & (F.col("id") < best["id"])))
        if look == 0:
            rest = rest.orderBy(F.desc("bound"), "id").limit(first_look)
        elif look == 1:
            top = rest.agg(F.max("bound")).first()[0]
            if top is None:
                break
            rest = rest.filter(F.col("bound") * 2 >= top + best["bound"])
        some = cut(left.join(rest.select("id"), "id", "left_semi"))
        reached = some.select("id", "weight").unionByName(neighbours(some, left, threshold).select("id", "weight"))
        degrees = reached.groupBy("id").agg(F.sum("weight").alias("degree"))
        known = F.coalesce("degree", "bound").alias("bound"), (F.col("exact") | F.col("degree").isNotNull()).alias("exact")
        bounds = cut(bounds.join(degrees, "id", "left").select("id", *known))
        best = bounds.filter("exact").orderBy(F.desc("bound"), "id").first()
        if best is None:
            break
    return best, bounds


def cluster_simple(df: DataFrame, id: str, query: str, k: int = 5, threshold: float = 0.3, first_look: int = 64) -> DataFrame:
    """(cluster, id, query) of the representatives of at most ``k`` clusters.

    Each cluster is the set with most neighbours among those left, with all of them. Links aren't listed: a set is compared
    only while its bound (of :func:`degree_bounds`, or its degree in an earlier round) can beat the best degree known.
    """
    sets = keyword_sets(df, id, extract_keywords(F.col(query)))
    keyed = sets.withColumn("_d", F.md5(F.array_join("tokens", "\u0001")))
    # copies of one keyword set always move together: one node with their number as weight
    nodes = cut(
        keyed.groupBy("_d").agg(
            F.min("id").alias("id"), F.first("tokens").alias("tokens"), F.first("n").alias("n"), F.count(F.lit(1)).alias("weight")
        ).filter("n > 0")
    )
    left = cut(rare_first(nodes.select("id", "tokens", "n")).join(nodes.select("id", "weight"), "id"))
    bounds = cut(degree_bounds(left, threshold).withColumn("exact", F.lit(False)))
    chosen = []
    for cluster in range(k):
        best, bounds = _best_connected(left, bounds, threshold, first_look)
        if best is None:
            break
        centre = left.filter(F.col("id") == best["id"])
        inside = cut(centre.select("id").unionByName(neighbours(centre, left, threshold).select(F.col("other").alias("id"))))
        members = left.join(inside, "id", "left_semi")
        chosen.append((cluster, members.orderBy(F.desc("n"), F.asc("id")).first()["id"]))
        left = cut(left.join(inside, "id", "left_anti"))
        bounds = cut(bounds.join(inside, "id", "left_anti").withColumn("exact", F.lit(False)))
    kind = df.schema[id].dataType.simpleString()
    picked = df.sparkSession.createDataFrame(chosen, f"cluster int, {id} {kind}")
    return df.select(id, query).join(F.broadcast(picked), id).select("cluster", id, query)


def tfidf(df: DataFrame, id: str, query: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, row, weight) of queries with the same terms, and their unit vectors (node, term, x), one row a term.

    Terms are words of two signs or more that are no English stop words; all of them count. Null is an empty text. Terms that
    every query has weigh nothing, so a node may have no rows. ``row`` is the (id, query) of the lowest id.
    """
    from pyspark.ml.feature import StopWordsRemover

    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(query), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    stop = StopWordsRemover.loadDefaultStopWords("english")
    terms = F.array_sort(F.filter(words, lambda w: ~w.isin(*stop)))
    keyed = df.select(F.struct(F.col(id).alias("id"), F.col(query).alias("query")).alias("row"), terms.alias("terms"))
    keyed = keyed.withColumn("node", F.md5(F.array_join("terms", " ")))
    nodes = cut(keyed.groupBy("node").agg(F.min("row").alias("row"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("weight")))
    counts = unnest(nodes, ["node", "weight"], F.col("terms"), "term").groupBy("node", "weight", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = nodes.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first()["n"]
    share = counts.groupBy("term").agg(F.log((F.lit(total) + 1) / (F.sum("weight") + 1)).alias("idf"))
    raw = cut(join_totals(counts, share, ["term"]).select("node", "term", (F.col("tf") * F.col("idf")).alias("x")).filter("x > 0"))
    norms = raw.groupBy("node").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return nodes.drop("terms"), cut(join_totals(raw, norms, ["node"]).select("node", "term", (F.col("x") / F.col("norm")).alias("x")))


def _gaps(nodes: DataFrame, vectors: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """Nodes with ``gaps``, the squared distance to each of ``k`` centres (term, c: a value for each centre).

    Only terms that a query and a centre share meet; the rest is in the norms.
    """
    norms = centres.agg(*[F.coalesce(F.sum(F.col("c")[j] * F.col("c")[j]), F.lit(0.0)) for j in range(k)]).first()
    shared = join_totals(vectors, centres, ["term"]).groupBy("node").agg(*[F.sum(F.col("x") * F.col("c")[j]).alias(f"d{j}") for j in range(k)])
    sizes = vectors.groupBy("node").agg(F.sum(F.col("x") * F.col("x")).alias("own"))
    rest = F.coalesce("own", F.lit(0.0))
    gaps = [F.greatest(rest + float(norms[j]) - 2 * F.coalesce(f"d{j}", F.lit(0.0)), F.lit(0.0)) for j in range(k)]
    return nodes.join(sizes, "node", "left").join(shared, "node", "left").select(*nodes.columns, F.array(*gaps).alias("gaps"))


def first_centres(nodes: DataFrame, vectors: DataFrame, k: int, seed: int) -> list[str]:
    """Up to ``k`` nodes, each drawn with a chance in proportion to its queries and its squared distance to those before.

    The draw is a race: every node has a waiting time from a hash of its terms, the seed and the turn, divided by its
    share, and the shortest wins. So it is one aggregate a turn, the same in every run.
    """
    chosen: list[str] = []
    near = nodes.withColumn("gap", F.lit(1.0))
    for turn in range(k):
        chance = (F.pmod(F.xxhash64(F.lit(f"{seed}:{turn}"), "node"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        won = near.filter("gap > 1e-12").agg(F.min_by("node", F.struct(-F.log(chance) / (F.col("weight") * F.col("gap")), F.col("node"))).alias("node")).first()["node"]
        if won is None:
            break
        chosen.append(won)
        centre = vectors.filter(F.col("node") == won).select("term", F.array("x").alias("c"))
        met = _gaps(near, vectors, centre, 1)
        near = cut(met.withColumn("gap", F.col("gaps")[0] if turn == 0 else F.least("gap", F.col("gaps")[0])).drop("gaps"))
    return chosen


def cluster_kmeans(df: DataFrame, id: str, query: str, k: int = 5, seed: int = 42, rounds: int = 20) -> DataFrame:
    """The query nearest to each TF-IDF centre, as (cluster, id, query).

    Lloyd's rounds until the sum of distances falls no more, ``rounds`` at most. Vectors and centres are tables of terms, so the
    vocabulary has no bound; only the clusters' sizes and norms come to the driver. Equal distances go to the lower
    cluster and the lower id. A cluster that loses all its queries keeps its centre and has no row; fewer different queries than
    ``k`` give fewer clusters, and an empty table none.
    """
    nodes, vectors = tfidf(df, id, query)
    chosen = first_centres(nodes, vectors, k, seed)
    k = len(chosen)
    kind = f"cluster int, {df.select(id, query)._jdf.schema().toDDL()}"
    if not k:
        return df.sparkSession.createDataFrame([], kind)
    value = [F.max(F.when(F.col("node") == node, F.col("x")).otherwise(0.0)) for node in chosen]
    centres = cut(vectors.filter(F.col("node").isin(chosen)).groupBy("term").agg(F.array(*value).alias("c")))
    last = math.inf
    for turn in range(rounds + 1):
        gaps = _gaps(nodes, vectors, centres, k)
        least = F.array_min(F.transform("gaps", lambda g, j: F.struct(g.alias("gap"), j.alias("cluster"))))
        placed = cut(gaps.withColumn("_best", least).select("node", "row", "weight", "_best.gap", "_best.cluster"))
        each = placed.groupBy("cluster").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("gap")).alias("gap")).collect()
        inertia = sum(r["gap"] for r in each)
        if turn == rounds or inertia >= last * (1 - 1e-9):
            break
        last, sizes = inertia, {r["cluster"]: r["n"] for r in each}
        inside = join_totals(vectors, placed.select("node", "weight", "cluster"), ["node"])
        sums = [F.sum(F.when(F.col("cluster") == j, F.col("x") * F.col("weight")).otherwise(0.0)) / F.lit(sizes.get(j, 1)) for j in range(k)]
        moved = inside.groupBy("term").agg(F.array(*sums).alias("c"))
        if len(sizes) < k:
            both = moved.join(centres.select("term", F.col("c").alias("before")), "term", "full")
            c = [F.coalesce(F.col("c")[j] if j in sizes else F.col("before")[j], F.lit(0.0)) for j in range(k)]
            moved = both.select("term", F.array(*c).alias("c"))
        centres = cut(moved)
    best = placed.groupBy("cluster").agg(F.min_by("row", F.struct("gap", "row")).alias("row"))
    return best.select(F.col("cluster").cast("int").alias("cluster"), F.col("row.id").alias(id), F.col("row.query").alias(query))


# --------------------------------------------------------------------------- fuzzy names


@F.pandas_udf(T.DoubleType())
def sequence_ratio(earlier: pd.Series, later: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the order of the arguments matters."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(earlier, later)], dtype="float64")


# evaluated once per pair, though it is both filtered on and kept
sequence_ratio = sequence_ratio.asNondeterministic()


def _numbered(items: Column) -> Column:
    """Each item with the number of times it has occurred so far."""
    return F.transform(
        items,
        lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(items, 1, i + 1), lambda h: h == g)).cast("string")),
    )


def bigrams(c: Column) -> Column:
    """Bigrams numbered by occurrence; strings of two or three letters also carry their ends."""
    n = F.length(c)
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    grams = F.coalesce(grams, F.array().cast("array<string>"))
    numbered = let(grams, _numbered)
    ends = F.when(
        n.isin(2, 3), F.array(F.concat(F.lit("^"), F.left(c, F.lit(1)), F.right(c, F.lit(1))))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(numbered, ends)


def letters(c: Column) -> Column:
    """Letters numbered by occurrence: the size of an intersection bounds what two names share."""
    return let(F.split(c, ""), _numbered)


def fuzzy_index(names: DataFrame, id: str, name: str) -> DataFrame:
    """(id, name, l, n, ranked, tokens, bag) for :func:`fuzzy_between`."""
    rows = names.select(F.col(id).alias("id"), F.lower(name).alias("name"))
    sets = rows.select("id", "name", bigrams(F.col("name")).alias("tokens")).withColumn("n", F.size("tokens"))
    ranked = rare_first(sets.filter("n > 0").select("id", "tokens", "n"))
    return ranked.join(rows, "id").withColumns({"l": F.length("name"), "bag": letters(F.col("name"))})


def _fuzzy_postings(index: DataFrame, threshold: float) -> DataFrame:
    # A ratio t leaves at most (1-t)(la+lb) letters unmatched, and every unmatched letter breaks
    # at most one shared bigram more: shared >= (1.5t-1)(la+lb) - 1, with lb >= la*t/(2-t).
    needed = F.col("l") * (1.5 * threshold - 1) * (1 + threshold / (2 - threshold)) - 1
    needed = F.greatest(F.lit(1), F.ceil(needed - 1e-9)).cast("int")
    keep = F.when(F.col("l") <= 3, F.col("n")).otherwise(F.greatest(F.lit(1), F.col("n") - needed + 1))
    return unnest(index, ["id", "l"], F.slice("ranked", 1, keep), "token")


def fuzzy_between(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Edges (low, high, sim) with ratio >= threshold (thresholds from 0.8 on)."""
    if threshold < 0.8:
        raise ValueError("the bigram bound is only lossless from 0.8 on")
    a, b = _fuzzy_postings(left, threshold).alias("a"), _fuzzy_postings(right, threshold).alias("b")
    shortest = threshold / (2 - threshold)
    fits = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.id") < F.col("b.id"))
        & (F.col("a.l") >= F.col("b.l") * shortest - 1e-9)
        & (F.col("b.l") >= F.col("a.l") * shortest - 1e-9)
    )
    pairs = a.join(b, fits).select(F.col("a.id").alias("low"), F.col("b.id").alias("high")).distinct()
    x = left.select(F.col("id").alias("low"), F.col("name").alias("na"), F.col("tokens").alias("ta"), F.col("bag").alias("ba"), F.col("l").alias("la"))
    y = right.select(F.col("id").alias("high"), F.col("name").alias("nb"), F.col("tokens").alias("tb"), F.col("bag").alias("bb"), F.col("l").alias("lb"))
    both = pairs.join(x, "low").join(y, "high")
    total = F.col("la") + F.col("lb")
    both = both.filter(F.size(F.array_intersect("ba", "bb")) >= total * (threshold / 2) - 1e-9)
    both = both.filter(F.size(F.array_intersect("ta", "tb")) >= total * (1.5 * threshold - 1) - 1 - 1e-9)
    # few pairs are left and each is costly, so they are dealt out evenly
    even = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.select("low", "high", "na", "nb").repartition(even)
    scored = both.select("low", "high", sequence_ratio("na", "nb").alias("sim"))
    return scored.filter(F.col("sim") >= threshold)


def fuzzy_edges(names: DataFrame, id: str, name: str, threshold: float = 0.8) -> DataFrame:
    index = fuzzy_index(names, id, name)
    return fuzzy_between(index, index, threshold)


# --------------------------------------------------------------------------- embeddings


def distinct_vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): lowest id of each distinct vector, as doubles."""
    return df.groupBy(F.col(vector).cast("array<double>").alias("v")).agg(F.min(id).alias("id")).select("id", "v")


def _to_points(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in points], axis=1)


def embedding_cells(vectors: DataFrame, pivots: int = 16) -> tuple[DataFrame, np.ndarray]:
    """Add the distance of each vector to a few vectors of the table, and its nearest one.

    The pivots are a fixed number of rows, so what reaches the driver does not grow.
    """
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    points = np.array([r["v"] for r in chosen], dtype="float64")

    def measure(frames):
        for frame in frames:
            gaps = _to_points(np.array(frame["v"].tolist(), dtype="float64").reshape(len(frame), -1), points)
            near = gaps.argmin(axis=1)
            yield frame.assign(cell=near.astype("int32"), own=gaps.min(axis=1), gaps=list(gaps))

    kind = vectors.schema["id"].dataType.simpleString()
    marked = vectors.mapInPandas(measure, f"id {kind}, v array<double>, cell int, own double, gaps array<double>")
    return marked, points


#: Vectors of one side that a task holds at most, and parts that a table is cut into while they stay below that.
SIDE, SIDES = 65_536, 16


def embedding_between(left: DataFrame, right: DataFrame, threshold: float = 0.85, block: int = 2048, pivots: int | None = None, side: int = SIDE) -> DataFrame:
    """Edges (low, high, sim) with inner product above ``threshold``; exact.

    Vectors lie in slices of near distance to one pivot. By the triangle inequality two slices hold a pair only if their
    distance ranges to every pivot come close enough. Slices make up parts of the table; a task meets two parts, so a
    vector is sent once for each part, of which there are ``SIDES`` to about twice as many (slices stay whole) until one would exceed ``side`` rows. There blocks of ``block`` rows
    meet, after the same test, and their pairs are written out before the next ones are worked out.
    """
    same = left is right
    union = left.select("id", "v", F.lit(True).alias("l"), F.lit(same).alias("r"))
    if not same:
        union = union.unionByName(right.select("id", "v", F.lit(False).alias("l"), F.lit(True).alias("r")))
    count = union.count()
    if pivots is None:
        pivots = 16 if count < 100_000 else 64
    marked, points = embedding_cells(union.select("id", "v"), pivots)
    k = len(points)
    marked = cut(marked.join(union.select("id", "l", "r"), "id"))
    kind = left.schema["id"].dataType.simpleString()
    if k == 0:
        return left.sparkSession.createDataFrame([], f"low {kind}, high {kind}, sim double")
    longest = marked.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    reach = math.sqrt(max(0.0, 2 * longest - 2 * threshold)) + 1e-9

    size = min(side, max(block, math.ceil(count / SIDES)))
    placed = with_position(marked, "own", ["cell"], ["id"])
    placed = cut(placed.withColumn("slice", F.floor((F.col("pos") - 1) / size).cast("int")))
    bounds = [f(F.col("gaps")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))]
    # at most ``pivots`` slices and one for each ``size`` rows; which of them meet is worked out on the driver
    slices = placed.groupBy("cell", "slice").agg(F.count(F.lit(1)).alias("n"), *bounds).orderBy("cell", "slice").collect()
    low, high = (np.array([[s[f"{n}{i}"] for i in range(k)] for s in slices]) for n in ("lo", "hi"))
    part, held = [], 0
    for s in slices:
        full = not part or held + s["n"] > size
        part.append((part[-1] if part else -1) + full)
        held = s["n"] if full else held + s["n"]
    sent = set()
    for i, s in enumerate(slices):
        near = np.flatnonzero(~(np.maximum(low[i] - high, low - high[i]) >= reach).any(axis=1))
        for other in {part[j] for j in near.tolist()}:
            a, b = min(part[i], other), max(part[i], other)
            sent.add((s["cell"], s["slice"], a * len(slices) + b, int(part[i] == b and a != b)))
    to = F.broadcast(left.sparkSession.createDataFrame(sorted(sent), "c int, s int, tile long, side int"))
    rows = placed.join(to, (F.col("cell") == F.col("c")) & (F.col("slice") == F.col("s"))).select("tile", "side", "cell", "pos", "id", "v", "l", "r")
    tiles = len({x[2] for x in sent})

    def blocks(table: pa.Table) -> list[tuple]:
        """(ids, vectors, l, r, least and greatest distance to each pivot) of each block of one side; a block is of one cell."""
        cell, made = table["cell"].to_numpy(), []
        starts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), table.num_rows]
        for at, n in [(at, min(block, end - at)) for start, end in zip(starts, starts[1:]) for at in range(start, end, block)]:
            some = table.slice(at, n).combine_chunks()
            x = some["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
            gaps = _to_points(x, points)
            flags = [some[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("l", "r")]
            made.append((some["id"].combine_chunks().to_numpy(zero_copy_only=False), x, *flags, gaps.min(axis=0), gaps.max(axis=0)))
        return made

    def met(a: tuple, b: tuple, own: bool) -> pa.RecordBatch | None:
        (xi, x, xl, xr, xlo, xhi), (yi, y, yl, yr, ylo, yhi) = a, b
        if (np.maximum(xlo - yhi, ylo - xhi) >= reach).any() or not (xl.any() and yr.any() or yl.any() and xr.any()):
            return None
        sims = x @ y.T
        i, j = np.nonzero(sims > threshold)
        low, high = xi[i], yi[j]
        keep = low < high if own else low != high
        keep &= np.where(low < high, xl[i] & yr[j], yl[j] & xr[i])
        i, j = i[keep], j[keep]
        out = [np.minimum(xi[i], yi[j]), np.maximum(xi[i], yi[j]), sims[i, j]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["low", "high", "sim"]) if len(i) else None

    types = [to_arrow_type(left.schema["id"].dataType)] * 2 + [pa.float64()]

    def compare(batches):
        """Rows come tile by tile, in each one side after the other, and there cell by cell."""
        tile, sides = None, ([], [])

        def pairs():
            one, two = (blocks(pa.Table.from_batches(s)) if s else [] for s in sides)
            for n, a in enumerate(one):
                for b in two or one[n:]:
                    if (found := met(a, b, a is b)) is not None:
                        yield found

        for batch in batches:
            keys = batch.column("tile").to_numpy() * 2 + batch.column("side").to_numpy()
            ends = [*(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for start, end in zip([0, *ends], ends):
                if start == end:
                    continue
                now = int(keys[start])
                if tile is not None and now // 2 != tile:
                    yield from pairs()
                    sides = ([], [])
                tile = now // 2
                sides[now % 2].append(batch.slice(start, end - start).select(["cell", "id", "v", "l", "r"]))
        if tile is not None:
            yield from pairs()

    dealt = rows.repartition(max(1, min(tiles, 2000)), "tile").sortWithinPartitions("tile", "side", "cell", "pos")
    return dealt.mapInArrow(compare, f"low {kind}, high {kind}, sim double")


def dedupe_embedding(df: DataFrame, id: str, vector: str, threshold: float = 0.85, waves: int | None = None) -> DataFrame:
    """Ids that are kept."""
    vectors = cut(distinct_vectors(df, id, vector))
    kept = leaders_in_waves(vectors, lambda a, b: embedding_between(a, b, threshold), waves)
    return kept.select(F.col("id").alias(id))
