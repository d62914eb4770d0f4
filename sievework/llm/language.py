"""Languages of words in code-switched text: a linear-chain conditional random field, decoded by forward-backward."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from sievework.llm.common import named, pieces, renamed
from sievework.llm.crf import Chain, posteriors, train

LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = 1 << 17
#: Words of the same task that are remembered with their scores; then it starts over.
REMEMBERED = 300_000


@dataclass
class Model:
    """Languages in order, the chain, and the lexicon: each known word's feature ids."""

    languages: list[str]
    chain: Chain
    lexicon: dict[str, tuple[int, ...]]


def lexicon_of(sequences: list[list[str]], labels: list[list[int]], n: int, least: int = 3) -> dict[str, tuple[int, ...]]:
    """For each word seen ``least`` times, one feature id for each language: which quarter its share in there falls in."""
    counts = [Counter() for _ in range(n)]
    for words, own in zip(sequences, labels):
        for w, k in zip(words, own):
            counts[k][w] += 1
    totals = sum(counts, Counter())
    sizes = [max(1, sum(c.values())) for c in counts]
    found = {}
    for w, c in totals.items():
        if c >= least:
            shares = np.array([counts[k][w] / sizes[k] for k in range(n)])
            quarters = np.ceil(4 * shares / shares.sum()).astype(int)
            found[w] = tuple(1 + 5 * k + int(q) for k, q in enumerate(quarters))
    return found


def features(words: list[str], lexicon: dict[str, tuple[int, ...]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and the word of each: runs of 2 to 4 signs of the word with its two ends marked (those with a mark are
    its affixes), the word itself, and its lexicon entry or the lack of one. All words at once, in arrays."""
    line = "".join([f"\x02{w}\x03" for w in words])
    signs = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    low = np.uint64(1 + 5 * n)
    span = np.uint64(FEATURES) - low

    def slot(hashes: np.ndarray, kind: int) -> np.ndarray:
        hashes = (hashes + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        return ((hashes ^ (hashes >> np.uint64(29))) % span + low).astype(np.int64)

    ids, owner = [], []
    with np.errstate(over="ignore"):
        hashes = signs
        for size in range(2, 5):
            hashes = hashes[:-1] * np.uint64(1_000_003) + signs[size - 1 :]
            inside = word[: len(hashes)] == word[size - 1 :]
            ids.append(slot(hashes[inside], size))
            owner.append(word[: len(hashes)][inside])
        place = np.arange(len(signs), dtype=np.uint64) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.uint64)
        whole = np.add.reduceat((signs + place * np.uint64(0x1F3D5B79)) * (signs + np.uint64(0x9E3779B1)), np.cumsum(lengths) - lengths)
        ids.append(slot(whole, 5))
        owner.append(np.arange(len(words)))
    known = [lexicon.get(w, (0,)) for w in words]
    ids.append(np.fromiter((x for k in known for x in k), np.int64))
    owner.append(np.repeat(np.arange(len(words)), [len(k) for k in known]))
    return np.concatenate(ids), np.concatenate(owner)


def words_in(text: str | None) -> list[str]:
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def sample(docs: DataFrame, per_language: int, windows: int, width: int) -> list[tuple[str, list[str]]]:
    """(language, words): up to ``windows`` windows, spread over the whole text, of about ``per_language`` documents of each language.

    Documents are picked by a hash of key and text, with a rate from the language's count, so no language is sorted or gathered.
    """
    counts = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # the model has a label for each
    if not counts:
        return []
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_language / n) * (1 << 40)))])
    picked = docs.filter(F.pmod(F.xxhash64("key", "text", F.lit(77)), F.lit(1 << 40)) < F.element_at(rates, F.col("lang"))).select("lang", "text")
    picked = picked.limit(4 * per_language * len(counts))  # only met where most rows are one row over and over

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            langs, found = [], []
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                words = words_in(text)
                many = min(windows, -(-len(words) // width))
                for i in range(many):
                    at = 0 if many == 1 else (len(words) - width) * i // (many - 1)
                    langs.append(lang)
                    found.append(words[at : at + width])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["lang", "words"])

    rows = picked.mapInArrow(cut_out, "lang string, words array<string>").collect()
    return sorted((r.lang, list(r.words)) for r in rows)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 150, windows: int = 4, width: int = 24, rounds: int = 30) -> Model:
    """A model from documents whose language is known. Texts and languages are learned from; ``key`` only deals the sample.

    The sample is bounded: about ``per_language`` documents of each language, ``windows`` windows of ``width`` words of each.
    Every other sequence is spliced from windows of two languages, so that moves between languages are learned
    beside moves within one. Null languages and texts are left out; without any language the model has none.
    """
    known = docs.select(named(lang).cast("string").alias("lang"), named(text).alias("text"), named(key).alias("key")).filter("lang is not null and text is not null")
    rows = [(k, w) for k, w in sample(known, per_language, windows, width) if w]
    languages = sorted({k for k, _ in rows})
    if not rows:
        return Model([], Chain(np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0)), {})
    number = {k: i for i, k in enumerate(languages)}
    order = np.random.default_rng(7).permutation(len(rows))
    sequences, labels = [], []
    for at in range(0, len(order), 2):
        (l1, w1), (l2, w2) = rows[order[at]], rows[order[min(at + 1, len(order) - 1)]]
        a, b = len(w1) // 2, len(w2) // 3
        for parts in ([(l1, w1)], [(l2, w2)]) if at % 4 else ([(l1, w1[:a]), (l2, w2[b:]), (l1, w1[a:])],):
            sequences.append([w for _, words in parts for w in words])
            labels.append([number[k] for k, words in parts for _ in words])
    lexicon = lexicon_of(sequences, labels, len(languages))
    ids, owner = features([w for s in sequences for w in s], lexicon, len(languages))
    chain = train(ids, owner, np.array([k for s in labels for k in s]), np.array([len(s) for s in sequences]), FEATURES, len(languages), rounds)
    return Model(languages, chain, lexicon)


class Labeller:
    """Label probabilities of words; a word's scores are worked out once for as long as it is remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.scores = np.zeros((0, len(model.languages)))

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        """Of all words of the (non-empty) texts, one after the other."""
        if len(self.known) > REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
        known = self.known
        new = list(dict.fromkeys(w for words in texts for w in words if w not in known))
        made = [self.scores]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            made.append(self.model.chain.scores(*features(some, self.model.lexicon, len(self.model.languages)), len(some)))
        for w in new:
            known[w] = len(known)
        self.scores = np.concatenate(made)
        at = np.fromiter((known[w] for words in texts for w in words), np.int64)
        return posteriors(self.model.chain, self.scores[at], np.array([len(words) for words in texts]))


def identify(docs: DataFrame, model: Model, *, text: str = "text", carry: list[str] | None = None, spans: bool = False) -> DataFrame:
    """``carry`` (default: all columns but the text) with lang_pred, score, n_words, n_switches, and runs of one language with ``spans``.

    Every word (run of letters) of the whole text gets its probabilities from all words around it; the text's language
    has the highest mean, which is the score. ``n_switches`` counts changes of the likeliest language from word to word,
    ``spans`` lists them as (lang, first word, words). Null texts, texts without a letter, and all texts under a model
    without languages are ``und`` with score 0. Repeated rows are labelled each; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != text] if carry is None else carry
    rows = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(kept)], named(text).alias("text"))
    own = rows.schema.fields[: len(kept)]
    names = [f.name for f in own] + ["lang_pred", "score", "n_words", "n_switches"] + ["spans"] * spans
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
    most = max(1 << 16, (64 << 20) // max(4, len(model.languages)) ** 2)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        languages = np.array(model.languages or ["und"], dtype=object)
        for part in pieces(batches, "text", min(most, 2 << 20)):
            texts = [words_in(t) if model.languages else [] for t in part.column("text").to_pylist()]
            n = np.array([len(words) for words in texts], np.int64)
            pred, score, switches = np.full(len(n), "und", dtype=object), np.zeros(len(n)), np.zeros(len(n), np.int64)
            runs: list[list[dict]] = [[] for _ in texts]
            if (full := np.flatnonzero(n)).size:
                given = labeller.probabilities([texts[i] for i in full])
                first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                mean = np.add.reduceat(given, first, axis=0) / n[full][:, None]
                best = given.argmax(axis=1)
                turned = np.concatenate([[True], best[1:] != best[:-1]])
                turned[first] = True
                pred[full], score[full] = languages[mean.argmax(axis=1)], np.minimum(mean.max(axis=1), 1.0)
                switches[full] = np.add.reduceat(turned.astype(np.int64), first) - 1
                if spans:
                    edges = np.flatnonzero(turned)
                    for at, end in zip(edges, [*edges[1:], len(best)]):
                        i = int(np.searchsorted(first, at, side="right")) - 1
                        runs[full[i]].append({"lang": languages[best[at]], "first": int(at - first[i]), "words": int(end - at)})
            made = [pa.array(pred, pa.string()), pa.array(score), pa.array(n), pa.array(switches)] + [pa.array(runs, run_type)] * spans
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=names)

    run = StructType([StructField("lang", StringType()), StructField("first", LongType()), StructField("words", LongType())])
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_words", LongType()), StructField("n_switches", LongType())]
    made = rows.mapInArrow(label, StructType([*own, *fields, *[StructField("spans", ArrayType(run))] * spans]))
    return made.select(*renamed(kept, names[len(kept) :]), *names[len(kept) :])

