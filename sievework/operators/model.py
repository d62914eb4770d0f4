"""Model-backed table jobs.

The service is not part of this library: every job takes ``model``, a function from a list
of prompts to a list of answers, called for up to 256 prompts of an Arrow batch. Prompts are built and answers
parsed with column expressions. An answer that cannot be had is NULL, never a failed job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework import rules
from sievework.functions import fields as fld
from sievework.functions.parsing import parse_model_json, parse_name_list, parse_query_expansions
from sievework.functions.text import is_blank, unnest
from sievework.operators.joins import overlay_by_index
from sievework.operators.keys import batch_ids
from sievework.operators.names import dedupe_basic, pick_representative
from sievework.operators.positions import with_position
from sievework.session import cut

Model = Callable[[list[str]], list[str]]
PROMPT_LIMIT = 15000
FALLBACK_LIMIT = 5000
#: Prompts that go out in one call, and are Python objects at once.
PROMPTS = 256


def ask(df: DataFrame, prompt: Column, model: Model) -> DataFrame:
    """Add ``answer`` and ``error``. A batch that fails is retried prompt by prompt."""
    asked = df.withColumn("_prompt", prompt)
    rest = [f for f in asked.schema.fields if f.name != "_prompt"]
    schema = T.StructType([*rest, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def one(text: str):
        try:
            return model([text])[0], None
        except Exception as problem:  # noqa: BLE001 - reported as data
            return None, str(problem)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PROMPTS):
                batch = whole.slice(at, PROMPTS)
                prompts = batch.column("_prompt").to_pylist()
                try:
                    pairs = [(a, None) for a in model(prompts)]
                    if len(pairs) != len(prompts):
                        raise ValueError("wrong number of answers")
                except Exception:  # noqa: BLE001
                    pairs = [one(p) for p in prompts]
                new = [pa.array([pair[i] for pair in pairs], pa.string()) for i in (0, 1)]
                names = [f.name for f in rest]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], [*names, "answer", "error"])

    return asked.mapInArrow(run, schema)


def _prompt(task: str, **parts: Column) -> Column:
    """First line names the task; each part is a labelled block."""
    lines = [F.lit(f"TASK {task}")]
    for label, value in parts.items():
        lines.append(F.concat(F.lit(f"{label.upper()}: "), F.coalesce(value.cast("string"), F.lit(""))))
    return F.concat_ws("\n", *lines)


def expand_queries(df: DataFrame, id: str, query: str, n: int, model: Model) -> DataFrame:
    """(id, pos, query): the original, then at most n new ones."""
    answered = ask(df.select(id, query), _prompt("expand", count=F.lit(n), query=F.col(query)), model)
    queries = parse_query_expansions(F.col(query), F.coalesce("answer", F.lit("")), n)
    return unnest(answered, [id], queries, query, "pos")


def extract_names(df: DataFrame, keep: list[str], text: Column, query: Column, model: Model) -> DataFrame:
    """(keep, name), one row per name in answer order."""
    prompt = _prompt("extract", query=query, text=text)
    answered = ask(df, prompt, model)
    return unnest(answered, keep, parse_name_list(F.col("answer")), "name", "name_pos")


def _subset(df: DataFrame, keep: list[str], names: str, prompt: Column, model: Model) -> DataFrame:
    """Names of the answer that were asked about, in asked order; failure gives none."""
    answered = ask(df.select(*keep, names, prompt.alias("_p")), F.col("_p"), model).drop("_p")
    allowed = F.coalesce(parse_name_list(F.col("answer")), F.array().cast("array<string>"))
    lowered = F.transform(allowed, F.lower)
    kept = F.filter(F.col(names), lambda n: F.array_contains(lowered, F.lower(n)))
    return unnest(answered, keep, kept, "name", "name_pos")


def validate_names(df: DataFrame, keep: list[str], names: str, url: str, model: Model) -> DataFrame:
    """``names`` is an array column."""
    prompt = _prompt("validate", url=F.col(url), names=F.array_join(names, ", "))
    return _subset(df, [*keep, url], names, prompt, model)


def filter_relevant(df: DataFrame, keep: list[str], names: str, query: Column, model: Model) -> DataFrame:
    """The prompt names the coating topic when the query does."""
    topic = F.when(F.lower(query).rlike(r"\bdlc\b|diamond-like carbon"), "diamond-like carbon coatings").otherwise("")
    prompt = _prompt("relevant", query=query, topic=topic, names=F.array_join(names, ", "))
    return _subset(df, keep, names, prompt, model)


def choose_names(groups: DataFrame, members: DataFrame, model: Model | None = None, query: str = "", per_prompt: int = 10) -> DataFrame:
    """(leader, name). Without a usable answer it is the first name of the group.

    A prompt lists up to ``per_prompt`` names. Larger groups are asked about in slices, and then about the
    names chosen there, until one is left; so every name of a group takes part.
    """
    first = pick_representative(groups)
    if model is None:
        return first.select("leader", "name")
    left = cut(members.select("leader", "id", "name"))
    while True:
        placed = with_position(left, "id", ["leader"], out="_at").withColumn("_slice", F.floor((F.col("_at") - 1) / per_prompt).cast("long"))
        listed = placed.groupBy("leader", "_slice").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("m"))
        listed = listed.select("leader", "_slice", F.transform("m", lambda m: m["name"]).alias("names"))
        answered = ask(listed, _prompt("choose", query=F.lit(query), names=F.array_join("names", ", ")), model)
        choice = F.get(parse_name_list(F.col("answer")), F.lit(0))
        rounds_over = placed.filter("_slice > 0").isEmpty()
        if rounds_over:
            chosen = answered.select("leader", choice.alias("choice"))
            return first.join(chosen, "leader", "left").select("leader", F.coalesce("choice", "name").alias("name"))
        left = cut(answered.select("leader", F.col("_slice").alias("id"), F.coalesce(choice, F.get("names", F.lit(0))).alias("name")))


def extract_structured(df: DataFrame, company: str, source: str, content: str, wanted: list[str] | str, model: Model, limit: int = PROMPT_LIMIT, fallback: int = FALLBACK_LIMIT) -> DataFrame:
    """(company, source, field, value, kind). ``wanted`` are the fields, or names a column that lists those of each row.

    Content goes out in pieces of ``limit`` characters; a piece without a usable answer is asked about again in
    pieces of ``fallback`` characters. Per field the first piece with a value counts, so all of a text is asked about.
    """
    fields = F.to_json(F.col(wanted)) if isinstance(wanted, str) else F.lit(json.dumps(wanted))
    base = df.select(company, source, content, fields.alias("_wanted"))

    def in_pieces(frame: DataFrame, size: int, text: str, place: list[str], out: str) -> DataFrame:
        last = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
        cuts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
        keep = [company, source, "_wanted", *place]
        return unnest(frame.filter(F.col(text).isNotNull()), keep, cuts, "_piece", out)

    def question(frame: DataFrame, place: list[str]) -> DataFrame:
        prompt = _prompt("fields", company=F.col(company), source=F.col(source), fields=F.col("_wanted"), text=F.col("_piece"))
        return parse_model_json(ask(frame, prompt, model), "answer", [company, source, "_wanted", *place, "_piece"])

    first = cut(question(in_pieces(base, limit, content, [], "_i"), ["_i"]))
    good = first.filter("valid").select(company, source, "_i", F.lit(0).alias("_j"), "json")
    again = question(in_pieces(first.filter("not valid"), fallback, "_piece", ["_i"], "_j"), ["_i", "_j"])
    failed = F.to_json(F.create_map(F.lit("Company Name"), F.col(company).cast("string"), F.lit("error"), F.col("error")))
    again = again.select(company, source, "_i", F.col("_j").alias("_j"), F.coalesce("json", failed).alias("json"))
    rows = good.unionByName(again).select(F.struct(company, source, "_i", "_j").alias("_key"), "json")
    out = fld.coerce_fields(rows, "_key", "json")
    out = out.filter(~is_blank(F.col("value"), tuple(rules.EMPTY_SPELLINGS) + ("[]", "{}")))
    best = out.groupBy(f"_key.{company}", f"_key.{source}", "field").agg(F.min_by(F.struct("kind", "value"), F.struct("_key._i", "_key._j")).alias("_b"))
    return best.select(company, source, "field", "_b.kind", "_b.value")


def analyze(df: DataFrame, company: str, text: Column, wanted: list[str], model: Model) -> DataFrame:
    """(company, data, confidence): 0.9 for JSON, 0.5 otherwise, 0.0 on an error."""
    prompt = _prompt("fields", company=F.col(company), fields=F.lit(json.dumps(wanted)), text=F.col("_t"))
    answered = ask(df.select(company, text.alias("_t")), prompt, model).withColumnRenamed("error", "call_error")
    parsed = parse_model_json(answered, "answer", [company, "call_error", "answer"])
    confidence = F.when(F.col("call_error").isNotNull(), 0.0).when(F.col("valid"), 0.9).otherwise(0.5)
    return parsed.select(company, F.coalesce("json", "answer").alias("data"), confidence.alias("confidence"))


def validate_companies(df: DataFrame, index: str, record: str, query: str, model: Model, batch: int = 5) -> DataFrame:
    """(index, record). Records go out in batches of five, by index; a failed batch stays as it was.

    Batches are cut by position, so that one index on any number of rows still gives batches of five.
    """
    grouped = batch_ids(df.select(index, record), index, batch, "chunk")
    listed = grouped.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(index, record))).alias("m"))
    listed = listed.select(
        "chunk",
        F.transform("m", lambda m: m[index].cast("long")).alias("indices"),
        F.concat(F.lit("["), F.array_join(F.transform("m", lambda m: m[record]), ","), F.lit("]")).alias("records"),
    )
    answered = ask(listed, _prompt("correct", query=F.lit(query), records=F.col("records")), model)
    parsed = parse_model_json(answered.drop("error"), "answer", ["chunk", "indices"])
    listed_values = F.transform(F.try_variant_get(F.try_parse_json("json"), "$", "array<variant>"), lambda v: F.to_json(v))
    values = F.coalesce(listed_values, F.when(F.col("json").startswith("{"), F.array("json")))  # one object goes to the first index
    # written down, so that answers are parsed once and nobody is asked again
    chunks = cut(parsed.select("chunk", (F.col("valid") & values.isNotNull()).alias("ok"), "indices", values.alias("values")))
    return overlay_by_index(df.select(F.col(index).cast("long").alias(index), record), index, chunks, record)


def llm_dedupe(df: DataFrame, id: str, name: str, model: Model, batch: int = 50) -> DataFrame:
    """Distinct standardised names, asked for in batches; a failed batch keeps its cleaned names."""
    basic = dedupe_basic(df.select(id, name), id, name)
    listed = batch_ids(basic, id, batch, "_b").groupBy("_b")
    listed = listed.agg(F.array_sort(F.collect_list(F.struct(id, name))).alias("m"))
    names = F.transform("m", lambda m: m[name])
    answered = ask(listed.select("_b", names.alias("names")), _prompt("standardise", names=F.to_json("names")), model)
    out = F.coalesce(F.from_json("answer", "array<string>"), "names")
    return answered.select(F.explode(out).alias(name)).filter(~is_blank(F.col(name))).distinct()


def rule_model(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for tests: answers from the text of the prompt alone."""
    return [_rule_answer(p) for p in prompts]


def _part(prompt: str, label: str) -> str:
    found = re.search(rf"^{label}: (.*?)(?=^[A-Z]+: |\Z)", prompt, re.M | re.S)
    return found.group(1).strip() if found else ""


def _rule_answer(prompt: str) -> str:
    task = prompt.split("\n", 1)[0][5:]
    if task == "expand":
        query, count = _part(prompt, "QUERY"), int(_part(prompt, "COUNT"))
        ends = ["companies", "vendors", "startups", "suppliers", "market leaders"]
        return "\n".join(f"{i + 1}. {query} {ends[i % 5]}" + (f" {i // 5}" if i >= 5 else "") for i in range(count))
    if task == "extract":
        words = re.findall(r"\b[A-Z][a-zà-ÿ]{6,}\b", _part(prompt, "TEXT"))
        names = list(dict.fromkeys(words))
        return ", ".join(names) if names else "No startups found"
    if task in ("validate", "relevant"):
        names = [n.strip() for n in _part(prompt, "NAMES").split(",")]
        return ", ".join(n for n in names if len(n) % (2 if task == "validate" else 3) == 0) or "No names found"
    if task == "choose":
        return _part(prompt, "NAMES").split(",")[0].strip()
    if task == "fields":
        text, out = _part(prompt, "TEXT"), {}
        for field in json.loads(_part(prompt, "FIELDS")):
            if field == "Product Description":
                out[field] = text.split(".")[0][:200]
            elif field == "Founded Year":
                year = re.search(r"\b(?:19|20)\d{2}\b", text)
                out[field] = year.group(0) if year else None
            else:
                out[field] = "Not available"
        return "```json\n" + json.dumps(out, ensure_ascii=False) + "\n```"
    if task == "correct":
        return _part(prompt, "RECORDS")
    if task == "standardise":
        return _part(prompt, "NAMES")
    return ""
