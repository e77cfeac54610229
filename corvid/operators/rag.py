"""Context, messages, answers and their sources."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import CLOSED_BLOCK, citations, squash, strip_leading_ref

#: What stands for an empty context, and the answer to it.
NO_CONTEXT = "No relevant context found."
NO_ANSWER = "No relevant information found in the database."
SYSTEM = "Answer from the context alone and cite its references in square brackets."


#: What stands between two results in a context.
RULE = "\n\n---\n\n"


def result_text(location: Column, chunks: Column) -> Column:
    """The text under a result's header: its chunks, without its own location at their start. Null if there is none."""
    texts = F.array_join(F.filter(F.transform(chunks, squash), lambda t: t != ""), "\n\n")
    return F.when(texts != "", strip_leading_ref(texts, location))


def format_context(results: DataFrame, group: str | None = None) -> DataFrame:
    """One text of results (position, location, chunks array<string>): a header line and the chunks; results without text are left out. NO_CONTEXT if none is left."""
    header = F.when(F.coalesce(F.col("location"), F.lit("")) != "", F.concat(F.lit("["), F.col("location"), F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("position").cast("string"), F.lit("]")))
    block = results.withColumn("_s", F.concat(header, F.lit("\n"), result_text(F.col("location"), F.col("chunks"))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("position", "_s")))), lambda x: x["_s"]), RULE)
    out = block.groupBy(*([group] if group else [])).agg(joined.alias("context"))
    return out.withColumn("context", F.when(F.coalesce("context", F.lit("")) == "", NO_CONTEXT).otherwise(F.col("context")))


def context_md5(results: DataFrame, group: str, *order: Column) -> DataFrame:
    """(group, n_results, context_md5): of each group's results (location, chunks), numbered in the given order, how many have text, and the digest of what format_context makes of them.

    A group's results stream by in order, so none of its context is held.
    """
    kind = results.schema[group].dataType
    rows = results.select(group, F.nullif("location", F.lit("")).cast("binary").alias("_l"), result_text(F.col("location"), F.col("chunks")).cast("binary").alias("_t"), *(c.alias(f"_o{k}") for k, c in enumerate(order)))
    dealt = rows.repartition(F.col(group)).sortWithinPartitions(group, *(F.col(f"_o{k}").asc_nulls_last() for k in range(len(order)))).select(group, "_l", "_t")

    def run(batches):
        form, key, digest, position, n, began = None, None, None, 0, 0, False

        def ended():
            if not n:
                digest.update(NO_CONTEXT.encode())
            return pa.RecordBatch.from_arrays([pa.array([key], form), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], [group, "n_results", "context_md5"])

        for b in batches:
            form = b.schema.field(0).type
            for g, location, text in zip(*(c.to_pylist() for c in b.columns)):
                if not began or g != key:
                    if began:
                        yield ended()
                    key, digest, position, n, began = g, hashlib.md5(usedforsecurity=False), 0, 0, True
                position += 1
                if text is not None:
                    digest.update(b"%s[%s]\n" % (RULE.encode() if n else b"", location or b"%d" % position))
                    digest.update(text)
                    n += 1
        if began:
            yield ended()

    return dealt.mapInArrow(run, f"`{group}` {kind.simpleString()}, n_results long, context_md5 string")


def build_messages(query: Column, context: Column, history: Column) -> Column:
    """System, the history's user and assistant messages that have content, and the question with its context."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    kept = F.filter(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda m: m["role"].isin("user", "assistant") & (F.coalesce(m["content"], F.lit("")) != ""))
    body = F.coalesce(F.nullif(squash(context), F.lit("")), F.lit(NO_CONTEXT))
    asked = F.concat(F.lit("Context:\n"), body, F.lit("\n\nQuestion: "), query, F.lit("\n\nAnswer:"))
    return F.concat(F.array(message("system", F.lit(SYSTEM))), kept, F.array(message("user", asked)))


def cited_sources(answers: DataFrame, sources: DataFrame, most: int = 5) -> DataFrame:
    """(answer_id, position, cited) of answers (answer_id, text) and sources (answer_id, position, refs array<string>).

    A reference points at the last source that has it. With no citation found, the first
    sources stand in.
    """
    refs = sources.select("answer_id", "position", F.explode("refs").alias("ref")).groupBy("answer_id", "ref").agg(F.max("position").alias("position"))
    cited = answers.select("answer_id", F.explode(F.array_distinct(citations(F.col("text")))).alias("ref")).join(refs, ["answer_id", "ref"]).groupBy("answer_id").agg(F.array_sort(F.collect_set("position")).alias("p"))
    known = sources.groupBy("answer_id").agg(F.array_sort(F.collect_set("position")).alias("all"))
    out = known.join(cited, "answer_id", "left").select("answer_id", F.posexplode(F.slice(F.coalesce("p", "all"), 1, most)).alias("n", "position"), F.col("p").isNotNull().alias("cited"))
    return out.select("answer_id", "position", "cited")


class Generator(Protocol):
    def generate(self, messages: list[dict]) -> str: ...


class Extractive:
    """A stand-in for a language model: the first sentence of the context, with its header as a citation."""

    def generate(self, messages: list[dict]) -> str:
        context = messages[-1]["content"].split("\n\nQuestion:")[0].removeprefix("Context:\n")
        return context.split(". ")[0]


#: Makers of generators by name; a model's client is added with register.
PROVIDERS: dict[str, Callable[..., Generator]] = {}


def register(make: Callable[..., Generator], *names: str) -> None:
    PROVIDERS.update({n.lower(): make for n in names})


def provider(name: str, **options) -> Generator:
    if name.lower() not in PROVIDERS:
        raise ValueError(f"no provider {name}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name.lower()](**options)


register(Extractive, "extractive", "offline")


def clean_pieces(pieces: Iterable[str]) -> Iterator[str]:
    """A streamed answer's pieces as clean_piece has them, empty ones left out."""
    for p in pieces:
        if kept := re.sub(CLOSED_BLOCK, "", p):
            yield kept


def ask(query: str, results: DataFrame, generator: Generator, clean: Callable[[str], str] = str.strip, history: list[dict] | None = None) -> str:
    """Formats the few results, which the driver needs for the call, and generates after the history's messages; NO_ANSWER, without a call, if they have no text."""
    context = format_context(results).first()["context"]
    if context == NO_CONTEXT:
        return NO_ANSWER
    kind = "array<struct<role:string,content:string>>"
    said = F.from_json(F.lit(json.dumps(history or [])), kind)
    row = results.sparkSession.range(1).select(build_messages(F.lit(query), F.lit(context), said).alias("m")).first()
    return clean(generator.generate([m.asDict() for m in row["m"]]))
