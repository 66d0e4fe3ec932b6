"""Summaries and budgets: what of a document fits into a context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

#: Caps by level, the share that a summary keeps, and the weights of a sentence's signs.
CAPS = {"brief": 100, "summary": 500, "full": None}
SHARE, LEAST_TARGET, LEAST_SENTENCE, FEWEST, TOKENS_A_SENTENCE = 0.3, 20, 10, 2, 30
COLON, CAPITAL, MEDIUM, EMPHASIS = 2, 1, 1, 1
SHORT, LONG, MOST_TOPICS, DIGEST = 50, 200, 10, 500
#: USD a million tokens (input, output) of each provider; an unknown one costs as DEFAULT_PROVIDER.
PRICES = [("deepseek", 0.14, 0.56), ("qwen", 0.03, 0.12), ("anthropic", 3.0, 15.0), ("openai", 1.75, 14.0), ("gemini", 0.3, 2.5)]
DEFAULT_PROVIDER, OUTPUT_TOKENS = "deepseek", 500


def key_sentences(content: Column, n: Column | int) -> Column:
    """The n best sentences of a text as an array, best first; all of them in order if there are no more than n."""
    sentences = F.filter(F.split(F.regexp_replace(content, r"\n+", " "), r"(?<=[.!?])\s+"), lambda s: F.length(F.regexp_replace(s, r"^\s+|\s+$", "")) > LEAST_SENTENCE)
    sign = lambda c, w: F.when(c, w).otherwise(0)
    score = lambda s: sign(F.contains(s, F.lit(":")), COLON) + sign(s.rlike("^[A-Z]"), CAPITAL) + sign((F.length(s) > SHORT) & (F.length(s) < LONG), MEDIUM) + sign(s.rlike(r"\*\*|`"), EMPHASIS)
    n = F.lit(n) if isinstance(n, int) else n
    ranked = F.transform(F.array_sort(F.transform(sentences, lambda s, i: F.struct((-score(s)).alias("r"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
    return F.when(F.size(sentences) <= n, sentences).otherwise(F.slice(ranked, F.lit(1), n))


def summarize_sections(sections: DataFrame, level: str = "summary") -> DataFrame:
    """Add summary, original_tokens and summary_tokens to each section at level brief, summary or full."""
    own, cap = F.col("token_count"), CAPS[level]
    target = F.greatest(own * SHARE, F.lit(float(LEAST_TARGET)))
    target = target if cap is None else F.least(target, F.lit(float(cap)))
    flags = F.array_compact(F.array(*(F.when(F.col(f"has_{x}"), x) for x in ("code", "list", "table"))))
    brief = F.when(F.size(flags) > 0, F.concat(F.lit("["), F.array_join(flags, ", "), F.lit("]"))).otherwise("")
    points = key_sentences(F.col("plain_text"), F.greatest(F.lit(FEWEST), F.floor(target / TOKENS_A_SENTENCE).cast("int")))
    words = F.split("plain_text", r"\s+")
    kept = F.slice(words, F.lit(1), F.floor(target).cast("int"))
    cut = F.concat(F.array_join(kept, " "), F.when(F.size(kept) < F.size(words), "...").otherwise(""))
    shorter = brief if level == "brief" else F.when(F.size("__points") > 0, F.array_join("__points", " ")).otherwise(cut)
    out = sections.withColumn("__points", points)
    out = out.withColumn("summary", F.when(F.lit(level == "full") | (own <= target), F.col("plain_text")).otherwise(shorter)).drop("__points")
    return out.withColumns({"original_tokens": own, "summary_tokens": tx.token_count(F.col("summary"))})


def topics(sections: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(path, topics): the first ten distinct headings, cleaned and in lower case, then tags."""
    clean = F.trim(F.regexp_replace(F.lower("heading"), r"[^\w\s-]", ""))
    heads = sections.select("path", F.col("ordinal").alias("at"), clean.alias("topic")).filter(F.length("topic").between(3, 49))
    if documents is not None and "tags" in documents.columns:
        tags = documents.select("path", F.posexplode("tags").alias("k", "topic")).select("path", (F.col("k") + 2**30).alias("at"), F.lower("topic").alias("topic"))
        heads = heads.unionByName(tags)
    first = heads.groupBy("path", "topic").agg(F.min("at").alias("at"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("at", "topic"))).filter(F.col("k") <= MOST_TOPICS)
    return ranked.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "topic"))), lambda x: x["topic"]).alias("topics"))


def summarize_documents(summaries: DataFrame) -> DataFrame:
    """(path, sections, original_tokens, summary_tokens, compression) of summarized sections."""
    out = summaries.groupBy("path").agg(F.count("*").alias("sections"), F.sum("original_tokens").alias("original_tokens"), F.sum("summary_tokens").alias("summary_tokens"))
    return out.withColumn("compression", F.when(F.col("original_tokens") > 0, 1 - F.col("summary_tokens") / F.col("original_tokens")).otherwise(0.0))


def token_reduction(documents: DataFrame) -> DataFrame:
    """(path, original_tokens, summary_tokens, saved, percent)."""
    saved = F.col("original_tokens") - F.col("summary_tokens")
    return documents.select("path", "original_tokens", "summary_tokens", saved.alias("saved"), F.when(F.col("original_tokens") > 0, F.round(100 * saved / F.col("original_tokens"), 1)).otherwise(0.0).alias("percent"))


def render_summary(summaries: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, rendered, tokens): title, path, a token line that counts itself, and the sections in order."""
    part = F.concat(F.repeat(F.lit("#"), F.greatest(F.col("level"), F.lit(1))), F.lit(" "), F.col("heading"), F.when(F.col("summary") != "", F.concat(F.lit("\n"), F.col("summary"))).otherwise(""))
    body = summaries.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("body"), F.sum("original_tokens").alias("original"))
    out = body.join(documents.select("path", "title"), "path")
    text = lambda n: F.concat(F.lit("# "), "title", F.lit("\nPath: "), "path", F.lit("\nTokens: "), n.cast("string"), F.lit(" of "), F.col("original").cast("string"), F.lit("\n\n"), "body")
    for k in range(3):  # the count is part of the text that it counts
        out = out.withColumn(f"n{k}", tx.token_count(text(F.col(f"n{k - 1}") if k else F.lit(0))))
    return out.select("path", text(F.col("n2")).alias("rendered"), F.col("n2").alias("tokens"))


def assemble_context(items: DataFrame, budget: int | Column, group: str = "query_id", order: str = "place", tokens: str = "tokens", brief: str = "brief_tokens") -> DataFrame:
    """Greedy packing of each group's items in order: an item is taken whole if it fits, else in brief, else left; later
    ones may still fit. Adds included (full, brief or overflow) and used (tokens so far). A group is one array: at most
    what one context has for candidates."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    rows = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("t"), F.col(brief).cast("long").alias("b")))).alias("rows"), F.min(limit).cast("long").alias("budget"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<o:{items.schema[order].dataType.simpleString()},included:string,used:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full, short = s["used"] + x["t"] <= F.col("budget"), s["used"] + x["b"] <= F.col("budget")
        used = F.when(full, s["used"] + x["t"]).when(short, s["used"] + x["b"]).otherwise(s["used"])
        kind = F.when(full, "full").when(short, "brief").otherwise("overflow")
        return F.struct(used.alias("used"), F.concat(s["out"], F.array(F.struct(x["o"].alias("o"), kind.alias("included"), used.alias("used")))).alias("out"))

    picks = rows.withColumn("out", tx.once(F.aggregate("rows", start, step, lambda s: s["out"]))).select(group, F.explode("out").alias("p"))
    return items.join(picks.select(group, F.col("p.o").alias(order), F.col("p.included").alias("included"), F.col("p.used").alias("used")), [group, order])


def document_context(summaries: DataFrame, max_tokens: int, level: str = "summary") -> DataFrame:
    """Each document's sections within a token limit: whole, over budget the heading alone (dropped at level brief)."""
    heading = tx.token_count(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("heading")))
    short = F.lit(2**30) if level == "brief" else heading
    items = summaries.withColumns({"tokens": F.col("summary_tokens") + heading, "brief_tokens": short})
    return assemble_context(items, max_tokens, "path", "ordinal")


def digest_results(results: DataFrame, cut: int = DIGEST) -> DataFrame:
    """(query_id, digest): the numbered results of each query, contents cut."""
    content = F.when(F.length("content") > cut, F.concat(F.substring("content", 1, cut), F.lit("..."))).otherwise(F.col("content"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("heading"), F.lit(" ("), F.col("path"), F.lit(")\n"), F.coalesce(content, F.lit("")))
    return results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("digest"))


def generation_cost(df: DataFrame) -> DataFrame:
    """Add input_tokens, output_tokens and cost to (text, mode, provider); mode cli is free."""
    table = F.broadcast(df.sparkSession.createDataFrame(PRICES, "known string, price_in double, price_out double"))
    names = [p[0] for p in PRICES]
    out = df.withColumn("__p", F.when(F.col("provider").isin(names), F.col("provider")).otherwise(DEFAULT_PROVIDER)).join(table, F.col("__p") == F.col("known"))
    out = out.withColumns({"input_tokens": tx.token_estimate(F.col("text")), "output_tokens": F.lit(OUTPUT_TOKENS)})
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6
    return out.withColumn("cost", F.when(F.col("mode") == "cli", 0.0).otherwise(cost)).drop("__p", "known", "price_in", "price_out")


def summarize_groups(digests: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """(query_id, summary) by a user's function over batches of digests."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query_id": b["query_id"], "summary": fn(b["digest"].tolist())})

    return digests.select("query_id", "digest").mapInPandas(told, f"query_id {digests.schema['query_id'].dataType.simpleString()}, summary string")


def sections_to_text(selected: DataFrame) -> DataFrame:
    """(path, text): the selected sections of each document in order."""
    return selected.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "\n\n").alias("text"))
