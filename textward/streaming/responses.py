"""Model output beside the analysis of its prompt, over tables and over streams.

An output guard reads what the input guards left in the prompt's metadata (a canary token, for instance), so responses are
joined with analysed prompts on the columns that name a request, within a time. A response that has no prompt is validated
all the same, without metadata: a stream gives it out once no prompt can come any more. State holds the prompts' keys, times and
metadata and no texts, until the watermark is past them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.pipeline import Pipeline

ANALYSIS = "analysis"


def asked(prompts: DataFrame, on: list[str], at: str) -> DataFrame:
    """Of analysed prompts what their responses are joined with."""
    return prompts.select(*[F.col(f"`{c}`").alias(f"asked_{c}") for c in on], F.col(f"`{at}`").alias("asked_at"), F.col("safe").alias("prompt_safe"), F.col("metadata").alias(ANALYSIS))


def joined(prompts: DataFrame, responses: DataFrame, on: list[str], asked_at: str, said_at: str, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Responses with asked_at, prompt_safe and analysis of the prompt of equal ``on`` at most ``within`` before them; nulls where there is none.

    ``prompts`` come from ``Pipeline.analyze``. Two prompts of one request in reach make two rows of its response; null keys meet nothing.
    Streams may be up to ``late`` out of order; rows later than that are dropped by the watermark. A request that many share splits by Spark's skew join.
    """
    left, right = responses, asked(prompts, on, asked_at)
    if responses.isStreaming:
        left = left.withWatermark(said_at, late)
    if prompts.isStreaming:
        right = right.withWatermark("asked_at", late)
    meets = (F.col("asked_at") <= F.col(f"`{said_at}`")) & (F.col("asked_at") >= F.col(f"`{said_at}`") - F.expr(f"INTERVAL {within}"))
    for c in on:
        meets = meets & (F.col(f"`{c}`") == F.col(f"`asked_{c}`"))
    return left.join(right, meets, "left").drop(*[f"asked_{c}" for c in on])


def validated(pipeline: Pipeline, prompts: DataFrame, responses: DataFrame, on: list[str], asked_at: str, said_at: str, text: str = "text", prompt_text: str = "text", within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Responses through the pipeline's output guards, each with what its input guards found in the prompt."""
    both = joined(pipeline.analyze(prompts, prompt_text), responses, on, asked_at, said_at, within, late)
    return pipeline.validate_output(both, text, ANALYSIS)
