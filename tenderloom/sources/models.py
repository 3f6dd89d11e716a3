"""Adapters for models. A model is a callable over a list of texts; it is called in the tasks, in batches.

The package contains no model. `hashed_vectors` is a deterministic stand-in for an embedding model.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom import fixed_values as fixed
from tenderloom.functions.answers import untagged
from tenderloom.functions.questions import answer_style

Model = Callable[[list[str]], list[str]]


def with_replies(df: DataFrame, prompt: Column, model_factory: Callable[[], Model], out: str = "reply", attempts: int = 2) -> DataFrame:
    """Add the reply to each prompt, or null after the last failed attempt.

    The factory runs once per task. Filter the frame to the rows that need the model before: Spark evaluates a Python
    function for every row it is given.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for batch in batches:
            prompts = batch.pop("__prompt").tolist()
            replies: list[str | None] = [None] * len(prompts)
            for _ in range(attempts):
                try:
                    replies = list(model(prompts)) if prompts else []
                    break
                except Exception:
                    continue
            yield batch.assign(**{out: replies})

    return df.withColumn("__prompt", prompt).mapInPandas(ask, schema)


def hashed_vectors(dim: int = 64) -> Callable[[Column], Column]:
    """Bag-of-words vectors by hashing, unit length."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts.fillna("")):
            for word in text.lower().split():
                code = zlib.crc32(word.encode("utf-8"))
                out[row, code % dim] += 1.0 if code & 0x8000 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(out / np.where(length == 0, 1, length)))

    return embed


# ---------------------------------------------------------------- prompts
def answer_prompt(query: Column, context: Column, evidence: Column | None = None, history: Column | None = None) -> Column:
    """Prompt of an answer from context; with evidence it is the second step of a two-step generation."""
    style = F.when(answer_style(query) == "guide", F.lit("결론 한 문장과 불릿 2~4개로 답하세요.")).otherwise(F.lit("핵심 답을 1~2문장으로 답하세요."))
    parts = [F.lit("## 질문\n"), query, F.lit("\n\n## 문맥\n"), context]
    if evidence is not None:
        parts += [F.lit("\n\n## 근거\n"), evidence]
    if history is not None:
        parts += [F.when(history != "", F.concat(F.lit("\n\n## 이전 대화 기록\n"), history)).otherwise(F.lit(""))]
    return F.concat(*parts, F.lit("\n\n## 답변 스타일\n"), style)


def generated_answers(df: DataFrame, model_factory: Callable[[], Model]) -> DataFrame:
    """Two-step answers: refine the evidence, then answer from it; if a step fails, one prompt without evidence.

    Needs query, context, draft, history. The single-prompt step sees only the rows that need it.
    """
    query, context = F.col("query"), F.col("context")
    refine = F.concat(F.lit("다음 문맥에서 질문의 근거만 추리세요.\n"), answer_prompt(query, context), F.lit("\n\n## 초안\n"), F.coalesce("draft", F.lit("없음")))
    first = with_replies(df, refine, model_factory, "evidence")
    first = first.withColumn("evidence", F.coalesce(F.nullif("evidence", F.lit("")), F.nullif("draft", F.lit("")), F.lit("관련 근거 없음")))
    second = with_replies(first, answer_prompt(query, context, F.col("evidence"), F.col("history")), model_factory, "answer")
    done = second.filter("answer is not null")
    again = second.filter("answer is null").drop("answer")
    third = with_replies(again, answer_prompt(query, context, None, F.col("history")), model_factory, "answer")
    return done.unionByName(third).withColumn("answer", untagged(F.coalesce("answer", F.lit(""))))


def judge_prompt(question: Column, expected: Column, answer: Column, context: Column) -> Column:
    limit = fixed.JUDGE_CONTEXT_LIMIT
    shown = F.when(F.coalesce(context, F.lit("")) == "", F.lit("(검색 결과 없음)")).when(
        F.length(context) > limit, F.concat(F.substring(context, 1, limit), F.lit("\n\n... (이하 생략)"))
    ).otherwise(context)
    return F.concat(
        F.lit("## 질문\n"), question, F.lit("\n\n## 기대 정답\n"), expected, F.lit("\n\n## 생성 답변\n"), answer, F.lit("\n\n## 문맥\n"), shown,
        F.lit("\n\n각 기준을 0~5점으로 채점해 JSON 으로 답하세요: " + ", ".join(fixed.JUDGE_CRITERIA)),
    )
