"""Conversations, answers and their events as functions over two tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.functions import text as T

CONVERSATION = "id string, repo_id string, title string, created_at double, updated_at double"
MESSAGE = "id bigint, conversation_id string, role string, content string, meta string, created_at double"
NO_ANSWER = "I couldn't find anything relevant to this question in the indexed code."


class LLMClient(Protocol):
    """An injected generator: messages in, text pieces out."""

    def stream(self, messages: list[dict]) -> Iterable[str]: ...


def create(conversations: DataFrame, repo_id: str, title: str, now: float) -> DataFrame:
    row = conversations.sparkSession.createDataFrame([(repo_id, title[:80], float(now))], "repo_id string, title string, created_at double")
    row = row.select(F.substring(F.sha2(F.concat_ws("|", "repo_id", "title", F.col("created_at").cast("string")), 256), 1, 12).alias("id"), "repo_id", "title", "created_at", F.col("created_at").alias("updated_at"))
    return conversations.unionByName(row)


def rename(conversations: DataFrame, conv_id: str, title: str) -> DataFrame:
    return conversations.withColumn("title", F.when(F.col("id") == conv_id, T.rename_title(F.lit(title))).otherwise(F.col("title")))


def delete(conversations: DataFrame, messages: DataFrame, conv_id: str) -> tuple[DataFrame, DataFrame]:
    """Messages go with their conversation."""
    return conversations.filter(F.col("id") != conv_id), messages.filter(F.col("conversation_id") != conv_id)


def add_message(conversations: DataFrame, messages: DataFrame, conv_id: str, role: str, content: str, now: float, meta: str | None = None) -> tuple[DataFrame, DataFrame]:
    top = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    row = top.select((F.col("m") + 1).alias("id"), F.lit(conv_id).alias("conversation_id"), F.lit(role).alias("role"), F.lit(content).alias("content"), F.lit(meta).cast("string").alias("meta"), F.lit(float(now)).alias("created_at"))
    touched = conversations.withColumn("updated_at", F.when(F.col("id") == conv_id, F.lit(float(now))).otherwise(F.col("updated_at")))
    return touched, messages.unionByName(row)


def listing(conversations: DataFrame, repo_id: str | None = None) -> DataFrame:
    d = conversations if repo_id is None else conversations.filter(F.col("repo_id") == repo_id)
    return d.orderBy(F.desc("updated_at"), "id")


def last_messages(messages: DataFrame, turns: int = 2) -> DataFrame:
    """The last 2 * turns messages of every conversation."""
    w = W.partitionBy("conversation_id").orderBy(F.desc("id"))
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2 * turns).drop("_r")


def delete_last_exchange(messages: DataFrame) -> DataFrame:
    """Every conversation without its last user message and what follows it; one without a user message stays."""
    last = messages.filter("role = 'user'").groupBy("conversation_id").agg(F.max("id").alias("_last"))
    return messages.join(last, "conversation_id", "left").filter("_last is null or id < _last").drop("_last")


def rewrite_messages(history: list[dict], question: str) -> list[dict]:
    """Prompt for a question that stands alone: the history in short, then the question."""
    told = "\n".join(f"{m['role']}: {m['content'] if len(m['content']) <= 600 else m['content'][:600] + ' ...'}" for m in history)
    return [{"role": "system", "content": "Rewrite the last question so that it can be understood without the conversation. Answer with the question only."}, {"role": "user", "content": f"{told}\n\nQuestion: {question}"}]


def answer_messages(question: str, context: str) -> list[dict]:
    return [{"role": "system", "content": "Answer from the numbered snippets only and cite them like [1]."}, {"role": "user", "content": f"{context}\n\nQuestion: {question}"}]


def answer_events(question: str, chunks: list[dict], best: float | None, threshold: float, model: LLMClient, cite: Callable[[str, int], list[int]]) -> Iterator[tuple[str, dict]]:
    """retrieval, then token* and done, or no_answer; an error ends the sequence with error."""
    yield "retrieval", {"chunks": chunks, "best": best}
    if not chunks or best is None or best < threshold:
        yield "no_answer", {"message": NO_ANSWER, "suggestions": [f"What does {c['file_path']} do?" for c in chunks[:3]]}
        return
    said: list[str] = []
    try:
        for piece in model.stream(answer_messages(question, "\n\n".join(c["block"] for c in chunks))):
            said.append(piece)
            yield "token", {"text": piece}
    except Exception as e:  # noqa: BLE001
        yield "error", {"message": str(e)}
        return
    text = "".join(said)
    yield "done", {"answer": text, "citations": [{"n": n, "chunk_id": chunks[n - 1]["chunk_id"]} for n in cite(text, len(chunks))]}
