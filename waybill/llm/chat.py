"""Chat formatting: conversations rebuilt from event logs, rendered with a reversible template, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import read

OPEN, BREAK, CLOSE = "<|turn|>", "\n", "<|end|>\n"
#: Control strings begin with "<|"; in a text that pair gets a backslash between, and runs of backslashes there one more.
_ESCAPABLE = r"<(\\*)\|"
_ESCAPED = r"<\\(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPABLE, r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(_ESCAPED, r"<\1|", text)


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the final messages of an event log (conv_id, seq, turn, kind, role, text).

    Kinds: ``message`` and ``regenerate`` begin a turn's text anew, ``edit`` does so and also drops what later turns had got
    before it, ``delta`` appends. Events of a conversation count in the order of seq. A turn whose text never began starts
    empty. Null text is empty; a null role is that of the turn's first event that has one, else ``user``; null turns or
    sequence numbers come first; an empty log gives no rows. The fold is one window over a conversation's turns, for edits,
    then one over a turn's events: both spill, and no conversation is gathered into a list but for the deltas of one turn.
    """
    e = events.select("conv_id", "seq", "turn", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    cut = F.max(F.when(F.col("kind") == "edit", F.col("seq"))).over(earlier)
    alive = e.withColumn("cut", cut).where("cut is null or seq > cut")
    of_turn = Window.partitionBy("conv_id", "turn")
    began = F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(of_turn)
    parts = alive.withColumn("began", began).where("began is null or seq >= began")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return parts.groupBy("conv_id", "turn").agg(
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("user")).alias("role"),
        F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with ``rendered``: a turn's part of the formatted conversation.

    A turn is ``<|turn|>role\\ntext<|end|>\\n``. Escaping makes ``<|`` impossible inside a role or a text, so the parts of a
    conversation, joined in the order of turns, can be read back exactly. A role's line breaks are escaped as well.
    """
    role = F.regexp_replace(F.regexp_replace(escape(F.coalesce("role", F.lit(""))), r"\\", r"\\\\"), "\n", r"\\n")
    body = escape(F.coalesce("text", F.lit("")))
    return messages.withColumn("rendered", F.concat(F.lit(OPEN), role, F.lit(BREAK), body, F.lit(CLOSE)))


def parse(part: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in formatted text."""
    out = []
    for turn in part.split(OPEN)[1:]:
        if not turn.endswith(CLOSE):
            raise ValueError("a turn does not end")
        role, text = turn[: -len(CLOSE)].split(BREAK, 1)
        role = re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", role)
        out.append((unescape(role), unescape(text)))
    return out


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations as one text each."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "rendered")))
    return render(messages).groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["rendered"]), "").alias("formatted"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(rendered: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Digests of formatted conversations, read from ``rendered`` alone; the loss mask covers the texts of ``loss_role``.

    Parts of a conversation meet in one task in the order of turns and are read one at a time: a conversation of any length
    takes the memory of an Arrow batch.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, state = None, None

        def end() -> None:
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or key != conv:
                    if state is not None:
                        end()
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(part):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == loss_role:
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(part)
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if state is not None:
            end()
        yield _rows(out)

    # ties of a turn are put in the order of their text, so that reruns agree
    parts = rendered.select("conv_id", "rendered", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return parts.select("conv_id", "rendered").mapInArrow(digest, DIGEST)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def op1_chat(spark, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    # each row is a message event of a turn of its own, also where a turn's number comes again
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    events = turns.unionByName(planted).withColumn("seq", place).select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "role", "text")
    return read_back(render(reconstruct(events)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
