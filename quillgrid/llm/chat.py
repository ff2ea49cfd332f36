r"""Operator 9, chat formatting: a grammar round trip.

A conversation is rendered turn by turn as ``<|im_start|>role\ntext<|im_end|>\n``. The rendered text is reparsed by
a deterministic parser and the recovered turns are compared with the source; a turn that comes back otherwise is
escaped and the conversation is rendered anew, until both are identical. Escaping puts one more backslash between
the bracket and bar of anything like ``<|``, ``<\|``, ``<\\|``, so an escaped text holds no control string and
unescaping takes one backslash away again. Role names escape "%", line ends and brackets as "%25" and the like.
The parser knows an escaped turn by the mark ``<|im_esc|>`` before its text.

Under the loss mask are the texts of assistant turns, as spans of the formatted text.

Turns of a conversation are sorted by turn (then role and text) inside Spark's sort and read one conversation at a
time; memory follows the longest conversation.

Edge cases: null texts and roles are empty; a null turn comes first; a null conv_id is a conversation of its own;
repeated turns all stay; any text, control strings included, comes back; extra columns are ignored; no rows, none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import small_batches, table, tidy

START, END, ESCAPED = "<|im_start|>", "<|im_end|>", "<|im_esc|>"
_HEAD = re.compile(r"<\|im_start\|>([^\n]*)\n(<\|im_esc\|>)?")
_MARK = re.compile(r"<\|im_(?:start|end|esc)\|>")
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = {"%": "%25", "\n": "%0A", "<": "%3C", "|": "%7C"}

Turns = list[tuple[str, str]]


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return re.sub(r"[%\n<|]", lambda m: _ROLE[m[0]], role)


def _unescape_role(role: str) -> str:
    return re.sub("%(25|0A|3C|7C)", lambda m: chr(int(m[1], 16)), role)


def render(turns: Turns, escaped: set[int]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text, and (turn, start, end) of each assistant text in it."""
    out, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        hard = i in escaped
        head = f"{START}{_escape_role(role) if hard else role}\n{ESCAPED if hard else ''}"
        body = escape(text) if hard else text
        if role == "assistant":
            spans.append((i, at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str, bool, tuple[int, int]]] | None:
    """(role, text, escaped, span of the text) of each turn; None if the text isn't of the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        mark = _MARK.search(formatted, head.end()) if head else None
        if mark is None or mark[0] != END or formatted[mark.end() : mark.end() + 1] != "\n" or _MARK.search(head[1]):
            return None
        body, hard = formatted[head.end() : mark.start()], head[2] is not None
        turns.append((_unescape_role(head[1]) if hard else head[1], unescape(body) if hard else body, hard, (head.end(), mark.start())))
        at = mark.end() + 1
    return turns


def format_turns(turns: Turns) -> tuple[str, list[tuple[int, int]], int]:
    """The formatted conversation, its loss spans and the rounds needed; parse() of it gives back the turns."""
    escaped: set[int] = set()
    for rounds in range(1, len(turns) + 3):
        text, spans = render(turns, escaped)
        got = parse(text)
        if got is not None and [(r, t) for r, t, _, _ in got] == turns:
            return text, [(a, b) for _, a, b in spans], rounds
        marks = (START, END, ESCAPED)
        hard = {i for i, (role, body) in enumerate(turns) if any(x in role or x in body for x in marks) or "\n" in role}
        if hard <= escaped:  # what is left arises between marks and texts
            hard = set(range(len(turns)))
        escaped |= hard
    raise AssertionError("an escaped conversation must come back")


FORMATTED = "conv_id long, formatted string, n_turns long, loss_spans array<struct<start: long, end: long>>, rounds int"


def format_conversations(df: DataFrame) -> DataFrame:
    """One row for each conversation (conv_id, turn, role, text in): FORMATTED."""
    spark = df.sparkSession
    small_batches(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    dealt = turns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def out(conv: int | None, held: Turns) -> None:
            formatted, spans, rounds = format_turns(held)
            rows.append({"conv_id": conv, "formatted": formatted, "n_turns": len(held), "loss_spans": [{"start": a, "end": b} for a, b in spans], "rounds": rounds})

        def batch_of() -> pa.RecordBatch:
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            return pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("loss_spans", pa.list_(span)), ("rounds", pa.int32())]))

        now, held = None, []
        for batch in batches:
            for conv, role, body in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held and conv != now:
                    out(now, held)
                    held = []
                now = conv
                held.append((role, body))
            if rows:
                yield batch_of()
                rows = []
        if held:
            out(now, held)
            yield batch_of()

    return dealt.mapInArrow(tidy(run), FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text says: turns and masked texts come from the parser and the loss spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns, loss = parse(r["formatted"]), []
                at = {span: hard for _, _, hard, span in turns}
                for s in r["loss_spans"]:
                    body = r["formatted"][s["start"] : s["end"]]
                    loss.append(unescape(body) if at[s["start"], s["end"]] else body)
                loss = "".join(loss)
                said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
                rows.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(said.encode()).hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(r["formatted"])})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(more)))


OP9_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
a AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(role) + length(text) + 24)::BIGINT AS plain
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       plain + CASE WHEN conv_id = -1 THEN 24 ELSE 0 END AS formatted_chars
FROM a
"""
