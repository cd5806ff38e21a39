"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role mark ": " body "</turn>" "\\n"
    role         := "User" | "Assistant" | "System" | "Tool" | "@" escaped name
    mark         := "" for a plain body, "~" for an escaped one

A turn is rendered plainly and parsed again; if the parser does not give back the same role and text, because the text
holds control strings, its body is escaped and the turn rendered anew, until both are identical. In escaped text a
backslash makes the next character literal, and every backslash, "###" and "</turn>" of the text is written with
backslashes, so no control string is left in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
NAMES = {v: k for k, v in ROLES.items()}
OPEN, CLOSE = "### ", "</turn>"
_HEAD = re.compile(r"### (User|Assistant|System|Tool|@(?:[^\\:~#<\n]|\\(?s:.))*)(~?): ")
_CONTROL = re.compile(r"\\|###|</turn>")
_NAME = re.compile(r"[\\:~#<\n]")


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "".join("\\" + c for c in m[0]) if m[0] == "###" else "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _next_close(s: str, at: int, escaped: bool) -> int:
    if not escaped:
        return s.find(CLOSE, at)
    for m in re.compile(r"\\.|</turn>", re.S).finditer(s, at):
        if m[0] == CLOSE:
            return m.start()
    return -1


def parse_turn(s: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """role, text, start and end of the body in s, and where the next turn starts."""
    head = _HEAD.match(s, at)
    if not head:
        raise GrammarError(f"no turn at {at}")
    end = _next_close(s, head.end(), bool(head[2]))
    if end < 0 or s[end + len(CLOSE) : end + len(CLOSE) + 1] != "\n":
        raise GrammarError(f"turn at {at} is not closed")
    body = s[head.end() : end]
    if not head[2] and OPEN in body:
        raise GrammarError(f"control string in the plain turn at {at}")
    role = NAMES[head[1]] if head[1] in NAMES else unescape(head[1][1:])
    return role, unescape(body) if head[2] else body, head.end(), end, end + len(CLOSE) + 1


def parse(s: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(s):
        role, text, _, _, at = parse_turn(s, at)
        out.append((role, text))
    return out


def render_turn(role: str, text: str) -> str:
    """The first rendering that parses back to the same role and text and nothing else."""
    name = ROLES.get(role) or "@" + _NAME.sub(lambda m: "\\" + m[0], role)
    for mark, body in (("", text), ("~", escape(text))):
        s = f"{OPEN}{name}{mark}: {body}{CLOSE}\n"
        try:
            if parse(s) == [(role, text)]:
                return s
        except GrammarError:
            continue
    raise GrammarError("no rendering parses back")


def format_turns(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end: one row per turn.

    The rows of a conversation, in the order of turn, role and text (nulls first), give its formatted text one after the other.
    [loss_start, loss_end) is the body in code points of the row's own text if the role is trained on, else
    (0, 0). Null role and text are empty. Rows with a null conv_id form one conversation; rows that repeat all four columns are turns of
    their own; an empty table gives an empty result; columns other than the four are left out.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, lo, hi = [], [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                out.append(render_turn(role, text))
                _, _, start, end, _ = parse_turn(out[-1])
                on = role == trained_role
                lo.append(start if on else 0)
                hi.append(end if on else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(out, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, formatted string, loss_start bigint, loss_end bigint"
    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted text alone.

    Each partition holds whole conversations in order and is streamed: the state is two running digests
    and a few counts, however long a conversation is.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, state = None, False, None
        done: list[tuple] = []

        def close() -> None:
            n, turns, chars, loss, size = state
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush(conv_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [()] * 6
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

        conv_type = pa.int64()
        for b in batches:
            conv_type = b.column(0).type
            for conv, s, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not started or conv != now:
                    if started:
                        close()
                    now, started, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(s):
                    role, text, start, end, at = parse_turn(s, at)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if lo <= start < end <= hi:  # the mask covers whole bodies
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(s)
            if len(done) >= 1000:
                yield flush(conv_type)
        if started:
            close()
        if done:
            yield flush(conv_type)

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def chat_report(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return read_back(format_turns(rows.unionByName(extra)))
