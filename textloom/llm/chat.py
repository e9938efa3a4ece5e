"""Chat formatting from event logs.

Events carry a conversation, the turn they belong to, a sequence number, a kind, a role and a text. They are dealt
out by conversation and sorted by turn and sequence, so that the events of a message stand together and fold in a
stream: `message` and `regenerate` begin the turn's text anew, `edit` replaces it, `delta` appends to it, `remove`
takes the turn away until a later event brings it back. Two messages of one turn and sequence are two turns of the output.

A turn is rendered as

    ### role: text</turn>\\n

with a backslash before every backslash, # and < of role and text, and before a colon of the role, so that no text
can hold a mark and reading gives back what was written. The loss mask lists (start, length) in code points of the
assistant turns' texts. A conversation is given in parts of whole turns of about PART code points, in order; reader
and writer are streams, so a conversation of any size needs the memory of one part.

A null role or text is empty. Null conversation ids are a conversation of their own; null turns and sequences come
first. Events that agree in all of that are ordered by role and text, and rows that repeat are kept as turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

PART = 1 << 20
LOSS_ROLE = "assistant"
_TEXT, _ROLE, _BACK = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _TEXT.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its escaped text starts and how long it is."""
    head, body = f"### {_ROLE.sub(r'\\\g<0>', role)}: ", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, role, text) of every final turn, from sorted (conv_id, turn, seq, kind, role, text)."""
    key, last_seq, role, pieces = None, None, "", None
    for conv, turn, seq, kind, new_role, text in events:
        again = kind in ("message", None) and pieces is not None and seq == last_seq
        if key != (conv, turn) or again:
            if pieces is not None:
                yield key[0], role, "".join(pieces)
            key, role, pieces = (conv, turn), "", None
        if kind == "delta":
            pieces = (pieces or []) + [text or ""] if pieces is None or len(pieces) < 64 else ["".join(pieces), text or ""]
        elif kind == "remove":
            pieces = None
        elif kind in ("message", "regenerate", "edit", None):
            pieces = [text or ""]
        else:
            raise ValueError(f"unknown kind of event: {kind}")
        role = new_role if new_role is not None else role
        last_seq = seq
    if pieces is not None:
        yield key[0], role, "".join(pieces)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in batch.slice(first, 1000).columns), strict=True)


def format_conversations(events: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, formatted, loss (an array of start and length within the part) from events
    (conv_id, turn, seq, kind, role, text); the parts of a conversation stand together, in order."""
    schema = "conv_id bigint, part int, formatted string, loss array<struct<start:bigint,length:bigint>>"
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting = 0

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], loss_type)], names=["conv_id", "part", "formatted", "loss"])

        conv, number, pieces, loss, size, any_yet = None, 0, [], [], 0, False
        for new, role, text in fold(_rows(batches)):
            if any_yet and (new != conv or size >= part):
                out.append((conv, number, "".join(pieces), loss))
                waiting += size
                number = number + 1 if new == conv else 0
                pieces, loss, size = [], [], 0
                if waiting >= part or len(out) >= 1000:
                    yield batch_of(out)
                    out, waiting = [], 0
            conv, any_yet = new, True
            turn, start, length = render(role, text)
            if role == LOSS_ROLE:
                loss.append({"start": size + start, "length": length})
            pieces.append(turn)
            size += len(turn)
        if any_yet:
            out.append((conv, number, "".join(pieces), loss))
        yield batch_of(out)

    dealt = events.select("conv_id", "turn", "seq", "kind", "role", "text").repartition(shuffle_partitions(events.sparkSession), "conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Read conversations back from `format_conversations`, as it leaves them: one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = None

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def closed(s):
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for conv, number, text, loss in _rows(batches):
            if number == 0:
                if state:
                    out.append(closed(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                said = unescape(text[span["start"] : span["start"] + span["length"]])
                state[3] += len(said)
                state[4].update(said.encode("utf-8", "surrogatepass"))
            state[5] += len(text)
        if state:
            out.append(closed(state))
        yield batch_of(out)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """One `message` event a row of (conv_id, turn, role, text)."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("bigint").alias("seq"), F.lit("message").alias("kind"), "role", "text")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
