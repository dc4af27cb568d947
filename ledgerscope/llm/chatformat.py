"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, encoded once with offsets, and the
sorted spans of its assistant texts are intersected with the token spans by
binary search. The template is

    <s> then per turn:  [INST]role\\ntext[/INST]   or, for the assistant,  text</s>

Control strings inside a text or role get a backslash after their first
character (and one more if they already hold some), so a text can never
open or close a turn, and unescaping gives back the exact text. Control
strings are single tokens, so no token crosses the border of a turn.

Rows are dealt by conversation and sorted by turn; a task streams through
them and holds one piece of at most ``PIECE_CHARS`` characters (or one longer
turn) at a time. A conversation of any length therefore fits, and as pieces
end at control tokens, their encodings are those of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_CHARS = 1 << 17
BATCH_CHARS = 1 << 21
INSIDE = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|\|endoftext\|>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\]|\|endoftext\|>)")
MARK = re.compile(r"(<s>|</s>|\[INST\]|\[/INST\])")  # the tokenizer's own control string is escaped as well
PIECES = ("conv_id bigint, piece bigint, n_turns bigint, text string, token_ids array<int>, "
          "loss array<boolean>, loss_spans array<struct<start:bigint,stop:bigint>>")


def escape(text: str) -> str:
    return INSIDE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """Rendered turn, and where the text to learn lies in it (empty span if none)."""
    body = escape(text)
    if role == "assistant":
        return body + "</s>", 0, len(body)
    return f"[INST]{escape_role(role)}\n{body}[/INST]", 0, 0


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a rendered piece."""
    turns, open_inst, text = [], False, ""
    for part in MARK.split(rendered):
        if part == "[INST]":
            open_inst = True
        elif part == "[/INST]":
            role, _, body = text.partition("\n")
            turns.append((unescape_role(role), unescape(body)))
            open_inst, text = False, ""
        elif part == "</s>" and not open_inst:
            turns.append(("assistant", unescape(text)))
            text = ""
        elif part != "<s>":
            text = part
    return turns


def load_tokenizer(source: str):
    """A tokenizer whose control strings are single tokens and whose offsets are exact."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors
    t = Tokenizer.from_str(source)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens(list(CONTROLS))
    return t


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for tokens that meet one of the sorted, disjoint spans."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    # the last span that starts before the token ends: it meets the token if it stops after the token's start
    k = np.searchsorted(spans[:, 0], offsets[:, 1], side="left") - 1
    return (k >= 0) & (spans[np.maximum(k, 0), 1] > offsets[:, 0])


def covered(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges under the masked tokens, merged where they touch."""
    out: list[tuple[int, int]] = []
    for s, e in offsets[mask].tolist():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def pieces(rows):
    """Rendered pieces (conv_id, number, turns, text, spans) from rows sorted by conversation and turn."""
    conv, number, turns, parts, spans, at, begun = None, 0, 0, [], [], 0, False
    for c, role, text in rows:
        if not begun or c != conv:
            if begun:
                yield conv, number, turns, "".join(parts), spans
            conv, number, turns, parts, spans, at, begun = c, 0, 0, ["<s>"], [], 3, True
        body, s, e = render_turn(role or "", text or "")
        if turns and at + len(body) > PIECE_CHARS:
            yield conv, number, turns, "".join(parts), spans
            number, turns, parts, spans, at = number + 1, 0, [], [], 0
        if e > s:
            spans.append((at + s, at + e))
        parts.append(body)
        at += len(body)
        turns += 1
    if begun:
        yield conv, number, turns, "".join(parts), spans


def encode_pieces(group, tokenizer) -> pa.RecordBatch:
    cols: dict[str, list] = {k: [] for k in ("conv_id", "piece", "n_turns", "text", "token_ids", "loss", "loss_spans")}
    encoded = tokenizer.encode_batch([g[3] for g in group], add_special_tokens=False)
    for (conv, number, turns, text, spans), e in zip(group, encoded):
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
        mask = token_mask(offsets, np.array(spans, np.int64).reshape(-1, 2))
        for k, v in (("conv_id", conv), ("piece", number), ("n_turns", turns), ("text", text), ("token_ids", e.ids),
                     ("loss", mask.tolist()), ("loss_spans", [{"start": s, "stop": x} for s, x in covered(offsets, mask)])):
            cols[k].append(v)
    kinds = {"conv_id": pa.int64(), "piece": pa.int64(), "n_turns": pa.int64(), "text": pa.string(),
             "token_ids": pa.list_(pa.int32()), "loss": pa.list_(pa.bool_()),
             "loss_spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in cols.items()})


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rendered, encoded and masked conversations, in pieces that end with a turn.

    Columns: conv_id, piece (from 0), n_turns, text, token_ids, loss (per
    token: learn it), loss_spans (characters of ``text`` under the mask). All
    pieces of a conversation stand in one partition, in order. Defined cases:
    null text or role counts as empty; turns are ordered by turn, then role,
    then text, nulls first; rows that repeat are turns of their own; a null
    conv_id is one conversation; other columns are ignored. ``tokenizer`` is
    a file in the ``tokenizers`` JSON format, read on the driver.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = conversations.sparkSession.sparkContext.broadcast(f.read())
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        t = load_tokenizer(source.value)

        def stream():
            for b in batches:
                yield from zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist())

        group, size = [], 0
        for p in pieces(stream()):
            group.append(p)
            size += len(p[3])
            if size >= BATCH_CHARS or len(group) >= 1000:
                yield encode_pieces(group, t)
                group, size = [], 0
        if group:
            yield encode_pieces(group, t)

    return rows.mapInArrow(run, PIECES)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted pieces."""

    def run(batches):
        key, state, out = None, None, []

        def row():
            return {"conv_id": key, "n_turns": state[0], "turns_sha256": state[1].hexdigest(),
                    "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for b in batches:
            for conv, piece, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "text", "loss_spans"))):
                if piece == 0:
                    if state is not None:
                        out.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for s in spans:
                    learnt = unescape(text[s["start"]:s["stop"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state is not None:
            out.append(row())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return formatted.select("conv_id", "piece", "text", "loss_spans").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def format_query(spark, sf_dir: str) -> DataFrame:
    """op4: all conversations and the control-string conversation -1."""
    from ledgerscope.sources.tables import read_table
    table = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)],
                                  "conv_id bigint, turn bigint, role string, text string")
    return digest_conversations(format_conversations(table.unionByName(extra)))


FORMAT_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|\|endoftext\|>)', '\1\\\2\3', 'g') AS body,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'),
                        '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|\|endoftext\|>)', '\1\\\2\3', 'g') AS name
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(3 + sum(CASE WHEN role = 'assistant' THEN length(body) + 4
                         ELSE length(name) + length(body) + 14 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
