"""Chat formatting by a grammar round trip.

A conversation is rendered turn by turn, reparsed by a deterministic parser and compared to its source; texts whose
turn does not come back the same are escaped and the conversation is rendered again, until it is identical.

Grammar: user `[INST]text[/INST]`, assistant `<s>text</s>`, system `<<SYS>>text<</SYS>>`, any other role
`<|role|>role<|text|>text<|end|>`. An escape puts one more backslash after the first character of every control
string that a text holds, bare or already with backslashes (`</s>` -> `<\\/s>`, `<\\/s>` -> `<\\\\/s>`), and the
parser takes one away, so that escaping is undone exactly.

Defined cases: a null text or role is empty; turns are in the order of turn (nulls first), role, text, so that ties
and repeated rows give one result; rows without conv_id belong to no conversation, and each is one by itself; an
empty table gives no rows; other columns, whatever their names, are ignored. A conversation is one output value, so its
turns, very long texts among them, are gathered in one row; no other group is.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What opens and closes a turn of each role.
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
CONTROL = re.compile(r"\[\\*/?INST\]|<\\*/?s>|<\\*</?SYS>>|<\\*\|(?:role|text|end)\|>")
_BARE = re.compile(r"\[/?INST\]|</?s>|<</?SYS>>|<\|(?:role|text|end)\|>")
_ESCAPED = re.compile(r"\[\\(?=\\*/?INST\])|<\\(?=\\*(?:/?s>|</?SYS>>|\|(?:role|text|end)\|>))")

SCHEMA = "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of turns that are escaped where needed, and where the assistant's texts are in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        opening, closing = TURNS.get(role) or (f"{ROLE}{role}{TEXT}", END)
        begin = at + len(opening)
        if role == "assistant":
            spans.append((begin, begin + len(text)))
        out += (opening, text, closing)
        at = begin + len(text) + len(closing)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; ValueError where it is not in the grammar."""
    roles = {opening: (role, closing) for role, (opening, closing) in TURNS.items()}
    turns, at = [], 0
    while at < len(formatted):
        opening = _BARE.match(formatted, at)
        if not opening:
            raise ValueError(f"no turn begins at {at}")
        closing = _BARE.search(formatted, opening.end())
        if opening[0] == ROLE:
            if not closing or closing[0] != TEXT:
                raise ValueError(f"a role does not end after {at}")
            role, end, begin = unescape(formatted[opening.end() : closing.start()]), END, closing.end()
            closing = _BARE.search(formatted, begin)
        elif opening[0] in roles:
            (role, end), begin = roles[opening[0]], opening.end()
        else:
            raise ValueError(f"no turn begins at {at}")
        if not closing or closing[0] != end:
            raise ValueError(f"a turn does not end after {at}")
        turns.append((role, unescape(formatted[begin : closing.start()])))
        at = closing.end()
    return turns


def _comes_back(role: str, text: str, source: tuple[str, str]) -> bool:
    try:
        return parse(render([(role, text)])[0]) == [source]
    except ValueError:
        return False


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Renders, reparses and compares; escapes what conflicts until the turns come back identical."""
    now = list(turns)
    while True:
        formatted, spans = render(now)
        try:
            if parse(formatted) == turns:
                return formatted, spans
        except ValueError:
            pass
        again = list(now)
        for i, (role, text) in enumerate(now):
            if not _comes_back(role, text, turns[i]):
                source_role, source_text = turns[i]
                known = source_role in TURNS
                again[i] = (source_role if known else escape(source_role), escape(source_text))
        if again == now:
            raise ValueError("escaping does not make the conversation come back")
        now = again


def _format(batches):
    for batch in batches:
        columns = {k: [] for k in ("conv_id", "n_turns", "formatted", "loss_starts", "loss_ends")}
        for row in batch.to_pylist():
            turns = [(t["role"] or "", t["text"] or "") for t in row["turns"]]
            formatted, spans = format_turns(turns)
            for k, v in zip(columns, (row["conv_id"], len(turns), formatted, [a for a, _ in spans], [b for _, b in spans])):
                columns[k].append(v)
        yield pa.RecordBatch.from_pydict(columns, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))]))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, and the spans (code points) under the loss mask."""
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), alone.alias("alone"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("turn"))
    whole = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select("conv_id", "turns").mapInArrow(_format, SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text = r["formatted"]
            turns = parse(text)
            loss = "".join(unescape(text[a:b]) for a, b in zip(r["loss_starts"], r["loss_ends"]))
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append((r["conv_id"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted text itself holds: its turns and the text under the loss mask, read back by the parser."""
    return formatted.mapInArrow(_digest, DIGEST)
