"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole by a template whose marks are special tokens of the encoder, and encoded once with
character offsets. The spans of the assistant's texts and the spans of the tokens are both sorted, so two binary
searches for each turn give the tokens under the loss mask. Turns of any length and number stream through one task per
conversation; conversations are dealt over tasks by their id.

Template: ``[INST]`` text ``[/INST]`` for a user, text ``</s>`` for an assistant, ``[SYS]`` text ``[/SYS]`` for the
system, and ``[ROLE]`` role ``[/ROLE]`` text ``[/TURN]`` for any other role; ``<s>`` begins a conversation. No space is
added anywhere. A control string inside a text or role gets one more backslash after its first character than it has
there already (``[INST]`` becomes ``[\\INST]``), which is undone by removing one; so no text can make a mark.

Defined results: null text is empty; a null role is written as ``[NOROLE]`` and read back as empty; rows with a null
conversation id form one conversation; rows of equal turn number keep the order of role, then text; repeated rows are
turns of their own; empty tables give no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path
from .common import released, table

#: The template's control strings.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]", "[NOROLE]", "<|endoftext|>")
_TAILS = "|".join(re.escape(m[1:]) for m in MARKS)
_INSIDE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
_MARK = re.compile("|".join(map(re.escape, MARKS)))


def escape(text: str) -> str:
    return _INSIDE.sub(r"\1\2\\", text) if "[" in text or "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "\\" in text else text


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts, in characters."""
    parts, spans, at = ["<s>"], [], 3

    def add(part: str) -> None:
        nonlocal at
        parts.append(part)
        at += len(part)

    for role, text in turns:
        body = escape(text or "")
        if role == "assistant":
            spans.append((at, at + len(body)))
            add(body)
            add("</s>")
        elif role in ("user", "system"):
            tag = "INST" if role == "user" else "SYS"
            add(f"[{tag}]")
            add(body)
            add(f"[/{tag}]")
        else:
            add("[ROLE]")
            add("[NOROLE]" if role is None else escape(role))
            add("[/ROLE]")
            add(body)
            add("[/TURN]")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    turns, at, role, other = [], 3, "assistant", ""
    for m in _MARK.finditer(formatted, 3):
        body, mark = formatted[at : m.start()], m[0]
        if mark in ("[INST]", "[SYS]", "[ROLE]"):
            pass
        elif mark == "[NOROLE]":
            pass
        elif mark == "[/ROLE]":
            other = unescape(body)
        else:
            role = {"</s>": "assistant", "[/INST]": "user", "[/SYS]": "system"}.get(mark, other)
            turns.append((role, unescape(body)))
        at = m.end()
    return turns


@lru_cache(maxsize=2)
def encoder(path: str):
    from tokenizers import AddedToken, Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    lib.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
    return lib


def masked_tokens(spans: list[tuple[int, int]], starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """For each text span, the range of tokens whose characters lie in it. starts, ends: sorted token spans."""
    out = []
    for lo, hi in spans:
        a = bisect.bisect_left(starts, lo)
        out.append((a, max(a, bisect.bisect_right(ends, hi))) if hi > lo else (a, a))
    return out


def format_conversations(df: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, formatted, ids, mask (runs of token positions), mask_chars (their character spans)."""
    path = path or default_path()
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def conversations(batches) -> Iterator[tuple[int | None, list]]:
        key, turns = None, []
        for b in batches:
            for c, _, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if turns and c != key:
                    yield key, turns
                    turns = []
                key = c
                turns.append((role, text))
        if turns:
            yield key, turns

    @released
    def run(batches):
        lib, group, size = encoder(path), [], 0

        def encoded():
            made = [(c, *render(turns)) for c, turns in group]
            out = []
            for (c, text, spans), e in zip(made, lib.encode_batch([x[1] for x in made], add_special_tokens=False)):
                starts, ends = [a for a, _ in e.offsets], [b for _, b in e.offsets]
                runs = masked_tokens(spans, starts, ends)
                chars = [[starts[a], ends[b - 1]] if b > a else [lo, lo] for (a, b), (lo, _) in zip(runs, spans)]
                out.append({"conv_id": c, "formatted": text, "ids": e.ids, "mask": [list(r) for r in runs], "mask_chars": chars})
            return pa.RecordBatch.from_pylist(out, schema=shape)

        for c, turns in conversations(batches):
            group.append((c, turns))
            size += sum(len(t or "") for _, t in turns)
            if size > 1 << 20:
                yield encoded()
                group, size = [], 0
        if group:
            yield encoded()

    pairs = pa.list_(pa.list_(pa.int32()))
    shape = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pairs), ("mask_chars", pairs)])
    return rows.mapInArrow(run, "conv_id long, formatted string, ids array<int>, mask array<array<int>>, mask_chars array<array<int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted text and mask."""

    @released
    def digest(batches):
        for b in batches:
            out = []
            for c, text, chars in zip(*(b.column(k).to_pylist() for k in (0, 1, 2))):
                turns = parse(text)
                h = hashlib.sha256()
                for role, body in turns:
                    h.update(f"{role}\n{body}\n".encode())
                loss = "".join(unescape(text[lo:hi]) for lo, hi in chars)
                out.append({"conv_id": c, "n_turns": len(turns), "turns_sha256": h.hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.select("conv_id", "formatted", "mask_chars").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe)))
