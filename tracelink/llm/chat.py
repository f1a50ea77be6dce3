"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut each conversation into segments and these into turn-aligned windows within a token
budget. Every window keeps the conversation's system turn, repeats the last turns before it up to a history budget,
and then has its new turns; the loss mask covers the text of new assistant turns only, so each is a target once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelink.llm.tokens import encoder
from tracelink.storage import materialise

START, END = "<|im_start|>", "<|im_end|>"
#: Windows of one segment; a segment is what one call holds in memory.
SEGMENT_WINDOWS = 64
#: Turns of one range of the prefix sums.
RANGE = 256
WINDOWS = "conv_id long, segment long, window int, first_turn boolean, repeated int, new_turns int, tokens long, over_budget boolean, text string, mask array<struct<start:int,end:int>>"
_ESCAPE = {"\\": "\\\\", "<|": "<\\|"}


def escape(text: str) -> str:
    """No `<|` is left, so nothing in a text can pass for the template's marks."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    """A role ends at the first line feed."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def _format(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where its text starts and ends in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    turns = []
    for part in window.split(START)[1:]:
        role, _, body = part.removesuffix("\n").removesuffix(END).partition("\n")
        turns.append((unescape(role), unescape(body)))
    return turns


def _add_tokens(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name).encode
        for batch in batches:
            pairs = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            counts = [len(encode(_format(role, text)[0])) for role, text in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "tokens"])

    return run


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows that agree in `keys`, of sorted input."""
    from itertools import groupby

    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _fill(budget: int, history: int):
    def window_row(key: tuple, number: int, system: dict | None, past: list[dict], new: list[dict]) -> dict:
        text, mask, tokens = [], [], 0
        at = 0
        repeated = ([system] if system is not None else []) + past
        for k, turn in enumerate(repeated + new):
            part, low, high = _format(turn["role"], turn["text"])
            if k >= len(repeated) and turn["role"] == "assistant" and high > low:
                mask.append({"start": at + low, "end": at + high})
            text.append(part)
            at += len(part)
            tokens += turn["tokens"]
        first = any(t["rank"] == 0 for t in new)
        return {"conv_id": key[0], "segment": key[1], "window": number, "first_turn": first, "repeated": len(repeated), "new_turns": len(new), "tokens": tokens, "over_budget": tokens > budget, "text": "".join(text), "mask": mask}

    def windows(key: tuple, turns: Iterator[dict]) -> Iterator[dict]:
        system, past, new, used, number = None, [], [], 0, 0
        for turn in turns:
            if turn["use"] == 0:  # the system turn, repeated in every window but the one it opens
                system = turn
                continue
            if turn["use"] == 1:
                past.append(turn)
                continue
            if new and used + turn["tokens"] > budget:
                yield window_row(key, number, None if new[0] is system else system, past, new)
                number += 1
                past, room = [], history
                for old in reversed(new):
                    room -= old["tokens"]
                    if room < 0 or old is system:
                        break
                    past.insert(0, old)
                new, used = [], 0
            if not new:
                # history gives way where the next turn needs the room
                fixed = system["tokens"] if system is not None else 0
                while past and fixed + sum(t["tokens"] for t in past) + turn["tokens"] > budget:
                    past.pop(0)
                used = fixed + sum(t["tokens"] for t in past)
            if turn["rank"] == 0 and turn["role"] == "system":
                system = turn
            new.append(turn)
            used += turn["tokens"]
        if new:
            yield window_row(key, number, None if new[0] is system else system, past, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("first_turn", pa.bool_()), ("repeated", pa.int32()), ("new_turns", pa.int32()),
            ("tokens", pa.int64()), ("over_budget", pa.bool_()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ])
        out: list[dict] = []
        for key, turns in _by_group(batches, ["conv_id", "segment"]):
            for row in windows(key, turns):
                out.append(row)
                if len(out) >= 200:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def format_chats(turns: DataFrame, budget: int = 2048, history: int = 256, name: str = "byte_bpe_50k.json") -> DataFrame:
    """Windows of every conversation: WINDOWS columns, a row per window.

    Turns stand by turn, then role, then text (null first); rows alike in all are so many turns. Null text or
    role counts as empty; rows of a null conv_id are one conversation. A turn is never cut: one that alone is over the
    budget has a window of its own, marked over_budget. `repeated` counts the leading turns of a window that
    other windows have as new ones. No rows give no windows; other columns are not read. A conversation of any length is dealt out by
    segments, so that no task needs it whole.
    """
    if history >= budget:
        raise ValueError("history must be smaller than the budget")
    text = F.coalesce("text", F.lit(""))
    plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    counted = materialise(plain.mapInArrow(_add_tokens(name), "conv_id long, turn long, role string, text string, tokens long"), "chat-turns")
    counted = counted.withColumn("_range", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-(2**62))))
    ranges = counted.groupBy("conv_id", "_range").agg(F.sum("tokens").alias("n"), F.count("*").alias("k"))
    line, whole = Window.partitionBy("conv_id").orderBy("_range"), Window.partitionBy("conv_id")
    ranges = ranges.select(
        F.col("conv_id").alias("_conv"), F.col("_range").alias("_r"), (F.sum("n").over(line) - F.col("n")).alias("_tokens"),
        (F.sum("k").over(line) - F.col("k")).alias("_turns"), F.sum("n").over(whole).alias("_total"),
    )
    inner = Window.partitionBy("conv_id", "_range").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumns({"_before": before, "_row": F.row_number().over(inner) - 1})
    placed = placed.join(ranges, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_r")))
    length = SEGMENT_WINDOWS * (budget - history)
    placed = placed.withColumns({"start": F.col("_tokens") + F.col("_before"), "rank": F.col("_turns") + F.col("_row")})
    own = F.floor(F.col("start") / length)
    last = F.floor(F.col("_total") / length)
    # use 0: the system turn in later segments; 1: history that runs over into the next segment; 2: the turn itself
    system = F.when((F.col("rank") == 0) & (F.col("role") == "system") & (last > own), F.transform(F.sequence(own + 1, last), lambda s: F.struct(s.alias("segment"), F.lit(0).alias("use"))))
    lead = F.when((F.col("start") + F.col("tokens") <= (own + 1) * length) & (F.col("start") >= (own + 1) * length - history) & (last > own), F.array(F.struct((own + 1).alias("segment"), F.lit(1).alias("use"))))
    self_ = F.array(F.struct(own.alias("segment"), F.lit(2).alias("use")))
    empty = F.array().cast("array<struct<segment:bigint,use:int>>")
    dealt = placed.select("conv_id", "rank", "role", "text", "tokens", F.explode(F.concat(F.coalesce(system, empty), F.coalesce(lead, empty), self_)).alias("to"))
    dealt = dealt.select("conv_id", "to.segment", "to.use", "rank", "role", "text", "tokens")
    dealt = dealt.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "use", "rank")
    return dealt.mapInArrow(_fill(budget, history), WINDOWS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for (conv,), windows in _by_group(batches, ["conv_id"]):
        turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for row in windows:
            chars += len(row["text"])
            for role, text in parse(row["text"])[row["repeated"] :]:
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in row["mask"]:
                target = unescape(row["text"][span["start"] : span["end"]])
                loss_chars += len(target)
                loss.update(target.encode("utf-8", "surrogatepass"))
        out.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars})
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    yield pa.RecordBatch.from_pylist(out, schema)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from its formatted windows alone: turn count and digests of turns and of masked text.

    The windows of a conversation stream through one task in order, since a digest has to; it holds one at a time.
    """
    ordered = windows.select("conv_id", "segment", "window", "repeated", "text", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
