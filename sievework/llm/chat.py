"""Chat formatting by rendering growing prefixes of a conversation through a black-box template.

A template is any function from a list of (role, text) turns to a string. Nothing is known of its
marks: prefixes of 1, 2, ... turns are rendered, and where output k begins with output k - 1, the
rest is turn k's span. Where it does not, the template rewrites history: the span is then what lies
between the common head and tail of the two, and the conversation is flagged. Where a turn's text
begins and ends in its span is told by the same conversation with short probes for texts, rendered in
prefixes too: what surrounds the probe is looked for around the text. Where that is not found, the
template looks at texts, and the turn is rendered once more with a probe in its text's place alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Strings that steer chat models and may not appear as such inside a text.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
    "<<SYS>>", "<</SYS>>", "<|user|>", "<|assistant|>", "<|system|>",
)
START, STOP, BREAK, ESCAPE = "<|im_start|>", "<|im_end|>", "\n", "\\"
_RISKY = re.compile(re.escape(ESCAPE) + "|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.S)
#: A private-use character; a text that holds it gets a longer probe.
PROBE = "\uf8ff"

Template = Callable[[list[tuple[str, str]]], str]


def escape(text: str) -> str:
    """Puts a backslash before each backslash and each control string."""
    if "<" not in text and "[" not in text and ESCAPE not in text:  # how each of them begins
        return text
    return _RISKY.sub(lambda found: ESCAPE + found[0], text)


def unescape(text: str) -> str:
    return text if ESCAPE not in text else _ESCAPED.sub(r"\1", text)


#: Characters of rendered turns that marked() keeps, so that a prefix is not escaped anew each time.
KEPT_CHARACTERS = 4_000_000
_kept: dict[tuple[str, str], str] = {}
_kept_size = 0


def _turn(role: str, text: str) -> str:
    """A role's line breaks are escaped too, so that the first bare one ends it."""
    global _kept_size
    found = _kept.get((role, text))
    if found is None:
        found = f"{START}{escape(role).replace(BREAK, ESCAPE + BREAK)}{BREAK}{escape(text)}{STOP}{BREAK}"
        if _kept_size + len(found) > KEPT_CHARACTERS:
            _kept.clear()
            _kept_size = 0
        _kept[role, text] = found
        _kept_size += len(found)
    return found


def marked(turns: Iterable[tuple[str, str]]) -> str:
    """The template of the query: each turn between marks, its role on the first line."""
    return "".join([_turn(role, text) for role, text in turns])


def _common(a: str, b: str) -> int:
    """How many signs at the start of two texts agree, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _grown(outputs: Iterable[str]) -> Iterable[tuple[str, int, int, bool]]:
    """Of outputs of growing prefixes: each output, start and end of what it adds, and whether it
    rewrote the one before."""
    before = ""
    for after in outputs:
        start, end = len(before), len(after)
        rewrote = not after.startswith(before)
        if rewrote:
            start = _common(before, after)
            end -= _common(before[start:][::-1], after[start:][::-1])
        yield after, start, end, rewrote
        before = after


def spans(turns: list[tuple[str, str]], template: Template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The formatted conversation; for each turn the span's start and end and the text's start and
    end in it; whether the template rewrote an earlier output.

    The positions are those of the turn in the output that first holds it; without rewriting they
    hold for the last output as well.
    """
    probe = PROBE
    whole = template(turns)
    while probe in whole or any(probe in role or probe in text for role, text in turns):
        probe += PROBE
    probed = [(role, probe) for role, _ in turns]
    real = _grown(template(turns[: k + 1]) for k in range(len(turns)))
    short = _grown(template(probed[: k + 1]) for k in range(len(turns)))
    found, rewrote, formatted = [], False, ""
    for k, ((after, start, end, odd), (small, low, high, odd_too)) in enumerate(zip(real, short, strict=True)):
        rewrote, formatted = rewrote or odd, after
        at = small.find(probe, low, high)
        head, tail = small[low:at], small[at + len(probe) : high]
        text_start, text_end = start + len(head), end - len(tail)
        plain = not odd and not odd_too and at >= 0 and text_start <= text_end
        if not (plain and after.startswith(head, start) and after.startswith(tail, text_end)):
            text_start, text_end = _alone(turns, k, after, end, probe, template)
        found.append((start, end, text_start, text_end))
    return formatted, found, rewrote


def _alone(turns, k: int, after: str, end: int, probe: str, template: Template) -> tuple[int, int]:
    """Start and end of turn k's text, from rendering it once more with a probe in its place, of the
    text's own length where that is longer than the probe."""
    probe += probe[0] * (len(turns[k][1]) - len(probe))
    probed = template([*turns[:k], (turns[k][0], probe)])
    low = probed.find(probe)
    if low < 0:  # the template leaves this text out
        return end, end
    return low, low + len(after) - len(probed) + len(probe)


def _bare(text: str, mark: str, at: int) -> int:
    """Where the mark next stands without a backslash of its own before it."""
    while True:
        found = text.find(mark, at)
        if found < 0:
            raise ValueError(f"no {mark!r} after {at}")
        escapes = found
        while escapes > at and text[escapes - 1] == ESCAPE:
            escapes -= 1
        if (found - escapes) % 2 == 0:
            return found
        at = found + 1


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a text made by marked()."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        role = _bare(formatted, BREAK, at + len(START))
        text = _bare(formatted, STOP + BREAK, role + len(BREAK))
        turns.append((unescape(formatted[at + len(START) : role]), unescape(formatted[role + len(BREAK) : text])))
        at = text + len(STOP + BREAK)
    return turns


SCHEMA = (
    "conv_id long, formatted string, spans array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>,"
    " n_turns long, rewrites_history boolean"
)


def format_chats(
    rows: DataFrame,
    template: Template = marked,
    trained: tuple[str, ...] = ("assistant",),
    id_col: str = "conv_id",
) -> DataFrame:
    """One row per conversation: id, formatted, spans, n_turns, rewrites_history.

    rows hold id_col, turn, role and text. Turns go by number, null first, ties by role and text; a
    repeated row is a turn of its own. Null roles and texts are empty. Rows with a null id form one
    conversation. spans carry, for each turn, role, start, end, text_start, text_end and loss (true
    for the trained roles' texts). An empty table gives no rows; other columns are not read. A
    conversation is one output row and is rendered as a whole.
    """

    def run(batches):
        for batch in batches:
            made = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs = [(x["role"], x["text"]) for x in turns]
                formatted, found, rewrote = spans(pairs, template)
                names = ("start", "end", "text_start", "text_end")
                marks = [
                    dict(zip(names, at, strict=True)) | {"role": role, "loss": role in trained}
                    for (role, _), at in zip(pairs, found, strict=True)
                ]
                made.append((conv, formatted, marks, len(pairs), rewrote))
            if made:
                yield pa.record_batch(
                    [pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), _KINDS, strict=True)],
                    names=["conv_id", "formatted", "spans", "n_turns", "rewrites_history"],
                )

    turn = F.struct(F.col("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    chats = rows.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
    chats = chats.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return chats.mapInArrow(run, SCHEMA).withColumnRenamed("conv_id", id_col)


_SPAN = pa.struct(
    [("role", pa.string())]
    + [(x, pa.int32()) for x in ("start", "end", "text_start", "text_end")]
    + [("loss", pa.bool_())]
)
_KINDS = (pa.int64(), pa.string(), pa.list_(_SPAN), pa.int64(), pa.bool_())


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, and the operator's rewrites_history."""

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                turns = read_back(row["formatted"])
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(
                    unescape(row["formatted"][x["text_start"] : x["text_end"]]) for x in row["spans"] if x["loss"]
                )
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
                made.append((row["conv_id"], len(turns), sha[0], len(loss), sha[1], len(row["formatted"]), row["rewrites_history"]))
            if made:
                yield pa.record_batch([pa.array(x) for x in zip(*made, strict=True)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    return chats.mapInArrow(run, schema)
