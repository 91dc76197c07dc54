"""Chat formatting through a black-box template, rendered turn by turn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import pick, shuffle_partitions

Message = tuple[str, str]
Template = Callable[[list[Message]], str]
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"([^\n]*)\n((?s:.*?))" + re.escape(END) + r"\n")
UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Breaks every control string with backslashes, reversibly."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def chatml(messages: list[Message]) -> str:
    """The default template. A line break in a role is written as backslash n."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in messages)


class Incremental:
    """Renders successive prefixes of a conversation and finds each turn's span by comparing consecutive outputs.

    Prefixes are whole. With ``window``, which is only for a template that adds to a turn the same whatever came more than
    ``window`` turns before it (as ``chatml`` does), later ones hold the last ``window`` turns, unless a comparison at
    the first such point contradicts that.
    """

    def __init__(self, template: Template, window: int | None = None):
        self.template, self.window, self.frames = template, window, {}
        self.reset()

    def reset(self) -> None:
        self.past: list[Message] = []
        self.before = self.template([])
        self.opening = self.before
        self.rewrites, self.slides, self.count = False, None, 0

    def _frame(self, role: str) -> tuple[int, int]:
        """Lengths of what the template puts before and after the content, from two probes that differ at once."""
        a, b = (self.template([*self.past, (role, x)])[len(self.before) :] for x in ("a", "b"))
        n = min(len(a), len(b))
        head = next((i for i in range(n) if a[i] != b[i]), n)
        tail = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
        return head, tail

    def add(self, role: str, text: str) -> tuple[str, int, int] | None:
        """What this turn adds to the output, and where its content lies in that; None if the template rewrote history."""
        after = self.template([*self.past, (role, text)])
        self.count += 1
        if not after.startswith(self.before):
            self.rewrites = True
            self.past.append((role, text))
            self.before = after
            return None
        added = after[len(self.before) :]
        key = (self.past[-1][0] if self.past else None, len(self.past) == 0, role)
        for fresh in (False, True):
            if fresh or key not in self.frames:
                head, tail = self._frame(role)
                self.frames[key] = (head, tail, added[:head], added[len(added) - tail :])
            head, tail, first, last = self.frames[key]
            if added.startswith(first) and added.endswith(last) and len(added) >= head + tail:
                break
        self.past.append((role, text))
        self.before = after
        if self.window is not None and len(self.past) > self.window and self.slides is not False:
            short = self.past[-self.window :]
            less = self.template(short[:-1])
            if self.slides is None:
                full = self.template(short)
                self.slides = full.startswith(less) and full[len(less) :] == added
            if self.slides:
                self.past = short
                self.before = self.template(short)
        return added, head, len(added) - tail


OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("formatted_sha256", pa.string()), ("rewrites_history", pa.bool_())])
SPANS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("added", pa.string()), ("content_start", pa.int32()), ("content_end", pa.int32()), ("loss", pa.bool_())])


def _in_order(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation in one partition, in order; nulls become empty strings, ties go by role and text."""
    c = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    c = c.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.repartition(shuffle_partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def render_turns(conversations: DataFrame, template: Template = chatml, *, loss_roles: tuple[str, ...] = ("assistant",), window: int | None = None) -> DataFrame:
    """Each turn's addition to the formatted text, the content's place in it and whether it is under the loss mask.

    Turns stream through a task in order. Each prefix is rendered whole, so time grows with the square of a conversation's
    length, unless ``window`` declares that the template needs no more than so many last turns (see ``Incremental``);
    then memory doesn't depend on the length either. A turn at which the template rewrote history has null ``added``. An
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = Incremental(template, window), object()
        for batch in batches:
            rows: list[tuple] = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if conv != current:
                    state.reset()
                    current = conv
                first = state.opening if not state.count else ""
                got = state.add(role, text)
                rows.append((conv, turn, role, None, None, None, False) if got is None else (conv, turn, role, first + got[0], len(first) + got[1], len(first) + got[2], role in loss_roles))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SPANS, strict=True)] if rows else [pa.array([], f.type) for f in SPANS], schema=SPANS)

    return _in_order(conversations).mapInArrow(run, "conv_id long, turn long, role string, added string, content_start int, content_end int, loss boolean")


def format_digests(conversations: DataFrame, template: Template = chatml, *, loss_roles: tuple[str, ...] = ("assistant",), window: int | None = None) -> DataFrame:
    """A row for each conversation, with digests read back from the formatted output.

    Roles and texts are parsed out of what each turn added and unescaped; the loss mask is the content span of the
    turns of ``loss_roles``. A null text or role is empty; a null conv_id is a conversation of its own. Where a
    template rewrites history, ``rewrites_history`` is true and the digests cover the turns that could be located.
    ``window`` is as for ``render_turns``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, started = Incremental(template, window), None, False
        done: list[tuple] = []

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "out": hashlib.sha256(state.opening.encode()), "len": len(state.opening)}

        def close(acc):
            done.append((current, acc["n"], acc["turns"].hexdigest(), acc["chars"], acc["loss"].hexdigest(), acc["len"], acc["out"].hexdigest(), state.rewrites))

        acc = fresh()
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not started or conv != current:
                    if started:
                        close(acc)
                    state.reset()
                    acc, current, started = fresh(), conv, True
                got = state.add(role, text)
                acc["n"] += 1
                if got is None:
                    continue
                added, a, b = got
                acc["len"] += len(added)
                acc["out"].update(added.encode())
                read = TURN.fullmatch(added)
                back_role, back_text = (unescape(read[1]), unescape_text(read[2])) if read else (role, unescape_text(added[a:b]))
                acc["turns"].update(f"{back_role}\n{back_text}\n".encode())
                if back_role in loss_roles:
                    masked = unescape_text(added[a:b])
                    acc["loss"].update(masked.encode())
                    acc["chars"] += len(masked)
            if len(done) >= 1000:
                yield _rows(done)
                done.clear()
        if started:
            close(acc)
        if done:
            yield _rows(done)

    return _in_order(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted_sha256 string, rewrites_history boolean")


def unescape_text(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[1], text)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), OUT, strict=True)], schema=OUT)
