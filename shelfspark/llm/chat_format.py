"""Chat formatting in budgeted windows.

A conversation's turns are written as `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. Prefix
sums of the tokens of the written turns choose the windows: each takes the system turn, up to `history` tokens of turns
that earlier windows held, and then as many new turns as the budget has room for (one at least). History goes, oldest
first, and then the system turn, where else the first new turn would not fit; so only a turn that alone exceeds the budget
exceeds it. Every assistant turn is a target in the one window that first holds it; there its text is under the loss mask,
and where it comes back as history it is masked out.

Control strings inside texts and roles are escaped reversibly: `<`, any number of backslashes and `|` get one
backslash more, so that no `<|` is left; in roles, backslash and line feed are escaped as well.

Rows are dealt by conversation and sorted by turn, and a task reads them as a stream: it holds one window at a
time, not a whole conversation. As each window follows from the one before, one conversation is one task's work, however
long it is: that is a limit in time, not in memory.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm._common import partitions, prepare, table

START, END = "<|im_start|>", "<|im_end|>"
_OUT, _BACK = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_encoders: dict = {}


def escape(text: str) -> str:
    return _OUT.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def worker_encoder(path: str):
    """This process's token counter."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        _encoders[path] = lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return _encoders[path]


class Windows:
    """Builds the windows of one conversation from its turns, in order."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system = None  # (rendered, tokens) of a leading system turn
        self.past: list[tuple] = []  # turns kept as history
        self.turns: list[tuple] = []  # new turns of the open window: (rendered, tokens, head, text length, target)
        self.prefix = [0]  # sums of their tokens
        self.number, self.with_system = 0, True

    def add(self, index: int, role: str, rendered: str, head: int, tokens: int):
        """Takes a written turn (its first `head` characters come before the text); returns a finished window if the turn does not
        fit into the open one."""
        turn = (rendered, tokens, head, len(rendered) - head - len(END) - 1, role == "assistant")
        out = None
        if self.turns and self.carried() + self.prefix[-1] + tokens > self.budget:
            out = self.close()
        if not self.turns:
            while self.past and self.carried() + tokens > self.budget:
                self.past.pop(0)
            self.with_system = self.carried() + tokens <= self.budget
        self.turns.append(turn)
        self.prefix.append(self.prefix[-1] + tokens)
        if index == 0 and role == "system":
            self.system = turn
        return out

    def repeated(self) -> list[tuple]:
        return [*([self.system] if self.system and self.number and self.with_system else []), *self.past]

    def carried(self) -> int:
        return sum(t[1] for t in self.repeated())

    def close(self):
        """(number, text, repeated turns, loss spans) of the open window."""
        old = self.repeated()
        text, spans, at = [], [], 0
        for i, (rendered, _, head, size, target) in enumerate([*old, *self.turns]):
            if target and i >= len(old):
                spans.append((at + head, at + head + size))
            text.append(rendered)
            at += len(rendered)
        out = self.number, "".join(text), len(old), spans
        # history of the next window: the longest run of last turns whose tokens fit
        new = self.turns[1:] if self.system is self.turns[0] else self.turns
        pool, room = [*self.past, *new], min(self.history, self.budget // 2)
        sums = np.cumsum([t[1] for t in pool[::-1]])
        keep = int(np.searchsorted(sums, room, "right"))
        self.past = pool[len(pool) - keep :]
        self.turns, self.prefix, self.number, self.with_system = [], [0], self.number + 1, True
        return out


def format_chats(turns: DataFrame, tokenizer_path: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, window, text, n_repeated, loss (array of start, end in code points).

    Null texts and roles are empty; turns that tie are ordered by role and text and all kept; rows with a null
    conv_id are one conversation. A turn over the budget has a window of its own. Other columns are left out.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        count = worker_encoder(tokenizer_path)
        conv, windows, index = (), None, 0

        def batch(out):
            cols = list(zip(*out, strict=True))
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for s in cols[4]], loss)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), spans], ["conv_id", "window", "text", "n_repeated", "loss"])

        for b in batches:
            ids, _, roles, texts = (b.column(i).to_pylist() for i in range(4))
            out = []
            heads = [f"{START}{escape_role(r)}\n" for r in roles]
            written = [f"{h}{escape(t)}{END}\n" for h, t in zip(heads, texts, strict=True)]
            for c, role, text, head, n in zip(ids, roles, written, heads, count(written), strict=True):
                if (c,) != conv:
                    if windows:
                        out.append((*conv, *windows.close()))
                    conv, windows, index = (c,), Windows(budget, history), 0
                if done := windows.add(index, role, text, len(head), n):
                    out.append((c, *done))
                index += 1
            if out:
                yield batch(out)
        if windows:
            yield batch([(*conv, *windows.close())])

    return dealt.mapInArrow(run, "conv_id long, window int, text string, n_repeated int, loss array<struct<start:long,end:long>>")


def parse(text: str) -> list[tuple[str, str, int]]:
    """(role, text, place of the text) of the turns in a formatted window."""
    out, at = [], 0
    while at < len(text):
        head = text.index("\n", at)
        end = text.index(END, head)
        out.append((unescape_role(text[at + len(START) : head]), unescape(text[head + 1 : end]), head + 1))
        at = end + len(END) + 1
    return out


def digest(formatted: DataFrame) -> DataFrame:
    """What the windows say, read back: one row per conversation. The windows come as format_chats deals them."""

    def run(batches):
        conv, state = (), None

        def batch(out):
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])

        def finished():
            n, turns, chars, loss, size, windows = state
            return (*conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, windows)

        for b in batches:
            out = []
            for c, text, repeated, spans in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if (c,) != conv:
                    if state:
                        out.append(finished())
                    conv, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body, _ in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    body = unescape(text[s["start"] : s["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
            if out:
                yield batch(out)
        if state:
            yield batch([finished()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations and one of control strings -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    import public_tokenizers

    prepare(spark)
    odd = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return digest(format_chats(turns.union(more), public_tokenizers.path("byte_bpe_50k.json")))
