"""Chat formatting with any template, by rendering growing prefixes of a conversation.

A template is a function from a list of (role, text) to a string; nothing else is known of it.
After every turn the prefix is rendered and compared with the output before: the common part
stays, what follows belongs to the turn. Where the common part is shorter than the output
before, the template has rewritten history, and the row says so. A second rendering with a
probe character as the turn's text shows which part of the span is the text itself; the loss
mask is that part of assistant turns.

Conversations are sorted by turn (then role and text, for rows that share a turn) and stream
through a task. Whole prefixes are rendered: work grows with the square of the number of turns,
and a conversation is held in memory. ``context`` is for templates that look at no more than so
many earlier turns: only these are then rendered and held.

Null roles and texts are empty, null turns come first, rows without conv_id are one
conversation. Repeated rows are repeated turns. Other columns are not read.
"""

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Render = Callable[[list[tuple[str, str]]], str]
PROBE = "\ue000"
_FLUSH_CHARS = 1 << 20

_CONTROL = r"/?(?:s>|INST\]|ROLE\])"
_PLAIN = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]"
                   r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>"
                   r"|(?P<assistant>.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    """A backslash more after the first character of every control string."""
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def inst_template(messages: list[tuple[str, str]]) -> str:
    """``<s>`` once, then ``[INST] user [/INST]`` and ``assistant</s>``; other roles are named.

    Control strings inside texts and roles are escaped, so the output can be read back.
    """
    out = ["<s>"]
    for role, text in messages:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f"{escape(text)}</s>")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE]{escape(text)}</s>")
    return "".join(out)


def read_turns(text: str, first: bool) -> tuple[list[tuple[str, str]], str]:
    """The complete turns at the start of an ``inst_template`` output, and what is left."""
    at, out = len("<s>") if first else 0, []
    while found := _TURN.match(text, at):
        kind = found.lastgroup
        role = unescape(found["role"]) if kind == "other" else kind
        out.append((role, unescape(found[kind])))
        at = found.end()
    return out, text[at:]


def _common(a: str, b: str) -> int:
    return len(a) if b.startswith(a) else len(commonprefix([a, b]))


def locate(render: Render, earlier: list[tuple[str, str]], role: str, text: str, before: str
           ) -> tuple[str, tuple[int, str, int | None, int | None]]:
    """The output with the turn, and (characters of the output before that go, the span, place
    of the text in the span)."""
    after = render([*earlier, (role, text)])
    kept = _common(before, after)
    span, probed = after[kept:], render([*earlier, (role, PROBE)])
    frame = probed[kept:] if probed[:kept] == after[:kept] else ""
    if frame.count(PROBE) == 1:
        head, tail = frame.split(PROBE)
        if (len(span) >= len(head) + len(tail) and span.startswith(head) and span.endswith(tail)):
            return after, (len(before) - kept, span, len(head), len(span) - len(tail))
    return after, (len(before) - kept, span, None, None)


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(turns: DataFrame, render: Render = inst_template, context: int | None = None
                 ) -> DataFrame:
    """One row a turn, in pieces of the formatted conversation.

    conv_id, turn_no (from 0), role, dropped (characters at the end of the output so far that
    the template took back; 0 unless it rewrites history), piece (what then follows), text_start
    and text_end (the text inside the piece, null if the template changed it beyond locating),
    loss (whether that part is under the loss mask). The formatted conversation is the pieces
    one after the other, each after dropping that many characters.
    """
    dtype = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "turn_no", "role", "dropped", "piece", "text_start", "text_end", "loss"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, earlier, before, rows, size, kind = object(), 0, [], "", [], 0, None

        def flush():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (
                kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(),
                pa.bool_()))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist()
                                          for c in ("conv_id", "role", "text"))):
                if conv != current:
                    current, number, earlier, before = conv, 0, [], ""
                before, (dropped, piece, start, end) = locate(render, earlier, role, text, before)
                loss = role == "assistant" and start is not None
                rows.append((conv, number, role, dropped, piece, start, end, loss))
                number, size = number + 1, size + len(piece)
                earlier.append((role, text))
                if context is not None and len(earlier) > context:
                    earlier = earlier[len(earlier) - context:]
                    before = render(earlier) if earlier else ""
                if size > _FLUSH_CHARS:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    empty = F.lit("")
    kept = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"),
                        F.coalesce("text", empty).alias("text"))
    return _in_order(kept, "turn", "role", "text").mapInArrow(
        scan, f"conv_id {dtype}, turn_no long, role string, dropped long, piece string, "
        "text_start long, text_end long, loss boolean")


def read_back(pieces: DataFrame) -> DataFrame:
    """What the pieces of ``inst_template`` say of each conversation, one row a conversation.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of every turn), loss_chars
    and loss_sha256 (all text under the mask), formatted_chars.
    """
    dtype = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def result(kind):
            conv, n, digest, chars, loss, total, _ = state
            row = (conv, n, digest.hexdigest(), chars, loss.hexdigest(), total)
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv, piece, start, end, loss in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "piece", "text_start", "text_end", "loss"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(result(kind))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""]
                turns, state[6] = read_turns(state[6] + piece, state[5] == 0)
                for role, text in turns:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    text = unescape(piece[start:end])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(piece)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield result(kind)

    kept = pieces.select("conv_id", "turn_no", "piece", "text_start", "text_end", "loss")
    return _in_order(kept, "turn_no").mapInArrow(
        scan, f"conv_id {dtype}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long")
