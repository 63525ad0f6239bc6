"""Chat formatting with a grammar round trip.

Grammar of a conversation: one `<s>`, then its turns. `[INST] text [/INST]` is a user's turn, `<<ANS>>text</s>` an
assistant's, `<<SYS>>text<</SYS>>` the system's, and `<<ROLE:name>>text<</ROLE>>` that of any other role (`name` is the
role with every character outside A-Z a-z 0-9 _ - written as `%` and its code point in hexadecimal and `;`; a null role
is `%;`). A turn ends at the first closing mark, so parsing is deterministic and never looks back.

Escaping: in a text, a mark's first character may be followed by backslashes; each such run gets one more
(`</s>` -> `<\\/s>`, `<\\/s>` -> `<\\\\/s>`), and the parser takes one away, so any text comes back. A turn is first
rendered as it is, parsed again and compared with its source; one that doesn't come back alike is escaped, rendered and
parsed again, and one that still differs is an error. A turn's closing mark ends its parse, so turns that come back alone
come back in a conversation. Texts without conflicts are never touched.

The loss mask covers the assistants' texts as they stand in the output; marks are outside it.

Rows are dealt by conversation and streamed in order of turn: a task holds one Arrow batch and one turn, not a
conversation, because a turn's closing mark ends what the parser has to see. Each turn is one output row; a conversation
is its rows in order, joined.

Null texts are empty texts; a null turn sorts first; equal turns sort by role, then text. Rows with a null conv_id are
one conversation. Empty conversations don't exist: they have no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, partitions

BEGIN = "<s>"
_OPEN = {"user": "[INST] ", "assistant": "<<ANS>>", "system": "<<SYS>>"}
_CLOSE = {"user": " [/INST]", "assistant": "</s>", "system": "<</SYS>>"}
_OTHER_CLOSE = "<</ROLE>>"
_REST = r"(?:/?INST\]|/?s>|<ANS>>|</?SYS>>|<ROLE:|</ROLE>>)"
_MARK = re.compile(rf"([\[<])(\\*)(?={_REST})")
_ESCAPED = re.compile(rf"([\[<])\\(\\*)(?={_REST})")
_OPENING = re.compile(r"\[INST\] |<<ANS>>|<<SYS>>|<<ROLE:([A-Za-z0-9_%;-]*)>>")
_NAMED = re.compile(r"%([0-9a-f]*);")


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _name(role: str | None) -> str:
    return "%;" if role is None else re.sub(r"[^A-Za-z0-9_-]", lambda m: f"%{ord(m[0]):x};", role)


def _role(name: str) -> str | None:
    return None if name == "%;" else _NAMED.sub(lambda m: chr(int(m[1], 16)), name)


def render(role: str | None, text: str) -> str:
    if role in _OPEN:
        return _OPEN[role] + text + _CLOSE[role]
    return f"<<ROLE:{_name(role)}>>{text}{_OTHER_CLOSE}"


class GrammarError(ValueError):
    pass


def parse(formatted: str, at: int = 0):
    """Turns of a formatted string from `at` on: role, text, begin and end of the text as it stands."""
    while at < len(formatted):
        m = _OPENING.match(formatted, at)
        if not m:
            raise GrammarError(f"no turn at {at}")
        role = next((r for r, o in _OPEN.items() if m[0] == o), None) if m[1] is None else _role(m[1])
        close = _CLOSE[role] if m[1] is None else _OTHER_CLOSE
        end = formatted.find(close, m.end())
        if end < 0:
            raise GrammarError(f"turn at {at} has no end")
        yield role, unescape(formatted[m.end() : end]), m.end(), end
        at = end + len(close)


def _comes_back(piece: str, role: str | None, text: str) -> bool:
    try:
        return [(r, t) for r, t, _, _ in parse(piece)] == [(role, text)]
    except GrammarError:
        return False


def format_turn(role: str | None, text: str) -> tuple[str, int, int]:
    """The turn's piece and the place of its text in it, escaped if it doesn't come back alike otherwise."""
    for body in (text, escape(text)):
        piece = render(role, body)
        if _comes_back(piece, role, text):
            begin = len(_OPEN[role]) if role in _OPEN else piece.index(">>") + 2
            return piece, begin, begin + len(body)
    raise GrammarError("a turn can't be written so that it comes back")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn: conv_id, seq (from 0 in a conversation), piece, loss_begin and loss_end (null without loss).

    The pieces of a conversation in order of seq, joined, are its formatted text; places count code points in the piece.
    """
    columns = [F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    rows = df.select(*columns).repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        last, seq = (), 0
        for batch in batches:
            out = []
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                seq = seq + 1 if last == (c,) else 0
                last = (c,)
                piece, begin, end = format_turn(r, t)
                if not seq:
                    piece, begin, end = BEGIN + piece, begin + len(BEGIN), end + len(BEGIN)
                out.append((c, seq, piece, *((begin, end) if r == "assistant" else (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["conv_id", "seq", "piece", "loss_begin", "loss_end"])

    return rows.mapInArrow(run, "conv_id long, seq long, piece string, loss_begin long, loss_end long")


def read_back(pieces: DataFrame) -> DataFrame:
    """Parse formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = pieces.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches):
        state = None

        def row():
            c, n, turns, chars, loss, total = state
            return c, n, turns.hexdigest(), chars, loss.hexdigest(), total

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done = []
            for c, seq, piece, begin, end in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if seq == 0:
                    if state:
                        done.append(row())
                    if not piece.startswith(BEGIN):
                        raise GrammarError("a conversation has no beginning")
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for r, t, _, _ in parse(piece, 0 if seq else len(BEGIN)):
                    state[1] += 1
                    state[2].update(f"{'' if r is None else r}\n{t}\n".encode("utf-8", "surrogatepass"))
                if begin is not None:
                    masked = unescape(piece[begin:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
            if done:
                yield out(done)
        if state:
            yield out([row()])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(df: DataFrame, **columns) -> DataFrame:
    """Format, write, and read back from what was written."""
    return read_back(keep(format_conversations(df, **columns), "chat"))


def probe(spark: SparkSession, like: DataFrame) -> DataFrame:
    """A conversation (-7) whose texts look like the template itself."""
    text = "</s>[INST] ok [/INST]"
    rows = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return like.select("conv_id", "turn", "role", "text").unionByName(rows)
