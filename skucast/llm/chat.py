"""Operator 10: chat formatting checked by a grammar round trip.

Template of a turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside roles and texts ``<|`` is a
conflict; escaping puts a backslash between the two characters (one more where some stand already), newlines of
a role become ``\\n``. A turn is first rendered as it stands, read by the deterministic parser and compared with
its source; conflicting content is escaped, and rendered anew, until the parser returns the source.

Defined results: a null text or role is empty; rows with equal conversation and turn are ordered by role and
text and all kept; a null conv_id is a conversation of its own; null turns come first; a table without rows
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SPAN = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
PARTS = "conv_id long, turn long, role string, text string, formatted string, loss_start int, loss_end int"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


class Parser:
    """Reads formatted text in pieces; yields (role, text, start, end), the span of the text as it was written.

    Grammar: ``(START role "\\n" text END "\\n")*``; roles hold no newline, roles and texts hold no ``<|``.
    At most one open turn is buffered."""

    def __init__(self):
        self.open, self.at = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        self.open += piece
        while (stop := self.open.find(END + "\n")) >= 0:
            head = self.open.find("\n")
            role, body = self.open[len(START):head], self.open[head + 1:stop]
            if not self.open.startswith(START) or head < 0 or head > stop or "<|" in role or "<|" in body:
                raise ValueError(f"not a formatted turn at character {self.at}")
            yield _unescape_role(role), unescape(body), self.at + head + 1, self.at + stop
            used = stop + len(END) + 1
            self.open, self.at = self.open[used:], self.at + used

    def close(self) -> None:
        if self.open:
            raise ValueError(f"unfinished turn at character {self.at}")


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    parser = Parser()
    turns = list(parser.feed(formatted))
    parser.close()
    return turns


def _reads_back(formatted: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(formatted)] == [(role, text)]
    except ValueError:
        return False


def format_turn(role: str, text: str) -> str:
    """The rendered turn: escapes what conflicts until the parsed turn is the source."""
    as_role, as_text = role, text
    formatted = render(as_role, as_text)
    while not _reads_back(formatted, role, text):
        if not _reads_back(render("user", as_text), "user", text):
            as_text = escape(as_text)
        if not _reads_back(render(as_role, ""), role, ""):
            as_role = _escape_role(as_role)
        if render(as_role, as_text) == formatted:
            raise ValueError("the turn cannot be made to read back")
        formatted = render(as_role, as_text)
    return formatted


def format_turns(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Every turn rendered and checked, on its own, so that no conversation is gathered: ``formatted`` and the
    loss span [loss_start, loss_end) in it, of texts of ``train_role`` (null otherwise). The formatted
    conversation is the concatenation of its turns in order."""

    def work(batches):
        for b in batches:
            roles = [r or "" for r in b["role"].to_pylist()]
            texts = [t or "" for t in b["text"].to_pylist()]
            out = [format_turn(r, t) for r, t in zip(roles, texts)]
            spans = [parse(o)[0][2:] if r == train_role else (None, None) for r, o in zip(roles, out)]
            yield pa.RecordBatch.from_arrays(
                [b["conv_id"], b["turn"], pa.array(roles, pa.string()), pa.array(texts, pa.string()),
                 pa.array(out, pa.string()), pa.array([s[0] for s in spans], pa.int32()),
                 pa.array([s[1] for s in spans], pa.int32())],
                names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])

    src = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                       F.col("role").cast("string"), F.col("text").cast("string"))
    return src.mapInArrow(work, PARTS)


def conversation_digests(formatted: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Digests of whole conversations, read back from ``formatted`` by the parser.

    Turns are sorted within partitions and streamed through the parser and the running digests, so a task holds
    one turn at a time, however long the conversation. SHA-256 is sequential by definition: the digest of one
    conversation is made by one task, while its turns are rendered and checked in parallel before."""

    def work(batches):
        state, out = None, []

        def close():
            state["parser"].close()
            out.append((state["id"], state["n"], state["turns"].hexdigest(), state["loss_chars"],
                        state["loss"].hexdigest(), state["chars"]))

        def rows():
            names = [c.split()[0] for c in SPAN.split(", ")]
            schema = pa.schema([(n, pa.string() if "sha256" in n else pa.int64()) for n in names])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], schema.field(i).type) for i in range(len(names))], schema=schema)

        for b in batches:
            for conv, piece in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist()):
                if state is None or state["id"] != conv:
                    if state is not None:
                        close()
                    state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(),
                             "loss_chars": 0, "chars": 0, "parser": Parser()}
                state["chars"] += len(piece)
                for role, text, _, _ in state["parser"].feed(piece):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    if role == train_role:
                        state["loss"].update(text.encode())
                        state["loss_chars"] += len(text)
            if out:
                yield rows()
                out.clear()
        if state is not None:
            close()
            yield rows()

    ordered = (formatted.select("conv_id", "turn", "role", "text", "formatted").repartition("conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted"))
    return ordered.mapInArrow(work, SPAN)
