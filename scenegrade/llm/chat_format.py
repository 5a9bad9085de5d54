"""Chat formatting by a state machine over roles, with loss flags per segment."""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scenegrade.llm.common import pick, stored, tasks_for

#: The declarative template: marks around a turn, labels of roles, roles whose text is learned, the escape character,
#: and for every state the roles that may follow ('' is the state before the first turn).
TEMPLATE = {
    "open": "### ", "mid": ": ", "close": "</turn>\n", "escape": "\\",
    "labels": {"system": "System", "user": "User", "assistant": "Assistant"},
    "learned": ["assistant"],
    "next": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "final": ["user", "assistant"],
}
#: Label of a role that the template doesn't name: this mark, then the escaped role.
OTHER = "@"


class Formatter:
    """Segments of turns and their way back, as the template says."""

    def __init__(self, template: dict):
        self.t = template
        first = {template[k][0] for k in ("open", "close")} | {template["escape"]}
        self.special = re.compile("[" + re.escape("".join(sorted(first))) + "]")
        self.in_label = re.compile("[" + re.escape("".join(sorted(first | {template["mid"][0], OTHER}))) + "]")
        self.escaped = re.compile(re.escape(template["escape"]) + "(.)", re.S)
        self.roles = {label: role for role, label in template["labels"].items()}

    def escape(self, text: str, what: re.Pattern) -> str:
        """Every first character of a control string, and the escape character, gets the escape character before it."""
        return what.sub(lambda m: self.t["escape"] + m[0], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        label = self.t["labels"].get(role) or OTHER + self.escape(role, self.in_label)
        head = self.t["open"] + label + self.t["mid"]
        return [(head, False), (self.escape(text, self.special), role in self.t["learned"]), (self.t["close"], False)]

    def turn(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        head, mid, body = formatted.partition(self.t["mid"])
        while head.endswith(self.t["escape"]) and (len(head) - len(head.rstrip(self.t["escape"]))) % 2:
            more, again, body = body.partition(self.t["mid"])
            head += mid + more
        label = head.removeprefix(self.t["open"])
        role = self.unescape(label[len(OTHER) :]) if label.startswith(OTHER) else self.roles[label]
        return role, self.unescape(body.removesuffix(self.t["close"]))


def format_turns(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Formatted turns: conv_id, place (from 0), segments (array of text, loss), error.

    Turns are ordered by (turn, role, text), nulls first, and streamed in that order, one row at a time, so a
    conversation of any length needs no memory for all of it. The machine starts in state '' and follows the roles; a
    role that may not follow gets an error, which names it, and the machine goes on from that role; unknown roles leave
    the state as it is. Null roles and texts are empty; rows with a null conv_id form one conversation.
    """
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.repartition(tasks_for(conversations), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        make, now, state, place = Formatter(template), object(), "", 0
        for batch in batches:
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            places, made, errors = [], [], []
            for conv, role, text in zip(ids, roles, texts):
                if conv != now:
                    now, state, place = conv, "", 0
                may = role in template["next"][state]
                errors.append(None if may else f"{role or 'no role'} after {state or 'the start'}")
                state = role if role in template["next"] else state
                places.append(place)
                made.append([{"text": t, "loss": loss} for t, loss in make.segments(role, text)])
                place += 1
            shape = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(made, shape), pa.array(errors, pa.string())], names=["conv_id", "place", "segments", "error"])

    return rows.mapInArrow(run, f"conv_id {kind}, place bigint, segments array<struct<text:string,loss:boolean>>, error string")


def read_digests(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation, from the formatted turns alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid (no error, and the last role may end a conversation)."""
    rows = formatted.repartition(tasks_for(formatted), "conv_id").sortWithinPartitions("conv_id", "place")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        read, now = Formatter(template), None

        def close():
            conv, n, turns, chars, loss, size, ok, role = now
            return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, ok and role in template["final"]]

        def emit(done, of):
            columns = list(map(list, zip(*done)))
            return pa.RecordBatch.from_arrays([pa.array(c, k or of) for c, k in zip(columns, kinds)], names=names)

        of = None
        for batch in batches:
            done, of = [], batch.schema.field("conv_id").type
            for conv, segments, error in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segments", "error"))):
                if now is None or conv != now[0]:
                    if now is not None:
                        done.append(close())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""]
                whole = "".join(s["text"] for s in segments)
                role, text = read.turn(whole)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        learned = read.unescape(s["text"])
                        now[3] += len(learned)
                        now[4].update(learned.encode())
                now[5] += len(whole)
                now[6] &= error is None
                now[7] = role
            if done:
                yield emit(done, of)
        if now is not None:
            yield emit([close()], of)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")


def conversation_digests(conversations: DataFrame, template: dict = TEMPLATE, folder: str | None = None) -> DataFrame:
    """Formats all conversations, stores the formatted turns and reads them back."""
    return read_digests(stored(format_turns(conversations, template), "chat", folder), template)
