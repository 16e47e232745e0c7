"""Chat formatting by incremental black-box rendering.

The template is a function from a list of turns to text; nothing about it is known beforehand. A
conversation is rendered for every prefix of its turns. Where each output starts with the one
before, the new characters are the new turn's span. Where an output does not, the template rewrites
history: that conversation is flagged, and has no spans. Inside a span the turn's own text is located by
rendering the same prefix once more with a probe in its place: what stands before and after the
probe is the template's. Spans are offsets into the formatted text in code points.

The default template marks turns with control strings and escapes those, and the escape
character, inside texts; :func:`unescape` undoes it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import map_arrow

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, BODY, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that a text must not be able to show as they are: the template's and common ones.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
_UNSAFE = re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
#: Stands in for a text while its place is sought; private-use characters no template contains.
PROBE = "probe"


def escape(text: str) -> str:
    """``text`` with an escape character put after every escape character and after the first
    character of every control string (overlapping ones too), so that no control string is left."""
    return _UNSAFE.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    """The default template: each turn as start mark, role, text mark, text, end mark."""
    return "".join(f"{START}{escape(role)}{BODY}{escape(text)}{END}" for role, text in turns)


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """The formatted conversation and, for every turn, (start, end) of its span and of its text.
    None instead of spans when the template rewrites history: a longer prefix's output does not
    begin with the shorter one's, or the template changes or drops the probe."""
    spans, before = [], template([])
    for k in range(1, len(turns) + 1):
        role, _ = turns[k - 1]
        now = template(turns[:k])
        probed = template([*turns[:k - 1], (role, PROBE)])
        if not now.startswith(before) or not probed.startswith(before):
            return template(turns), None
        slot = probed.find(PROBE, len(before))
        if slot < 0:
            return template(turns), None
        tail = len(probed) - slot - len(PROBE)
        if len(now) - tail < slot or now[:slot] != probed[:slot] or now[len(now) - tail:] != probed[len(probed) - tail:]:
            return template(turns), None
        spans.append((len(before), len(now), slot, len(now) - tail))
        before = now
    return before, spans


_TURN = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>"


def format_conversations(turns: DataFrame, template: Template = turn_template, loss_roles: tuple[str, ...] = ("assistant",),
                         conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``spans`` (role as rendered, span and
    text offsets, whether the text is under the loss mask) and ``rewrites_history`` (then ``spans`` is
    NULL: a loss mask over shifting text would be wrong).

    Rows are taken by turn, then role, then text (repeated turns all count). NULL texts and roles
    count as empty. Turns of one conversation make one text and so meet in one task; conversations
    are spread by id. An empty table gives an empty result; other columns are ignored.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                 F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    kind = talks.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            formatted, spans, rewrites = [], [], []
            for talk in batch.column(1).to_pylist():
                said = [(t["role"], t["text"]) for t in talk]
                text, found = locate(said, template)
                formatted.append(text)
                rewrites.append(found is None)
                spans.append(None if found is None else [
                    {"role": role, "start": a, "end": b, "text_start": c, "text_end": d, "loss": role in loss_roles}
                    for (role, _), (a, b, c, d) in zip(said, found, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(formatted, pa.string()), pa.array(spans, _ARROW_SPANS),
                 pa.array(rewrites, pa.bool_())],
                names=["conv_id", "formatted", "spans", "rewrites_history"])

    return map_arrow(talks, run, f"conv_id {kind}, formatted string, spans {_TURN}, rewrites_history boolean")


_ARROW_SPANS = pa.list_(pa.struct(
    [("role", pa.string()), *[(n, pa.int32()) for n in ("start", "end", "text_start", "text_end")], ("loss", pa.bool_())]))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns): role, text and loss flag of every turn, read from the default template's
    formatted text at the recorded spans and unescaped."""
    marks = [re.escape(m) for m in (START, BODY)]

    def plain(c):
        return F.regexp_replace(c, r"\\(?s:(.))", "$1")

    def one(s):
        span = F.substr(F.col("formatted"), s["start"] + 1, s["text_start"] - s["start"])
        role = F.regexp_extract(span, f"(?s)^{marks[0]}(.*){marks[1]}$", 1)
        text = F.substr(F.col("formatted"), s["text_start"] + 1, s["text_end"] - s["text_start"])
        return F.struct(plain(role).alias("role"), plain(text).alias("text"), s["loss"].alias("loss"))

    return formatted.select("conv_id", "formatted", F.transform("spans", one).alias("turns"))
