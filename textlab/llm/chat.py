"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to one string.  Successive
prefixes of a conversation are rendered and consecutive outputs compared:
where the new output begins with the old one, the rest is the new turn's
span, and the turn's escaped text inside that span is its content.  Where it
does not, the template rewrites history; the conversation is marked, and no
part of it is put under the loss mask.

Rows are shuffled by conversation and sorted within partitions.  A template is a
black box, so each prefix is rendered whole, from the first turn on, whatever the
length: the turns of one conversation are held by its task, and its time grows
with the square of them.  A template that says it renders turn by turn
(``by_turn``), as the default one does, is rendered in blocks of ``block`` turns
instead, each after the one before it, so that no conversation is ever collected;
within that reach the comparison still checks it.  A second, ordered window over
the conversation settles its mark; its rows wait in Spark's own spill files.

Defined results: NULL texts are empty, NULL roles the empty role; turns are
taken by (turn, role, text), NULL turn numbers first, and numbered anew, so
repeated rows are repeated turns; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import ship_package

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn], int], str]

_START, _LINE, _SPELT = "<|im_start|>", "\n", "\\n"
#: Strings with a meaning to the model; never left whole inside a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_MARKED = re.compile(r"\\(\\|n)?")


def escape(text: str) -> str:
    """A backslash goes after the first character of each backslash and control string."""
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "\\" in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    """A doubled backslash stands for itself, one before n for a line end (in roles); any other goes."""
    return _MARKED.sub(lambda m: "\n" if m[1] == "n" else m[1] or "", text) if "\\" in text else text


def default_template(turns: list[Turn], first: int = 0) -> str:
    """Start mark, role, line end, text, end mark, line end.  The role's line ends are spelt out."""
    return "".join(f"{_START}{escape(role).replace(_LINE, _SPELT)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


default_template.by_turn = True  # its output is that of its turns joined


def spans(turns: list[Turn], template: Template, first: int = 0,
          context: int = 0) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The rendered block, (start, end, content start, content end) of each turn, and whether history was kept.

    A turn's content is found by rendering the same prefix with a probe for its text: what stands before
    and after the probe stands before and after the content.  The first ``context`` turns are rendered
    before the others, but are not part of the block.
    """
    old, out, kept = template(turns[:context], first) if context else "", [], True
    at_block = len(old)
    for k in range(context + 1, len(turns) + 1):
        new = template(turns[:k], first)
        probe = "probe"
        while probe in new:
            probe += "x"
        probed = template([*turns[:k - 1], (turns[k - 1][0], probe)], first)
        at = probed.find(probe)
        end = len(new) - (len(probed) - at - len(probe))
        if not new.startswith(old) or not len(old) <= at <= end <= len(new) or new[:at] != probed[:at]:
            kept = False
        out.append(tuple(x - at_block for x in (len(old), len(new), at, end)))
        old = new
    return old[at_block:], out, kept


FORMATTED = ("conv_id long, turn_no long, role string, rendered string, content_start long, content_end long, "
             "loss boolean, kept boolean")
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
_NAMES = [x.split()[0] for x in FORMATTED.split(", ")]


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(3)))


def format_chats(conversations: DataFrame, template: Template = default_template, loss_role: str = "assistant",
                 block: int = 32, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per turn, in order within its partition: ``rendered`` joined over turns is the formatted
    conversation, content_start and content_end lie within ``rendered``, ``loss`` marks trained content."""
    ship_package(conversations.sparkSession)
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text"))

    by_turn = getattr(template, "by_turn", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns in groupby(_turns(batches), key=lambda r: r[0]):
            first, before, kept = 0, [], True
            while part := [row[1:] for row in (islice(turns, block) if by_turn else turns)]:
                out, kept = render(conv, part, first, before, kept)
                yield out
                first, before = first + len(part), part

    def render(conv, part: list[Turn], first: int, before: list[Turn], kept: bool) -> tuple[pa.RecordBatch, bool]:
        """A block after the one before it, and whether history was kept up to its end."""
        if kept:
            whole, found, kept = spans(before + part, template, first - len(before), len(before))
            # one whose block depends on the one before it does not render turn by turn
            kept = kept and (not before or whole == template(part, first))
        if not kept:
            whole = template(part, first)
            found = [(len(whole),) * 4] * len(part)
        ends = [e for _, e, _, _ in found]
        starts = [0, *ends[:-1]]
        cols = ([conv] * len(part), range(first, first + len(part)), [r for r, _ in part],
                [whole[a:b] for a, b in zip(starts, ends)],
                [c - a if kept else 0 for (_, _, c, _), a in zip(found, starts)],
                [c - a if kept else 0 for (_, _, _, c), a in zip(found, starts)],
                [kept and r == loss_role for r, _ in part], [kept] * len(part))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES), kept

    each = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    kept = F.min("kept").over(each)
    marked = rows.mapInArrow(_joined(run), FORMATTED).withColumn("kept", kept)
    return marked.select(  # of a conversation whose history was rewritten: no content, no loss
        "conv_id", "turn_no", "role", "rendered",
        *(F.when(F.col("kept"), F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in ("content_start", "content_end")),
        (F.col("loss") & F.col("kept")).alias("loss"), "kept")


def _joined(run):
    """Small batches put together, so that a conversation does not cost a message of its own."""
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= 1024:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return out


def read_back(rendered: str, start: int, end: int) -> Turn:
    """Role and text of one turn that the default template rendered."""
    return unescape(rendered[len(_START):start - 1]), unescape(rendered[start:end])


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "kept boolean")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns alone, streaming in the order that ``format_chats`` leaves."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False, name=None))
        out = []
        for conv, turns in groupby(rows, key=lambda r: None if pd.isna(r[0]) else int(r[0])):
            n, chars, loss_chars, all_kept = 0, 0, 0, True
            every, loss = hashlib.sha256(), hashlib.sha256()
            for _, _, _, rendered, a, b, in_loss, kept in turns:
                role, text = read_back(rendered, int(a), int(b))
                every.update(f"{role}\n{text}\n".encode())
                if in_loss:
                    loss.update(text.encode())
                    loss_chars += len(text)
                n, chars, all_kept = n + 1, chars + len(rendered), all_kept and bool(kept)
            out.append((conv, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars, all_kept))
            if len(out) == 1024:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(out: list) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=[x.split()[0] for x in DIGEST.split(", ")])
        return made.astype({"conv_id": "Int64"})

    return formatted.mapInPandas(run, DIGEST)
