"""Operator 13: fill-in-middle rearrangement by repeated-capture matching.

A text is a sequence of units ``[A-Za-z]+|[^A-Za-z]``.  One ``fullmatch`` of
``(unit)*`` by the regex library keeps every repetition of the group, so
``match.ends(1)`` is the list of all unit ends: its length is n, and the two
cuts are two of its entries.  The repetition is possessive, since the units
never need to give back, so a match holds no backtracking states: its memory
is the list of ends.

Draws come from the sha256 of ``<seed>:<doc_id>``, so a text is cut the same way
at every partitioning and after a lost executor.  Every text is handled on its
own in Arrow batches; nothing is shuffled or broadcast.

Defined results: a null or empty text has n = 0 and stays plain; a null id draws
as the empty id; texts of any length are matched whole; repeated rows give
repeated results; columns of the input that have the name of an output column
are left out, all others pass through where asked for.  An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRE, SUF, MID = "<P>", "<S>", "<M>"
UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*+")
#: of 100 texts so many are rearranged, and of 100 rearranged ones so many start with the suffix
RATE, SPM_RATE = 90, 20
#: text handed on at once (bytes); one longer text goes alone
CHUNK = 1 << 20

OUT = ("n", "form", "prefix_chars", "middle_chars", "output")


def unit_ends(text: str) -> list[int]:
    """The end of every unit, in code points."""
    return UNITS.fullmatch(text).ends(1)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit groups of sha256(``<seed>:<doc_id>``)."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i:8 * i + 8], 16) for i in range(4)]


def rearrange(text: str, h: list[int], rate: int = RATE, spm_rate: int = SPM_RATE):
    """(n, form, prefix chars, middle chars, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    if n == 0 or h[2] % 100 >= rate or any(mark in text for mark in (PRE, SUF, MID)):
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[cut - 1] if cut else 0 for cut in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUF}{suffix}{PRE}{prefix}{MID}{middle}"
    return n, "psm", a, b - a, f"{PRE}{prefix}{SUF}{suffix}{MID}{middle}"


def transform(docs: DataFrame, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE,
              key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns of ``keep``, and n, form, prefix_chars,
    middle_chars, output of every text."""
    keep = tuple(c for c in keep if c not in (key, *OUT))
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"),
                       *[F.col(f"`{c}`") for c in keep])
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds),
                        "n long, form string, prefix_chars long, middle_chars long, output string"])
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            others = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            lo, size, got = 0, 0, []
            for i in range(len(batch)):
                t = texts[i].as_py()
                got.append(rearrange(t, draws(seed, ids[i].as_py()), rate, spm_rate))
                size += len(t)
                if size >= CHUNK or i == len(batch) - 1:
                    cols = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(o.slice(lo, i + 1 - lo) for o in others), *cols],
                                                     names=[*(c for c, _ in kinds), *OUT])
                    lo, size, got = i + 1, 0, []

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: a rearranged text holds no
    mark of its own, and no mark can arise where a part meets one, so the marks cut
    the output into its parts."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def op13(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, and the sha256
    of the output and of the text rebuilt from it."""
    return transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
