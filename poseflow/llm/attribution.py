"""Token counts of the sections of documents, from one encoding of each whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .blocks import per_document, text_blocks

NEWLINE = 0x0A
RULES = ("first", "last", "most")


def line_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the lines of a block's texts start; a line has its newline, and an empty text no line."""
    begins = np.zeros(len(data) + 1, bool)
    begins[1:][data == NEWLINE] = True
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins[:-1])


def paragraph_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where paragraphs start: at a text's start, and after two or more newlines, which belong to the paragraph before."""
    begins = np.zeros(len(data) + 1, bool)
    newline = data == NEWLINE
    begins[2:-1] = newline[1:-1] & newline[:-2] & ~newline[2:] if len(data) > 2 else False
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    # Two newlines of which the first ends another text are one newline of this one.
    at = offsets[:-1] + 1
    at = at[(at < len(data)) & ~np.isin(at, offsets)]
    begins[at] = False
    return np.flatnonzero(begins[:-1])


SECTIONS = {"lines": line_starts, "paragraphs": paragraph_starts}


def owners(first: np.ndarray, last: np.ndarray, token_starts: np.ndarray, token_ends: np.ndarray, section_starts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token, given those of its first and last byte."""
    if rule == "first":
        return first
    if rule == "last":
        return last
    out = first.copy()
    for k in np.flatnonzero(first != last).tolist():
        edges = np.concatenate([[token_starts[k]], section_starts[first[k] + 1 : last[k] + 1], [token_ends[k]]])
        out[k] = first[k] + int(np.diff(edges).argmax())
    return out


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: str = "lines", rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """The id, section (from 0), start and end in characters, n_tokens and n_crossing of each section of each document.

    A document is encoded once, as a whole; a token's span follows from the lengths its vocabulary entry stands for, and
    is joined to the sections by place. A token that lies in several sections, as n_crossing counts for the section
    that gets it, goes by `rule` to the section of its first byte, of its last byte, or to that with most of its bytes
    (the first of equal ones). So the counts of a document add up to its own count.

    sections: "lines" (each with its newline) or "paragraphs" (cut after two or more newlines). A null or empty text
    has no sections and no rows. Repeated rows give rows each; a null id is kept. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    cut, path = SECTIONS[sections], tokenizer or tokens.default_path()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for some, data, offsets in text_blocks(batches, "text"):
            starts = cut(data, offsets)
            marks = np.searchsorted(starts, offsets)
            ids, _ = encoder.encode_block(data, offsets)
            token_ends = np.cumsum(encoder.byte_lengths[ids])
            token_starts = token_ends - encoder.byte_lengths[ids]
            first = np.searchsorted(starts, token_starts, "right") - 1
            last = np.searchsorted(starts, token_ends - 1, "right") - 1
            owner = owners(first, last, token_starts, token_ends, starts, rule)
            characters = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            of = per_document(marks)
            bounds = np.append(starts, len(data))
            yield pa.RecordBatch.from_pydict({
                "id": some.column(0).take(pa.array(of)), "section": pa.array((np.arange(len(starts)) - marks[of]).astype(np.int32)),
                "start": pa.array(characters[bounds[:-1]] - characters[offsets[of]]), "end": pa.array(characters[bounds[1:]] - characters[offsets[of]]),
                "n_tokens": pa.array(np.bincount(owner, minlength=len(starts)).astype(np.int64)), "n_crossing": pa.array(np.bincount(owner[first != last], minlength=len(starts)).astype(np.int64)),
            })

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, section int, start long, end long, n_tokens long, n_crossing long").withColumnRenamed("id", id_col)
