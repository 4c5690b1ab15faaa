"""Token counts of document sections by offset-mapped attribution.

A whole document is encoded once. Tokens carry the bytes they cover; each token is joined to the
sections that its bytes meet. A token that crosses a boundary goes, whole, to the section that holds most of its
bytes (the earliest of equal ones) in n_tokens, and by bytes to each section it meets in share.

Defined cases: a null or empty text gives no rows; sections are cut to the text; where two overlap,
the one that starts later begins where the other ends; text outside of all sections is attributed to
rows of section null, one for each gap; repeated rows give their rows each; long texts are encoded whole; an empty table gives no rows;
kept columns with names of the result's columns give way to them, and docs' other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a text is cut before merges apply.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space beyond this are cut by a matcher that needs no stack.
LONG_RUN = 4096


class Encoder:
    """Byte-level BPE from a file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.lengths[i] = len(piece)
        self.pieces = regex.compile(PATTERN)
        self.long = regex.compile(rf"\s{{{LONG_RUN}}}")

    def ids(self, text: str) -> list[int]:
        if len(text) < LONG_RUN or not self.long.search(text):
            return self.encoding.encode_ordinary(text)
        return [i for m in self.pieces.finditer(text) for i in self.encoding._encode_single_piece(m.group())]

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token of the text ends."""
        return np.cumsum(self.lengths[np.array(self.ids(text), np.int64)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def lines_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the lines; a line has its line feed."""
    cuts = np.flatnonzero(raw == 10) + 1
    ends = cuts if len(cuts) and cuts[-1] == len(raw) else np.append(cuts, len(raw))
    return np.append(0, ends[:-1]), ends


def allocate(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole tokens, crossing tokens and byte shares for sections that part the bytes without gaps."""
    begins = np.append(0, ends[:-1])
    first = np.searchsorted(stops, begins, "right")
    last = np.searchsorted(stops, ends, "left")
    n = len(stops)
    inside = first == last
    whole = np.bincount(first[inside], minlength=n)
    share = whole.astype(float)
    crossing = np.zeros(n, np.int64)
    for i in np.flatnonzero(~inside):
        met = np.arange(first[i], last[i] + 1)
        part = np.minimum(stops[met], ends[i]) - np.maximum(starts[met], begins[i])
        whole[met[np.argmax(part)]] += 1
        crossing[met] += 1
        share[met] += part / part.sum()
    return whole, crossing, share


def _partition(raw: np.ndarray, sections: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """Starts, ends, numbers (-1: gap) and names of sections and gaps, in bytes."""
    if sections is None:
        starts, ends = lines_of(raw)
        return starts, ends, np.arange(len(starts)), ["line"] * len(starts)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each code point
    cut = lambda x: int(at[min(max(x, 0), len(at) - 1)])
    out, end = [], 0
    for k in sorted(range(len(sections)), key=lambda k: (sections[k]["start"], k)):
        a, b = max(cut(sections[k]["start"]), end), cut(sections[k]["end"])
        if b <= a:
            continue
        if a > end:
            out.append((end, a, -1, None))
        out.append((a, b, k, sections[k]["name"]))
        end = b
    if end < len(raw):
        out.append((end, len(raw), -1, None))
    a, b, k, names = zip(*out, strict=True)
    return np.array(a), np.array(b), np.array(k), list(names)


RESULT = ("section", "name", "start", "end", "n_tokens", "n_crossing", "share")


def attribute(docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text", sections: str | None = None) -> DataFrame:
    """The columns of keep, and for each section and gap: section (its number, null for a gap), name, start and end
    (code points), n_tokens, n_crossing, share. tokenizer: path of a file of ranks, on every machine.
    sections: column array<struct<name, start, end>> in code points; without it, lines."""
    keep = [k for k in keep if k not in RESULT]
    df = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.col(text).alias("t"), (F.col(sections) if sections else F.lit(None).cast("int")).alias("s"))
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[f'k{i}']}" for i in range(len(keep))), "section int, name string, start long, end long, n_tokens long, n_crossing long, share double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows, parts, names = [], [], []
            marks = batch.column("s").to_pylist() if sections else None
            for r, t in enumerate(batch.column("t")):
                if not (t := t.as_py()):
                    continue
                raw = np.frombuffer(t.encode("utf-8"), np.uint8)
                starts, stops, number, name = _partition(raw, (marks[r] or []) if marks else None)
                whole, crossing, share = allocate(enc.ends(t), starts, stops)
                if len(raw) != len(t):
                    at = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                    starts, stops = at[starts], at[stops]
                rows.append(np.full(len(starts), r))
                names += name
                parts.append((number, starts, stops, whole, crossing, share))
            if not rows:
                continue
            number, starts, stops, whole, crossing, share = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = pa.array(np.concatenate(rows))
            out = [batch.column(f"k{i}").take(at) for i in range(len(keep))]
            out += [pa.array(number.astype(np.int32), mask=number < 0), pa.array(names, pa.string())]
            out += [pa.array(x.astype(np.int64)) for x in (starts, stops, whole, crossing)] + [pa.array(share)]
            yield pa.RecordBatch.from_arrays(out, [*(f"k{i}" for i in range(len(keep))), *RESULT])

    out = df.mapInArrow(run, schema)
    return out.toDF(*keep, *out.columns[len(keep) :])
