"""Token counts per section by offset-mapped attribution.

Every document is encoded once, as a whole, with a byte-level vocabulary; the tokens' byte lengths give
their spans. Sections are spans of the same text (by default its lines, each with its line end). Token
spans and section spans are joined as intervals; a token that crosses section boundaries is allocated by
an explicit rule:

* ``majority``: to the section that holds most of its bytes, the first of those on a tie,
* ``start``: to the section where it starts.

So the sections' counts add up to the document's. All of it happens where the text is: no shuffle.

Defined results: null or empty text gives no sections; an empty section has 0 tokens; strings of special
tokens are ordinary text; equal rows each give their rows; rows with a null id are left out; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

RULES = ("majority", "start")
SCHEMA = "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long"
_CODERS: dict[tuple[str, str], tuple] = {}


def coder(path: str, pattern: str):
    """(encoding, byte length per id), once per Python worker."""
    if (path, pattern) not in _CODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _CODERS[path, pattern] = (tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _CODERS[path, pattern]


def line_starts(raw: np.ndarray) -> np.ndarray:
    """Byte starts of a text's lines; a line keeps its line end."""
    starts = np.concatenate([[0], np.flatnonzero(raw == 0x0A) + 1])
    return starts[starts < len(raw)] if len(raw) else starts[:0]


def attribute(token_ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and, of these, the ones that cross a boundary."""
    token_starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(starts, token_starts, "right") - 1
    last = np.searchsorted(starts, token_ends - 1, "right") - 1
    stops = np.append(starts[1:], size)
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        for t in crossing:
            here = slice(first[t], last[t] + 1)
            held = np.minimum(stops[here], token_ends[t]) - np.maximum(starts[here], token_starts[t])
            first[t] += held.argmax()
    return np.bincount(first, minlength=len(starts)), np.bincount(first[crossing], minlength=len(starts))


def section_counts(docs: DataFrame, path: str, pattern: str, rule: str = "majority",
                   sections: Callable[[np.ndarray], np.ndarray] = line_starts,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, stop, n_tokens, n_crossing) per section; start and stop in characters.

    ``sections`` gives the byte starts of the sections of a text's UTF-8 bytes, ascending from 0.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = coder(path, pattern)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0

            def flush():
                columns = [pa.array(np.concatenate(c)) for c in out]
                return pa.RecordBatch.from_arrays([c.cast(pa.int32()) if n == "section" else c.cast(pa.int64())
                                                   for n, c in zip(names, columns, strict=True)], names)

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                raw = np.frombuffer(text.encode(), np.uint8)
                ids = encoding.encode_to_numpy(text, disallowed_special=())
                starts = sections(raw)
                n, n_crossing = attribute(np.cumsum(sizes[ids]), starts, len(raw), rule)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                bounds = chars[np.append(starts, len(raw))]
                columns = [np.full(len(starts), doc_id), np.arange(len(starts)), bounds[:-1], bounds[1:],
                           n, n_crossing]
                for place, column in zip(out, columns, strict=True):
                    place.append(column)
                held += len(starts)
                if held > 1 << 16:
                    yield flush()
                    out, held = [[] for _ in names], 0
            if held:
                yield flush()

    return docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
