"""Words and statistics of whole texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_rows

CHUNK_BYTES = 2_000_000


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Rows of about `most` bytes of text each; a longer text is a chunk of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield slice(start, stop)
        start = stop


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts in order, and where each text's words begin (n + 1 places). A null has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, at = lists.flatten(), lists.offsets.to_numpy()
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return flat.filter(keep), kept[at - at[0]]


#: Characters that count as symbols: fixed by the contract of the quality rules.
SYMBOLS = "#*$%&|<>"
STATS = ("n_chars_", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_exclaim", "n_commas_stops", "n_long_words", "n_foreign")

_B = np.arange(256)
_CLASSES = {
    "start": (_B & 0xC0) != 0x80,
    "space": (_B == 32) | ((_B >= 9) & (_B <= 13)),
    "symbol": np.isin(_B, list(SYMBOLS.encode())),
    "upper": (_B >= 65) & (_B <= 90),
    "lower": (_B >= 97) & (_B <= 122),
    "digit": (_B >= 48) & (_B <= 57),
    "mark": ((_B >= 33) & (_B <= 47)) | ((_B >= 58) & (_B <= 64)) | ((_B >= 91) & (_B <= 96)) | ((_B >= 123) & (_B <= 126)),
    "exclaim": _B == ord("!"),
    "stop": (_B == ord(",")) | (_B == ord(".")),
    "foreign": _B >= 0xC0,
}
_MATRIX = np.array(list(_CLASSES.values())).T.astype(np.int64)


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that the text has twice or more; ids are small integers."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # number the pairs first, so that a window still fits
        pairs = np.unique((ids[:-1] << 31) | ids[1:], return_inverse=True)[1]
        windows = (pairs[:-1] << 31) | ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def text_stats(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each text; a null counts as empty."""
    out = np.zeros((len(texts), len(STATS)), np.int64)
    for part in chunks(texts):
        some = pc.fill_null(texts[part.start : part.stop], "")
        flat, at = words(some)
        coded = flat.dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int64)
        long_word = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy() > 12)])
        for k, text in enumerate(some.to_pylist()):
            count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256) @ _MATRIX
            chars, space, symbols, upper, lower, digits, marks, exclaim, stops, foreign = count
            own = ids[at[k] : at[k + 1]]
            n_lines, dup = duplicate_lines(text)
            out[part.start + k] = (chars, len(own), chars - space, symbols, n_lines, dup, repeated_words(own), len(set(own.tolist())) if len(own) < 64 else len(np.unique(own)), upper, lower, digits, marks, exclaim, stops, long_word[at[k + 1]] - long_word[at[k]], foreign)
    return out


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = text_stats(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATS...) for every row, repeated rows too; other columns go."""
    rows = text_rows(docs, id_col, text_col)
    return rows.mapInArrow(_stats_batches, "doc_id long, " + ", ".join(f"{x} long" for x in STATS))


def _stats_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = text_stats(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(STATS)))], names=["row_", *STATS])


def beside_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row_, STATS...): each whole row of docs as a struct, beside the statistics of its text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row_"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_stats_beside, f"row_ {rows.schema['row_'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in STATS))
