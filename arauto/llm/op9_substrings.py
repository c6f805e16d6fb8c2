"""Substring dedup by level-wise doubling over word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arauto.llm.common import Texts, kept_schema, keyed, slices, word_ids, words_of
from arauto.llm.windows import Windows, covered, removed_windows

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def word_tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin, end, doc, b = words_of(t)
    first = np.searchsorted(doc, np.arange(len(t.starts)))
    return word_ids(b, begin, end), first, np.searchsorted(doc, np.arange(len(t.starts)), "right") - first


def levels(window: int) -> tuple[int, ...]:
    """Lengths that double up to the window: 2, 3, 5, 10, 20 for 20."""
    out = [window]
    while out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return tuple(reversed(out[:-1]))


def substring_dedup(docs: DataFrame, window: int = 20, with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Removes every word that a window of ``window`` words covers whose words also start earlier.

    Earlier is a smaller doc_id, or the same document and a smaller start. Windows repeated at half the length (they
    share an anchor there) are extended to the full one; no others are looked at again. Texts are judged as given.

    Returns doc_id, n_words, n_removed, kept_sha256 and, if asked, the kept words joined by blanks, with the columns
    ``keep`` as kept_<name>. Null and blank texts
    have no words; texts shorter than the window keep all. A null doc_id comes after all others. Rows that repeat a
    doc_id are not earlier than each other. Other columns of ``docs`` are ignored.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    lengths = levels(window)
    win = Windows(word_tokens, lengths, lengths[-2] if len(lengths) > 1 else window, own=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = Texts(batch.column("text"))
            gone, first, count = covered(win, t, batch.column("data").to_pylist(), batch.column("starts").to_pylist())
            begin, end, _, _ = words_of(t)
            kept, digests, removed = [], [], []
            raw = t.bytes.tobytes()
            for f, c in zip(first.tolist(), count.tolist(), strict=True):
                stay = np.flatnonzero(~gone[f : f + c]) + f
                text = b" ".join([raw[x:y] for x, y in zip(begin[stay].tolist(), end[stay].tolist(), strict=True)])
                removed.append(c - len(stay))
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string()), *[batch.column(f"kept_{c}") for c in keep]], names=[*[x.split()[0] for x in OUT.split(", ")], *[f"kept_{c}" for c in keep]])

    return removed_windows(keyed(docs, keep), win, finish, OUT + kept_schema(docs, keep))
