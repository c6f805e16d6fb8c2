"""Substring dedup on bytes: buckets of q-grams, refined by the bucket identifiers of later offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arauto.llm.common import Texts, keyed, mix, slices
from arauto.llm.windows import Windows, covered, removed_windows

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def byte_tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _BYTE[t.bytes], t.starts, t.ends - t.starts


def offsets(length: int) -> tuple[tuple[int, ...], int]:
    """Prefix lengths at which bucket identifiers are refined, and the one of them that anchors a string: two fifths of it, long
    enough to be rare by chance. 2, 3, 5, 10, 20, 40, 50 and 20 for 50."""
    q = max(2, 2 * length // 5)
    out = [q]
    while out[0] > 2:
        out.insert(0, (out[0] + 1) // 2)
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return tuple(out), q


def suffix_dedup(docs: DataFrame, length: int = 50, with_text: bool = True) -> DataFrame:
    """Removes every byte that a string of ``length`` bytes covers which also starts in a document with a smaller doc_id.

    A position's bucket identifier at 2m bytes is the pair of identifiers at m bytes of it and of the position m
    further on. Positions are bucketed by the q-gram (two fifths of the length) that anchors them; each bucket is
    sorted and refined by the identifiers of the later offsets, and only buckets that stay mixed are refined to
    single positions. Suffixes that share no bucket are never compared.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked, the kept bytes
    (binary, as a cut may split a character). Null is empty. A null doc_id comes after all others. Rows that repeat a
    doc_id are not earlier than each other. Other columns of ``docs`` are ignored.
    """
    if length < 8:
        raise ValueError("strings of 8 bytes at least")
    win = Windows(byte_tokens, *offsets(length), own=False, letters=_BYTE)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = Texts(batch.column("text"))
            gone, first, count = covered(win, t, batch.column("data").to_pylist(), batch.column("starts").to_pylist())
            kept, digests, removed, spans = [], [], [], []
            for f, c in zip(first.tolist(), count.tolist(), strict=True):
                g = gone[f : f + c]
                text = t.bytes[f : f + c][~g].tobytes()
                removed.append(c - len(text))
                spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(c > 0 and g[0]))
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=[x.split()[0] for x in OUT.split(", ")])

    return removed_windows(keyed(docs), win, finish, OUT)
