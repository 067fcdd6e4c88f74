"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metagauge.llm.encoding import Encoder, dropped_space_pieces, sums
from metagauge.llm.words import steps, text_bytes

_KNOWN: dict[str, Encoder] = {}
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, batch_bytes: int = 2_000_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    For vocabularies that drop white space, such as ``word_bpe_49k.json``. A text is split at white space, where no token
    spans, so a long one costs no more a byte than a short one; batches hold about ``batch_bytes`` of text, however many rows
    that is. Ids never leave the function. Null and empty texts count 0 tokens; a null id stays null; repeated rows are
    counted each; other columns are not read; an empty table gives no rows.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _KNOWN.setdefault(vocabulary, Encoder(vocabulary))
        for batch in batches:
            for part in steps(batch, "text", batch_bytes):
                data, borders = text_bytes(part.column("text"))
                starts, ends, first = dropped_space_pieces(data, borders)
                n = sums(known.find(data, starts, ends)[1], first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(borders)), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(counted, SCHEMA)
