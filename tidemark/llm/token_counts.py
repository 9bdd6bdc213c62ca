"""Token counts: batch encoding in an Arrow function that returns lengths only.

Rows are dealt into encoding batches of bounded UTF-8 bytes. A text longer than a batch is cut at safe boundaries, places
where the tokenizer's pre-tokenizer always cuts, so that the sum over the parts is the count of the whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, text_bytes

#: Bytes of text that one call of the tokenizer gets, and the length of the parts of a longer text.
BATCH_BYTES = 1 << 18
OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# Letters of old standing: ASCII, Latin-1, Greek, Cyrillic, kana, Han and Hangul; and marks that are neither letters nor digits.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿΑ-ΡΣ-ωА-яぁ-ゖァ-ヺ一-龥가-힣"
_MARK = "!-/:-@\\[-`{-~、。！（），：；？「」"
_SAFE = re.compile(rf"(?<=\S)(?=[ \t\n\r\x0b\x0c])|(?<=[{_LETTER}])(?=[0-9{_MARK}])|(?<=[0-9])(?=[{_LETTER}{_MARK}])")
_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _special(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def safe_parts(text: str, most: int, special: list[str] = ()) -> list[str]:
    """Cuts a text at the first safe place behind each ``most`` bytes: before white space that follows a non-space, between
    letters and digits, and before a mark that follows a letter or digit.

    The byte-level pattern has no look-behind, and none of its alternatives goes on across such a place, so each starts a piece
    of its own. Only a special string may lie across one, and isn't cut. A text without such places stays whole: one run of
    letters or of marks is one piece to the pre-tokenizer.
    """
    parts, at = [], 0
    while True:
        # A part of ``most`` code points has ``most`` bytes or more; the part's bytes tell how many code points are enough.
        head = text[at : at + most].encode()
        if len(head) < most or len(head) == most and at + most >= len(text):
            break
        place = at + len(head[:most].decode(errors="ignore"))
        found = _SAFE.search(text, max(place, at + 1))
        while found and any(text.find(s, max(0, found.start() - len(s) + 1), found.start() + len(s) - 1) >= 0 for s in special):
            found = _SAFE.search(text, found.start() + 1)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    parts.append(text[at:])
    return parts


def _encoded(batches: Iterator[pa.RecordBatch], path: str, limit: int, most: int) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(path)
    special = _special(tokenizer)
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        _, bounds = text_bytes(column)
        n_bytes, counts = np.diff(bounds), np.zeros(batch.num_rows, np.int64)
        waiting: list[str] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            lengths = [len(x) for x in tokenizer.encode_batch_fast(waiting, add_special_tokens=False)]
            np.add.at(counts, owner, lengths)  # noqa: B023
            waiting.clear()
            owner.clear()

        for row in range(batch.num_rows):
            if not n_bytes[row]:
                continue
            text = column[row].as_py()
            parts = safe_parts(text, most, special) if n_bytes[row] > most else [text]
            for part in parts:
                size = int(n_bytes[row]) if len(parts) == 1 else len(part.encode())
                if held and held + size > most:
                    flush()
                    held = 0
                waiting.append(part)
                owner.append(row)
                held += size
        if waiting:
            flush()
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n_bytes, pa.int64()), pa.array(counts), pa.array(counts > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Counts the tokens of every whole text of (doc_id long, text).

    ``vocabulary``: path of a tokenizers .json file on every executor. Special strings inside a text count as the
    library's default has it. One row comes back per input row, repeated rows included. A null or empty text has no
    bytes and no tokens; a null doc_id stays null; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches):
        return _encoded(batches, vocabulary, limit, batch_bytes)

    return docs.select("doc_id", "text").mapInArrow(run, OUT)
