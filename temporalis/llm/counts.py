"""Token counts of whole texts under a SentencePiece BPE model; only lengths leave the tasks.

The library encodes texts in batches of about equal bytes. A text longer than ``PIECE`` bytes
is cut first, at safe boundaries: between two characters that stand side by side in no piece
of the vocabulary. A merge across such a place would make a piece that holds both, so the
text's tokens are the chain of its parts' tokens. A part that doesn't begin its text is put
behind a ``_GUARD``, a character that no piece holds, whose own tokens are taken off again:
so the space that the model puts before every text can't join it. Where a text has no safe
boundary after a place, its part goes on, to its end if need be.

Nulls: a null text is empty and has no tokens. Every row is returned, repeated ones too; a
null doc_id stays null. Special strings in a text are text, as the library's default is.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import lean, ship

LIMIT = 4096
#: Bytes of a part of a long text, and of a batch that the library encodes at once.
PIECE = 1 << 16
BATCH = 1 << 18
_BAR = "▁"
_GUARD = "\n"
#: Probe of the model's normalizer: characters that other normalizers would change.
_PROBE = " ａ ﬁ  é\t\n　 "

_loaded: dict[str, Counter] = {}


class Counter:
    """A model, the pairs of characters that stand side by side in its pieces, and how many tokens a guard takes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        if model.normalize(_PROBE) != (_BAR + _PROBE).replace(" ", _BAR):
            raise ValueError(f"{path}: the model changes texts before it encodes them")
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(_GUARD in p for p in pieces):
            raise ValueError(f"{path}: a piece holds the guard")
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.guard = len(model.encode(_GUARD))

    def parts(self, text: str, piece: int) -> Iterator[str]:
        """The text in parts of at least so many characters, each but the first behind a guard."""
        seen, lo, n = text.replace(" ", _BAR), 0, len(text)
        while lo < n:
            hi = lo + piece
            while hi < n and seen[hi - 1 : hi + 1] in self.pairs:
                hi += 1
            yield (_GUARD if lo else "") + text[lo:hi]
            lo = hi

    def counts(self, texts: pa.Array, piece: int = PIECE, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of each text; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = np.zeros(len(texts), dtype=np.int64)
        total = int(size.sum())
        share = -(-total // max(1, -(-total // batch)))  # equal shares of at most about so many bytes
        rows: list[int] = []
        parts: list[str] = []
        behind: list[bool] = []
        held = 0

        def encode() -> None:
            found = self.model.encode(parts, out_type=int, num_threads=1)
            np.add.at(tokens, rows, np.array([len(ids) for ids in found]) - self.guard * np.array(behind))
            rows.clear(), parts.clear(), behind.clear()

        for i in np.flatnonzero(size).tolist():
            text = texts[i].as_py()
            for k, part in enumerate(self.parts(text, piece) if size[i] > piece else [text]):
                rows.append(i), parts.append(part), behind.append(k > 0)
                held += len(part) if size[i] > piece else int(size[i])
                if held >= share:
                    encode()
                    held = 0
        if parts:
            encode()
        return size, tokens


def counter(path: str) -> Counter:
    """One a worker process and path."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, piece: int = PIECE, batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than limit) of every row of docs (doc_id, text)."""
    ship(docs.sparkSession)

    def work(batches):
        model = counter(path)
        for b in batches:
            size, tokens = model.counts(b.column(1), piece, batch)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(work), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
