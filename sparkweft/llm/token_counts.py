"""Token counts by overlap resynchronisation.

A text of up to CHUNK characters is encoded whole. A longer one is encoded in chunks that overlap.
Both encodings of an overlap give boundaries between tokens as offsets, and the chunks are spliced
at an offset that both have and that is stable: no piece of the vocabulary holds a word mark after
another character, so no merge ever crosses the place before a word mark that follows another
character, and the encodings on either side don't depend on one another. An overlap without such a
place is doubled, up to the rest of the text.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, OVERLAP = 1 << 15, 256
#: The sign that this kind of vocabulary writes for a space, before the word.
MARK = "▁"
_models: dict[str, PieceModel] = {}


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Whether a word mark after another character always begins a token.
        self.stable = not any(MARK in p.lstrip(MARK) for p in pieces)

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """As many ids as the library gives for the whole text."""
        if len(text) <= chunk or not self.stable:
            return len(self.model.encode(text))
        return self._spliced(text.replace(" ", MARK), chunk, overlap)

    def _offsets(self, text: str) -> dict[int, int]:
        """Places between tokens, as UTF-8 bytes from the text's start, with the tokens before each."""
        found, at = {0: 0}, 0
        pieces = self.model.encode(text, out_type=str)
        add = len(MARK.encode()) if text else 0  # the mark that the library puts before a text
        for i, piece in enumerate(pieces):
            byte = len(piece) == 6 and piece.startswith("<0x") and self.model.is_byte(self.model.piece_to_id(piece))
            at += 1 if byte else len(piece.encode())
            found[at - add] = i + 1
        return found

    def _spliced(self, text: str, chunk: int, overlap: int) -> int:
        total = begin = 0
        while True:
            end, wide = begin + chunk, overlap
            if end + overlap >= len(text):
                return total + len(self.model.encode(text[begin:]))
            while True:
                # The next chunk starts at `end`; this one reaches `wide` beyond it.
                stop = min(len(text), end + wide)
                if stop == len(text):
                    return total + len(self.model.encode(text[begin:]))
                cut = self._common(text, begin, end, stop)
                if cut:
                    at, before = cut
                    total, begin = total + before, at + 1  # the mark comes back as the next chunk's own
                    break
                wide *= 2

    def _common(self, text: str, begin: int, end: int, stop: int) -> tuple[int, int] | None:
        """The first stable place in the overlap that both encodings have, with the tokens before it."""
        place = next((i for i in range(end + 1, stop - 1) if text[i] == MARK and text[i - 1] != MARK and text[i + 1] != MARK), None)
        if place is None:
            return None
        left = self._offsets(text[begin:stop])
        right = self._offsets(text[end:stop])
        a = left.get(len(text[begin:place].encode()))
        b = right.get(len(text[end:place].encode()))
        return None if a is None or b is None else (place, a)


def model(path: str) -> PieceModel:
    """The model, read once in each worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of docs.

    A null text counts as empty, and an empty one has no tokens. Rows with the same doc_id each
    give a row; a null doc_id stays null; other columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, texts = model(path).count, batch.column(1)
        whole = [t for t in texts.to_pylist()]
        short = [t for t in whole if len(t) <= CHUNK]
        lengths = iter([len(x) for x in model(path).model.encode(short, num_threads=1)])
        n = pa.array([next(lengths) if len(t) <= CHUNK else count(t) for t in whole], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = common.map_texts(common.text_columns(docs), work, f"doc_id {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
