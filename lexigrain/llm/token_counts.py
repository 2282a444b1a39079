"""Token counts with overlap resynchronisation for huge documents.

A merge tokenizer needs the whole text, whose memory grows with it. A huge text is
encoded in overlapping chunks with offsets. Two encodings of an overlap agree from
some place on; they are spliced at a boundary that both have and that is proven
stable: no piece of the vocabulary has a space after another character, so no merge
ever crosses the place before a space that follows a character. If an overlap has no
such boundary with equal pieces around it, it is widened, up to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructType

from lexigrain.llm.common import small_batches, texts_of

CHUNK = 1 << 16  # bytes of a chunk; texts of up to so many characters are encoded whole
OVERLAP = 1 << 9
LIMIT = 4096  # tokens of a model's context
SPACE = "▁"


def after_character(data: bytes, at: int) -> bool:
    """Whether a character other than a space, in either spelling, stands before a place."""
    return data[at - 1] != 32 and data[max(at - 3, 0):at] != SPACE.encode()


class Pieces:
    """A sentencepiece model that counts tokens of texts of any length."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        words = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # without this proof no boundary is stable, and texts are encoded whole
        self.proven = not any(before != SPACE and after == SPACE for piece in words
                              for before, after in zip(piece, piece[1:], strict=False))
        # the model must leave the text as it is, or offsets would not be those of the text
        probe = "a  éﬁ① b\n c "
        self.proven &= self.model.decode(self.model.encode(probe)) == probe

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.chunk or not self.proven]
        found = iter(self.model.encode(short, num_threads=1)) if short else iter(())
        return [len(next(found)) if len(t) <= self.chunk or not self.proven
                else self.count_long(t) for t in texts]

    def offsets(self, data: bytes, start: int, stop: int) -> list[tuple[int, int]]:
        """The (begin in the text, id) of each token of ``data[start:stop]``, in bytes.

        A chunk within the text starts at a space; the model puts one before every
        text, so the chunk is given without it.
        """
        shift = start + (start > 0)
        pieces = self.model.encode(data[shift:stop].decode(), return_type="proto").pieces
        found = [(shift + piece.begin, piece.id) for piece in pieces]
        if start and found:
            found[0] = (start, found[0][1])
        return found

    def count_long(self, text: str) -> int:
        """Count by chunks that are spliced in their overlaps."""
        data = text.encode()
        total, start, width = 0, 0, self.overlap
        stop = self.cut(data, self.chunk)
        left = self.offsets(data, 0, stop)
        while stop < len(data):
            place, ahead, right = None, stop, []
            while place is None:
                begin = self.start_of_overlap(data, stop - width, start)
                if begin is None:
                    break
                ahead = self.cut(data, begin + max(self.chunk, 2 * width))
                right = self.offsets(data, begin, ahead)
                place = self.boundary(data, left, right, begin, stop)
                width *= 2
            if place is None:  # no boundary back to the start: a longer left part
                stop = self.cut(data, start + 2 * (stop - start))
                left = self.offsets(data, start, stop)
            else:
                total += sum(at < place for at, _ in left)
                left = [token for token in right if token[0] >= place]
                start, stop = place, ahead
            width = self.overlap
        return total + len(left)

    @staticmethod
    def cut(data: bytes, wanted: int) -> int:
        """The start of a character at or after ``wanted``."""
        while wanted < len(data) and data[wanted] & 0xC0 == 0x80:
            wanted += 1
        return min(wanted, len(data))

    @staticmethod
    def start_of_overlap(data: bytes, wanted: int, start: int) -> int | None:
        """A single space between other characters, at or before ``wanted``, after ``start``."""
        at = wanted + 1
        while True:
            at = data.rfind(b" ", start + 1, max(at, start + 1))
            if at < 0:
                return None
            if after_character(data, at) and data[at + 1:at + 2] not in (b"", b" "):
                return at

    @staticmethod
    def boundary(data: bytes, left: list[tuple[int, int]], right: list[tuple[int, int]],
                 begin: int, stop: int) -> int | None:
        """The last proven boundary in the overlap with equal tokens on both sides of it.

        The left part ends somewhere in a word, so the boundary must come before its
        last space.
        """
        last = data.rfind(b" ", begin, stop)
        ours = {at: i for i, (at, _) in enumerate(left) if begin <= at < last}
        for j in range(len(right) - 1, 0, -1):
            at = right[j][0]
            i = ours.get(at)
            if (i and data[at] == 32 and after_character(data, at)
                    and left[i] == right[j] and left[i - 1] == right[j - 1]):
                return at
        return None


_models: dict[tuple, Pieces] = {}


def model(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Pieces:
    """The model of this worker process; it outlives a task."""
    key = (path, chunk, overlap)
    if key not in _models:
        _models[key] = Pieces(*key)
    return _models[key]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", chunk: int = CHUNK,
                 overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is the path of a sentencepiece model. Null counts as the empty text:
    no bytes, no tokens. Columns of the input with these names are replaced. Each row
    is counted by itself and there is no shuffle.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]
    kept = docs.drop(*names)
    wide = (StructType(list(kept.schema.fields)).add("n_bytes", LongType())
            .add("n_tokens", LongType()).add("over_limit", BooleanType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(tokenizer, chunk, overlap)
        for batch in small_batches(batches, text):
            texts = texts_of(batch, text)
            counts = pieces.counts(texts)
            added = [pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(counts, pa.int64()),
                     pa.array([c > limit for c in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added],
                                             [*batch.schema.names, *names])

    return kept.mapInArrow(run, wide)
