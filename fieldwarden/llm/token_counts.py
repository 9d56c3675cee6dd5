"""Token counts of a unigram tokenizer, without building the tokens."""

from __future__ import annotations

from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from fieldwarden.llm.common import WordTable, each_batch, text_bytes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
UNKNOWN = 10.0  # a character without piece scores this much below the worst piece
WORDS_KEPT = 2_000_000


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces and scores of a public vocabulary file, the unknown piece first."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Count-only Viterbi over the matches of all pieces.

    Ties as the unigram tokenizer has them: of equally good ways to a place the
    one whose last piece begins first is kept. A character that no piece stands
    for alone may be unknown; it then counts as its UTF-8 bytes.
    """

    def __init__(self, path: str):
        pieces = vocabulary(path)
        self.found = ahocorasick.Automaton()
        for piece, score in pieces:
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN
        # pieces hold blanks at their beginning only, so words can be taken one by one
        self.by_word = not any(BLANK in piece.lstrip(BLANK) for piece, _ in pieces)
        self.words = WordTable(WORDS_KEPT)

    def count(self, text: str) -> int:
        """Pieces of a text whose blanks are written as the tokenizer writes them."""
        best, pieces = [0.0] + [None] * len(text), [0] * (len(text) + 1)
        place, single = 0, False

        def close(end: int):
            # all matches up to here are known: the unknown character comes last
            if not single:
                score = best[end - 1] + self.unknown
                if best[end] is None or score > best[end]:
                    best[end] = score
                    pieces[end] = pieces[end - 1] + len(text[end - 1].encode())

        for last, (length, score) in self.found.iter(text):
            end = last + 1
            while place < end - 1:
                place += 1
                close(place)
                single = False
            score += best[end - length]
            if best[end] is None or score > best[end]:
                best[end], pieces[end] = score, pieces[end - length] + 1
            single = single or length == 1
        while place < len(text):
            place += 1
            close(place)
            single = False
        return pieces[-1]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a blank is put in front of a text that is not empty."""
        raw, bounds = text_bytes(texts)
        filled = bounds[:-1] < bounds[1:]
        raw = np.insert(raw, bounds[:-1][filled], 32)
        bounds = bounds + np.concatenate([[0], np.cumsum(filled)])
        # texts that hold the sign for a blank themselves, or a vocabulary that crosses blanks
        odd = np.zeros(len(raw) + 1, np.int64)
        sign = BLANK.encode()
        hit = (raw[:-2] == sign[0]) & (raw[1:-1] == sign[1]) & (raw[2:] == sign[2]) if len(raw) > 2 else []
        odd[1 : 1 + len(hit)] = np.cumsum(hit)
        odd[1 + len(hit) :] = odd[len(hit)]
        whole = (odd[bounds[1:]] > odd[bounds[:-1]]) | (not self.by_word)
        blank = raw == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[bounds[:-1][filled]] = True
        first = np.flatnonzero(first)
        end = np.append(first[1:], len(raw)) if len(first) else first
        doc = np.searchsorted(bounds, first, side="right") - 1
        easy = ~whole[doc]
        first, end, doc = first[easy], end[easy], doc[easy]
        numbers = self.words.look_up(
            raw, first, end, lambda words: [self.count(w.replace(" ", BLANK)) for w in words]
        )
        totals = np.bincount(doc, numbers, minlength=len(filled)).astype(np.int64)
        for k in np.flatnonzero(whole & filled).tolist():
            totals[k] = self.count(BLANK + texts[k].as_py().replace(" ", BLANK))
        return totals


@cache
def counter(path: str) -> Counter:
    """One per worker process and vocabulary."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs``.

    The tokenizer is the unigram model over the pieces and scores of the file,
    with byte fallback; blanks are written as U+2581 and one is put in front.
    Null and empty texts have no tokens. Rows of equal or null doc_id are
    counted each for itself; other columns are left out.
    """

    def run(batch):
        columns = [batch.column("doc_id"), pa.array(counter(path)(batch.column("text")))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return each_batch(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long")
