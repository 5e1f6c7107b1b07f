"""Token counts of a unigram vocabulary: automaton matches and a Viterbi pass that carries counts only."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: what an unknown character scores below the lowest piece
CACHED_WORDS = 500_000  # words a task remembers before it starts anew
CACHED_CHARS = 64


def read_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public tokenizer's model file, control and unknown pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]


class Counter:
    """Counts the pieces of the best segmentation of a word, without building it."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.filled = len(self.automaton) > 0
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.seen: dict[str, tuple[int, float]] = {}

    def of(self, word: str) -> tuple[int, float]:
        """Pieces (an unknown character counts its UTF-8 bytes) and score of the best segmentation.

        Of segmentations of one score up to a place, the one whose last piece starts first wins, as
        in the tokenizer, which goes through the starts in order and replaces only what scores less. The automaton
        gives matches by their ends, and of one end the longest first, so one pass over them fills all places.
        """
        scores, counts, unknown = [0.0], [0], self.unknown
        at, best, count, single = 0, None, 0, False
        matches = self.automaton.iter(word) if self.filled else ()
        for last, (length, score) in (*matches, (len(word), (1, 0.0))):
            while at < last:
                if not single:  # no piece is this character alone
                    alone = scores[at] + unknown
                    if best is None or alone > best:
                        best, count = alone, counts[at] + len(word[at].encode())
                scores.append(best)
                counts.append(count)
                at, best, single = at + 1, None, False
            if last < len(word):
                total = scores[last + 1 - length] + score
                if best is None or total > best:
                    best, count = total, counts[last + 1 - length] + 1
                single = single or length == 1
        return counts[-1], scores[-1]

    def of_words(self, words: list[str]) -> list[tuple[int, float]]:
        """Of words without their marks, in order; each word that is not remembered is segmented once."""
        found = [*map(self.seen.get, words)]
        if None in found:
            if len(self.seen) >= CACHED_WORDS:
                self.seen.clear()
            fresh = {w: self.of(SPACE + w) for w in {w for w, f in zip(words, found, strict=True) if f is None}}
            found = [f or fresh[w] for w, f in zip(words, found, strict=True)]
            self.seen.update((w, f) for w, f in fresh.items() if len(w) <= CACHED_CHARS)
        return found


def count_tokens(docs: DataFrame, vocabulary: Sequence[tuple[str, float]], text: str = "text") -> DataFrame:
    """Adds n_tokens (long) and token_score (double) to each row.

    Spaces become word-start marks and a mark goes before the text, as the tokenizer does; each word
    runs from a mark to the next and is segmented apart. Null and empty texts have 0 tokens and score 0, repeated rows are
    counted each, texts of any length whole, and an empty table gives no rows.
    The vocabulary (a parameter, some ten thousand pieces) travels with the tasks; one automaton serves a
    Python worker. Columns of the same names are replaced.
    """
    pieces = list(vocabulary)

    @F.pandas_udf("n_tokens long, token_score double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(pieces)
        for batch in batches:
            rows = []
            for whole in batch:
                n, total = 0, 0.0
                if whole:
                    words = whole.replace(SPACE, " ").split(" ")
                    # a mark before the text, unless it starts with one
                    found = counter.of_words(words[1:] if words[0] == "" else words)
                    n, total = sum(f[0] for f in found), math.fsum(f[1] for f in found)
                rows.append((n, total))
            yield pd.DataFrame(rows, columns=["n_tokens", "token_score"])

    rest = [c for c in docs.columns if c not in ("n_tokens", "token_score")]
    return docs.select(*[docs[c] for c in rest], count(docs[text]).alias("#found")).select(*[f"`{c}`" for c in rest], "`#found`.*")
