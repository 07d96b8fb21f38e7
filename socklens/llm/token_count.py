"""Word-piece token counts by a linear longest-match automaton.

Greedy longest match cuts a word into the longest vocabulary piece it begins
with, then the longest piece that goes on, and so forth; a word that cannot be
cut to its end is one unknown token. The automaton reads every character once:
a trie of the first pieces and one of the continuing pieces, where a state that
has no transition falls back to the state reached after cutting off the pieces
that greedy matching would cut off (failure link), while the number of these
pieces, known beforehand, is added to the count (popped tokens). No piece is
ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

MARK = "▁"  # begins the pieces that begin a word
MOST_WORDS = 300_000


class LongestMatch:
    """Counts greedy pieces of a word.

    ``pieces`` that begin with ``MARK`` can begin a word, the others continue
    one; a word is read with ``MARK`` in front, so the mark alone is a piece
    that may stand before any continuation.
    """

    def __init__(self, pieces: list[str]):
        pieces = {p for p in pieces if p}
        self.first, self.rest = 0, 1
        self.step: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        self.final: list[bool] = [False, False]
        for piece in pieces:
            self._add(self.first if piece.startswith(MARK) else self.rest, piece)
        self._link()

    def _add(self, state: int, piece: str) -> None:
        for letter in piece:
            follow = self.step[state].get(letter)
            if follow is None:
                follow = self.step[state][letter] = len(self.step)
                self.step.append({})
                self.fail.append(-1)
                self.popped.append(0)
                self.final.append(False)
            state = follow
        self.final[state] = True

    def _link(self) -> None:
        """Failure links and popped counts, in order of depth: a link leads to a shallower state of the second trie."""
        waiting = deque([self.first, self.rest])
        while waiting:
            state = waiting.popleft()
            for letter, follow in self.step[state].items():
                if self.final[follow]:
                    self.fail[follow], self.popped[follow] = self.rest, 1
                else:
                    back, popped = self.fail[state], self.popped[state]
                    while back != -1 and letter not in self.step[back]:
                        popped += self.popped[back]
                        back = self.fail[back]
                    if back != -1:
                        self.fail[follow], self.popped[follow] = self.step[back][letter], popped
                waiting.append(follow)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it cannot be cut to its end."""
        step, fail, popped = self.step, self.fail, self.popped
        state, count = self.first, 0
        for letter in MARK + word:
            while letter not in step[state]:
                count += popped[state]
                state = fail[state]
                if state == -1:
                    return 0
            state = step[state][letter]
        while state != self.rest:
            count += popped[state]
            state = fail[state]
            if state == -1:
                return 0
        return count


def piece_list(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


class WordCounts(dict):
    """Pieces of a word, by the automaton where not known; forgets beyond ``MOST_WORDS`` words."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        n = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counts(path: str) -> WordCounts:
    return WordCounts(LongestMatch(piece_list(path)))


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_tokens`` and ``n_unknown`` (long) of every whole text.

    Words are the runs between white space. A word that cannot be cut counts as
    one token and as unknown. A null or empty text, or one of white space, has
    none of either. Rows and their other columns stay, columns named like the
    added ones are replaced; no rows give none. ``path`` is a sentencepiece
    model on every executor. No shuffle; very long words take linear time.
    """
    names = ["n_words", "n_tokens", "n_unknown"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts(path).__getitem__
        for batch in batches:
            words, tokens, unknown = [], [], []
            for value in batch.column(at).to_pylist():
                counts = list(map(known, (value or "").split()))
                bad = counts.count(0)
                words.append(len(counts))
                tokens.append(sum(counts) + bad)
                unknown.append(bad)
            added = [pa.array(a, pa.int64()) for a in (words, tokens, unknown)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
