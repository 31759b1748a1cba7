"""Token counts of documents from the piece counts of their distinct pre-tokens.

No piece of the vocabulary holds a space behind another character, so a merge
never crosses from a word into the spaces behind it: a text falls into
pre-tokens (a run of spaces and the word behind it) whose pieces can be counted
alone. Each task counts the pieces of every distinct pre-token once, joins the
counts to the frequencies of the pre-tokens in each document and sums; ids of a
document are never made. No row leaves its task, so nothing is shuffled and a
hot source or a group of copies costs no more than other rows.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame

from lumicurve.llm.common import in_batches, texts_of

#: The meta symbol that stands for a space in pieces.
SPACE_SYMBOL = "▁"
_RUNS = re.compile(" +[^ ]*")

#: Models that a worker has loaded, by path.
_COUNTERS: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Piece counts of pre-tokens under a sentencepiece BPE model.

    ``most`` bounds the counts kept between batches, ``longest`` the characters
    of a pre-token that is kept at all.
    """

    def __init__(self, model_path: str, most: int = 1_500_000, longest: int = 48):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.most, self.longest = most, longest
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        crossing = [p for p in pieces if re.search(f"[^{SPACE_SYMBOL}]{SPACE_SYMBOL}", p)]
        if crossing:
            raise ValueError(f"pieces cross a space, so words cannot be counted alone: {crossing[:3]}")
        self.counts: dict[str, int] = {}

    @classmethod
    def of(cls, model_path: str) -> "PieceCounter":
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = cls(model_path)
        return _COUNTERS[model_path]

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        """Pre-tokens without their first space; the model puts one before a text."""
        if not text:
            return []
        words = text.replace(SPACE_SYMBOL, " ").split(" ")
        if "" in words:
            words = [run[1:] for run in _RUNS.findall(" " + " ".join(words))]
        return words

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """Piece counts; the empty pre-token is a space alone, which is one piece."""
        return [len(ids) if word else 1 for word, ids in zip(pre_tokens, self.model.encode(pre_tokens, num_threads=1), strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        frequencies = [Counter(self.pre_tokens(t)) for t in texts]
        if len(self.counts) > self.most:
            self.counts.clear()
        counts = self.counts
        fresh = list(set().union(*frequencies).difference(counts))
        if fresh:
            counts.update(zip(fresh, self.pieces(fresh), strict=True))
        totals = [sum(map(mul, map(counts.__getitem__, f), f.values())) for f in frequencies]
        for word in fresh:
            if len(word) > self.longest:
                del counts[word]
        return totals


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Ids may
    be null or repeat, each row gets its own result; an empty table gives an
    empty result; other columns are not read, whatever their names.
    """

    def run(batches):
        counter = PieceCounter.of(model_path)
        for b in batches:
            texts = texts_of(b.column(1))
            tokens = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs, [id_col, text_col], run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
