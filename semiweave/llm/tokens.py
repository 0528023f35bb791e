"""Token counts of a unigram tokenizer by count-only Viterbi."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

SPACE = "▁"
#: A character that no piece covers costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words kept by a task; beyond it the store starts anew.
CACHE_WORDS = 400_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order from a sentencepiece model file.

    A unigram model's scores are its log probabilities. A BPE model has ranks
    instead, best first, and no probabilities; tokenizers aren't trained here,
    so a piece of rank r gets that of Zipf's law, log(1 / (r * H)) with H the
    sum of 1 / r. Control and unknown pieces get no share of it: their score
    is 0, as in the file.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    scores = [model.get_score(i) for i in range(n)]
    proto = pb.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    if proto.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM:
        ranked = sorted((i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))), key=lambda i: (-scores[i], i))
        whole = sum(1 / r for r in range(1, len(ranked) + 1))
        for r, i in enumerate(ranked, 1):
            scores[i] = -math.log(r * whole)
        # bytes stand in for what no piece covers; as pieces they are as rare as the rarest
        for i in range(n):
            if model.is_byte(i):
                scores[i] = -math.log(len(ranked) * whole)
    return [(model.id_to_piece(i), scores[i]) for i in range(n)]


class CountOnlyViterbi:
    """Best score and number of tokens of a word, without back pointers.

    The automaton gives all pieces ending at each character. best[i] and
    count[i] carry the best sum of scores of text[:i] and its number of tokens.
    Among equal scores the longest last piece wins, as it does in a tokenizer
    that fills positions from the left and replaces only by a larger score. A
    character without a piece of its own may be an unknown, which stands for
    its UTF-8 bytes, a token each; the fewest bytes are not sought, as in the
    tokenizer.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        pieces = {}
        for piece, score in vocabulary:
            pieces.setdefault(piece, score)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        # white space that is only ever a piece alone cuts words apart too
        self.cuts = [c for c in "\n\r\t\x0b\x0c" if not any(c in p for p in pieces)]
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(tokens, score) of a word with its leading SPACE."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        single, unknown = self.single, self.unknown
        at, top, tokens, longest = 0, None, 0, 0

        def close(at, top, tokens):
            if word[at] not in single:
                here = best[at] + unknown
                if top is None or here > top:
                    top, tokens = here, count[at] + len(word[at].encode("utf-8", "surrogatepass"))
            best[at + 1], count[at + 1] = top, tokens

        for end, (length, score) in self.automaton.iter(word):
            while at < end:
                close(at, top, tokens)
                at, top = at + 1, None
            start = end + 1 - length
            here = best[start] + score
            if top is None or here > top or here == top and length > longest:
                top, tokens, longest = here, count[start] + 1, length
        while at < n:
            close(at, top, tokens)
            at, top = at + 1, None
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """(tokens, score) of a whole text.

        A space is written SPACE and starts a word; SPACE is put before a text
        that doesn't start with it.
        """
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        words = text.split(SPACE)
        if not words[0]:
            del words[0]
        tokens, score, cache, cuts = 0, 0.0, self.cache, self.cuts
        for w in words:
            got = cache.get(w)
            if got is None:
                got = self._cut(SPACE + w, cuts)
                if len(w) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = got
            tokens += got[0]
            score += got[1]
        return tokens, score

    def _cut(self, word: str, cuts: list[str]) -> tuple[int, float]:
        """word, cut where a character is always a token of its own."""
        for k, c in enumerate(cuts):
            if c in word:
                parts = word.split(c)
                got = [self._cut(p, cuts[k + 1 :]) if p else (0, 0.0) for p in parts]
                return sum(g[0] for g in got) + len(parts) - 1, sum(g[1] for g in got) + (len(parts) - 1) * self.unknown
        return self.word(word)


#: The automaton of this Python worker, by the vocabulary it was built from.
_built: dict[str, CountOnlyViterbi] = {}


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """docs with n_tokens (long) and score (double), the sum of its pieces' scores.

    The vocabulary, whose size a model file fixes (load_vocabulary), is
    broadcast; each Python worker builds its automaton once and keeps the
    counts of up to CACHE_WORDS words, so memory is bounded. Whole texts are
    counted, a text in one row however long. Null or empty text has 0 tokens
    and score 0; input columns n_tokens and score are replaced; rows, ties and
    other columns pass through.
    """
    bounded_batches(docs.sparkSession)
    shipped, name = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())]))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _built:
            _built.clear()
            _built[name] = CountOnlyViterbi(shipped.value)
        model = _built[name]
        for texts in batches:
            yield pd.DataFrame([model.text(t) for t in texts], columns=["n", "s"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "score")]
    found = docs.select(*kept, counted(F.col("text")).alias("found_"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "score")], F.col("found_.n").alias("n_tokens"), F.col("found_.s").alias("score"))
