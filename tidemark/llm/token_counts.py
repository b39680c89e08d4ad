"""Token counts (7): how many pieces a unigram tokenizer makes of a text, without making them.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each character; a Viterbi pass
carries, for each position, the best score and the number of pieces on that path, and nothing else. The rules are
those of the tokenizers library's Unigram model: a path replaces another only if its score is strictly higher,
where the candidates for an end are tried from the earliest start; a character that is no piece costs the lowest
score less 10 and counts as its UTF-8 bytes (byte fallback); spaces become U+2581 and one is put before the text.

No piece joins a character to a later U+2581, and no piece but the character itself holds a control character, so
a text falls apart there and each distinct part is counted once per worker. Scores that are whole numbers add up
exactly in any order; the result is then the same to the last bit as over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.words import slices
from tidemark.session import table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts whose counts a worker remembers; the memory is emptied when it is full.
CACHE_PARTS = 500_000
#: Between parts; no text is cut at it, as texts that hold it are counted whole.
CUT = "\x00"


class CountOnlyViterbi:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.longest = max(len(p) for p, _ in vocabulary)
        best: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                best[piece] = float(score)
        for piece, score in best.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.single = {p for p in best if len(p) == 1}
        self.cuts_spaces = not any(SPACE in p.lstrip(SPACE) for p in best)
        self.cuts_controls = not any(len(p) > 1 and any(c in p for c in "\t\n\x0b\x0c\r") for p in best)
        self.cache: dict[str, tuple[float, int, int]] = {}

    def count(self, part: str) -> tuple[float, int, int]:
        """Best score, pieces on that path, and characters on it that are no piece."""
        n, none = len(part), float("-inf")
        score, pieces, unknown = [none] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        done = 0  # positions up to here have their final values

        def alone(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                c = part[done - 1]
                if c not in self.single and score[done - 1] + self.unknown > score[done]:
                    score[done] = score[done - 1] + self.unknown
                    pieces[done] = pieces[done - 1] + len(c.encode("utf-8", "surrogatepass"))
                    unknown[done] = unknown[done - 1] + 1

        end = -1
        waiting: list[tuple[int, float]] = []

        def settle() -> None:
            for length, s in sorted(waiting, reverse=True):  # the earliest start first
                start = end + 1 - length
                if score[start] + s > score[end + 1]:
                    score[end + 1] = score[start] + s
                    pieces[end + 1] = pieces[start] + 1
                    unknown[end + 1] = unknown[start]
            waiting.clear()

        for at, found in self.automaton.iter(part):
            if at != end:
                if waiting:
                    alone(end)
                    settle()
                end = at
            waiting.append(found)
        if waiting:
            alone(end)
            settle()
        alone(n)
        return score[n], pieces[n], unknown[n]

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, pieces and unknown characters of whole texts (null: empty, which has no pieces)."""
        texts = pc.fill_null(texts, "")
        spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), ""))
        whole = np.asarray(pc.match_substring(texts, CUT))
        marked = spaced
        if self.cuts_spaces:
            marked = pc.replace_substring_regex(marked, f"({SPACE}+)", f"{CUT}\\1")
        if self.cuts_controls:
            marked = pc.replace_substring_regex(marked, "([\t\n\x0b\x0c\r])", f"{CUT}\\1{CUT}")
        marked = pc.if_else(pa.array(whole), "", marked)
        parts = pc.split_pattern(marked, CUT)
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        encoded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        if len(self.cache) > CACHE_PARTS:
            self.cache.clear()
        known = []
        for part in encoded.dictionary.to_pylist():
            found = self.cache.get(part)
            if found is None:
                found = self.cache[part] = self.count(part)
            known.append(found)
        values = np.array(known or [(0.0, 0, 0)], dtype=np.float64)[np.asarray(encoded.indices, dtype=np.int64)]
        before = np.zeros((len(values) + 1, 3))
        np.cumsum(values, axis=0, out=before[1:])
        sums = np.diff(before[offsets - offsets[0]], axis=0)
        for i in np.nonzero(whole)[0]:
            sums[i] = self.count(spaced[int(i)].as_py())
        return sums[:, 0], sums[:, 1].astype(np.int64), sums[:, 2].astype(np.int64)


def vocabulary_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


_models: dict[str, CountOnlyViterbi] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score and n_unknown of each row of `docs` (doc_id, text).

    A null or empty text has no tokens and score 0; repeated rows and null ids stay as they are; other columns are
    ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _models:
            _models[path] = CountOnlyViterbi(vocabulary_of(path))
        model = _models[path]
        for batch in slices(batches):
            score, pieces, unknown = model.counts(batch.column("text"))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(pieces), pa.array(score), pa.array(unknown)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "score", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double, n_unknown long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_path())
