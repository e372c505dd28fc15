"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations of the text.

A language is a probability for each piece of the vocabulary. The probability of a word is the sum, over all its
segmentations into pieces, of the products of their probabilities: a forward pass over the word's characters. Words (with
the vocabulary's mark of a word's start) are independent, so a text's score is the sum of its words' logarithms, and each
distinct word of an Arrow batch is scored once, all words of a length at a time.

Probabilities are learnt by expectation maximisation on a bounded sample: about ``rows`` training rows of each language
(those whose hash of the key is least) and of these the ``words`` most frequent words of each language. Everything else
covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obslab.llm.common import text_of, words_of
from obslab.llm.word_batches import words_of_batch

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
UNKNOWN = "und"
ROWS, WORDS, ROUNDS = 1500, 40_000, 3
#: Share of a character that no piece covers, and the count added to each piece.
RARE, ADDED = 1e-7, 0.02
#: Letters of a word that is learnt whole; a longer one is learnt in runs of as many.
LEARNT_LETTERS = 14
#: Steps after which the running sums are brought back near 1.
RESCALE = 16
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Languages:
    """Learnt languages, ascending, and the pieces' probabilities: a row for each piece, a column for each language."""

    names: list[str]
    table: np.ndarray
    path: str


@lru_cache(maxsize=1)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the vocabulary's pieces, their numbers, and the longest piece's length."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(found.get_piece_size()) if not (found.is_control(i) or found.is_unknown(i) or found.is_byte(i))]
    texts = [found.id_to_piece(i) for i in usable]
    hashes = np.array([text_hash(t) for t in texts], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.arange(len(usable))[order], max(map(len, texts))


def text_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c) + 1) % 2**64
    return h


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of each length: their places and their characters, a row for each word."""
    marked = [START + w for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        step = max(1, (1 << 18) // int(n))
        for at in range(0, len(places), step):
            own = places[at : at + step]
            raw = "".join(marked[i] for i in own).encode("utf-32-le", "surrogatepass")
            yield own, np.frombuffer(raw, "<u4").reshape(len(own), n)


def matches(path: str, letters: np.ndarray) -> list[np.ndarray]:
    """For each length l the number of the piece that ends after each character and is l long; -1 where there is none."""
    hashes, numbers, longest = pieces(path)
    codes, out = letters.astype(np.uint64) + np.uint64(1), []
    rolled, power = np.zeros_like(codes), np.uint64(1)
    for size in range(1, min(longest, codes.shape[1]) + 1):
        rolled = codes[:, : codes.shape[1] - size + 1] * power + (rolled[:, 1:] if size > 1 else 0)
        with np.errstate(over="ignore"):
            power = power * BASE
        at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
        out.append(np.where(hashes[at] == rolled, numbers[at], -1))
    return out


def forward(found: list[np.ndarray], n: int, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Summed probabilities of each beginning of the words (scaled), and the logarithms of the words' sums.

    ``table`` has a last row of zeros, for -1. A character that no piece covers alone has probability RARE.
    """
    rows, languages = len(found[0]), table.shape[1]
    sums, log = [np.ones((rows, languages))], np.zeros((rows, languages))
    for j in range(1, n + 1):
        total = np.zeros((rows, languages))
        for size in range(1, min(len(found), j) + 1):
            number = found[size - 1][:, j - size]
            if size == 1:
                total += sums[j - 1] * np.where((number < 0)[:, None], RARE, table[number])
            elif (number >= 0).any():
                total += sums[j - size] * table[number]
        sums.append(total)
        if j % RESCALE == 0 or j == n:
            scale = np.maximum(total, 1e-300)
            log += np.log(scale)
            for k in range(max(0, j - len(found)), j + 1):
                sums[k] = sums[k] / scale
    return sums, log


def word_scores(path: str, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Logarithm of each word's probability in each language."""
    out = np.zeros((len(words), table.shape[1]))
    for places, letters in by_length(words):
        out[places] = forward(matches(path, letters), letters.shape[1], table)[1]
    return out


def expected(path: str, p: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all segmentations of the words (at most LEARNT_LETTERS and a mark: no scaling is needed)."""
    counts = np.zeros(len(p))
    table = p[:, None]
    for places, letters in by_length(words):
        n, found, weight = letters.shape[1], matches(path, letters), weights[places]
        ahead = [np.ones(len(places))]
        for j in range(1, n + 1):
            ahead.append(sum(ahead[j - s] * step(found, s, j, table) for s in range(1, min(len(found), j) + 1)))
        behind = [None] * n + [np.ones(len(places))]
        for i in range(n - 1, -1, -1):
            behind[i] = sum(behind[i + s] * step(found, s, i + s, table) for s in range(1, min(len(found), n - i) + 1))
        scale = weight / ahead[n]
        for s in range(1, len(found) + 1):
            for j in range(s, n + 1):
                number = found[s - 1][:, j - s]
                hit = number >= 0
                counts += np.bincount(number[hit], (ahead[j - s] * p[number] * behind[j] * scale)[hit], len(p))
    return counts


def step(found: list[np.ndarray], size: int, end: int, table: np.ndarray) -> np.ndarray:
    number = found[size - 1][:, end - size]
    p = table[number, 0]
    return np.where(number < 0, RARE, p) if size == 1 else p


def learn_table(path: str, by_language: list[tuple[list[str], np.ndarray]]) -> np.ndarray:
    """Columns of piece probabilities, by rounds of expectation maximisation from equal ones; the last row is zero."""
    n, columns = len(pieces(path)[0]), []
    for words, weights in by_language:
        p = np.r_[np.full(n, 1 / n), 0]
        for _ in range(ROUNDS):
            counts = expected(path, p, words, weights)[:n] + ADDED
            p = np.r_[counts / counts.sum(), 0]
        columns.append(p)
    return np.stack(columns, axis=1) if columns else np.zeros((n + 1, 0))


def runs_of(word: Column) -> Column:
    """The word itself, or its consecutive runs of LEARNT_LETTERS letters if it is longer."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(word) - 1) / LEARNT_LETTERS).cast("int")),
        lambda i: F.substring(word, i * LEARNT_LETTERS + 1, F.lit(LEARNT_LETTERS)),
    )
    return F.when(F.length(word) > LEARNT_LETTERS, pieces).otherwise(F.array(word))


def learn(df: DataFrame, rows: int = ROWS, words: int = WORDS, path: str | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """Learn from the rows of ``df`` that have a language; ``rows`` and ``words`` of each language bound the sample."""
    labelled = df.select(key, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[lang]: r["n"] for r in labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    path = path or public_tokenizers.path(VOCABULARY)
    if not sizes:
        return Languages([], learn_table(path, []), path)
    names = sorted(sizes)
    share = F.element_at(F.create_map(*(x for s in names for x in (F.lit(s), F.lit(min(1.0, rows / sizes[s]))))), F.col(lang))
    place = F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(place < share).select(lang, F.explode(words_of(text_of(text))).alias("word"))
    counted = sample.select(lang, F.explode(runs_of(F.col("word"))).alias("word")).groupBy(lang, "word").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy(lang).orderBy(F.desc("n"), "word"))
    ranked = counted.withColumn("_rank", first).where(F.col("_rank") <= words).select(F.col(lang).alias("lang"), "word", "n")

    def learnt(own: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "word"], ascending=[False, True])
        column = learn_table(path, [(frame["word"].tolist(), frame["n"].to_numpy(float))])[:, 0]
        return pd.DataFrame({"lang": [own[0]], "p": [column.astype("<f8").tobytes()]})

    # A language's words, at most ``words``, are one group: languages learn beside each other in tasks.
    columns = {r["lang"]: np.frombuffer(r["p"], "<f8") for r in ranked.groupBy("lang").applyInPandas(learnt, "lang string, p binary").collect()}
    untaught = learn_table(path, [([], np.zeros(0))])[:, 0]
    return Languages(names, np.stack([columns.get(s, untaught) for s in names], axis=1), path)


def predict_batches(model: Languages, kind: pa.DataType, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = np.array([*model.names, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            best, share = np.full(batch.num_rows, len(model.names)), np.zeros(batch.num_rows)
            found = words_of_batch(texts)
            if model.names and len(found.codes):
                scores = word_scores(model.path, model.table, found.distinct.to_pylist())
                rows, total = found.rows(), np.zeros((batch.num_rows, len(model.names)))
                for k in range(total.shape[1]):
                    total[:, k] = np.bincount(rows, scores[found.codes, k], batch.num_rows)
                top = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                best, share = np.where(lettered, top, best), np.where(lettered, 1 / odds, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(kind), pa.array(names[best], pa.string()), pa.array(share, pa.float64())], names=[key, "lang_pred", "score"]
            )

    return run


def predict(df: DataFrame, model: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): the likeliest language of each row and its share of the likelihoods (ties: the first name).

    Null text and text without a letter are ``und`` with score 0, and so is everything if no language was learnt. Repeated
    rows are predicted each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    run = predict_batches(model, to_arrow_type(kind), key)
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, lang_pred string, score double")


def learn_and_predict(df: DataFrame, held_out: Column, key: str = "doc_id", **sample) -> DataFrame:
    return predict(df, learn(df.where(~held_out), key=key, **sample), key)
