"""Language identification with segmentation-marginalised unigrams.

A language is a unigram model over the pieces of a fixed public vocabulary. A word's probability is
the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product
over its words. Piece probabilities are fitted by expectation maximisation (forward-backward over
the same segmentations). Every piece that a lower-cased word can hold is used, whatever its length,
and so is every word, whatever its length; a long word goes through the lattice in stretches.

The fit takes a bounded sample of labelled rows: of the ``LANGUAGES`` commonest languages at most
``FIT_DOCS`` rows each, those with the smallest row hashes, and of these no more than begin within
the first ``FIT_LETTERS`` characters. Scoring covers whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import pieces

FIT_DOCS, FIT_LETTERS, LANGUAGES = 600, 1 << 23, 256
FIT_ROUNDS = 3
#: Added to every piece's expected count.
SMOOTHING = 0.02
#: Probability of a letter that is no piece, for every language.
OTHER_LETTER = 1e-7
#: Bytes of word scores that a worker remembers, letters of a batch of words, letters of a stretch of a long word.
CACHE_BYTES, BATCH_LETTERS, STRETCH = 1 << 24, 1 << 16, 1 << 12
UNKNOWN = "und"
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")


class Vocabulary:
    """Pieces that lower-cased words can hold, numbered by name, with all their beginnings."""

    def __init__(self, names: list[str]):
        self.names = sorted(set(names))
        self.width = max(map(len, self.names), default=1)
        self.beginnings: dict[str, int] = {}
        for name in self.names:
            for end in range(1, len(name)):
                self.beginnings.setdefault(name[:end], -1)
        for k, name in enumerate(self.names):
            self.beginnings[name] = k

    def __len__(self) -> int:
        return len(self.names)


def vocabulary(path: str | None = None) -> Vocabulary:
    """The pieces of a sentencepiece model file that are made of letters without capitals."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return Vocabulary([p for p in names if p == p.lower() and LETTERS.fullmatch(p.removeprefix(START) or "a")])


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if no character is a letter."""
    words = LETTERS.findall((text or "").lower())
    if words and not any(w.isascii() or any(map(str.isalpha, w)) for w in words):
        return []
    return words


def arcs(words: list[str], known: Vocabulary) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """The lattice of some words: (end, rows of words, numbers of pieces, length) by end and length.

    A letter that is no piece by itself has the number len(known); so every position is reached.
    """
    get, other, width = known.beginnings.get, len(known), known.width
    ends, sizes, rows, ids = [], [], [], []
    for row, word in enumerate(words):
        word = START + word
        n = len(word)
        for at in range(n):
            alone = False
            for end in range(at + 1, min(n, at + width) + 1):
                k = get(word[at:end])
                if k is None:
                    break
                if k >= 0:
                    alone |= end == at + 1
                    ends.append(end)
                    sizes.append(end - at)
                    rows.append(row)
                    ids.append(k)
            if not alone:
                ends.append(at + 1)
                sizes.append(1)
                rows.append(row)
                ids.append(other)
    end, size, row, piece = (np.array(x, np.int32) for x in (ends, sizes, rows, ids))
    order = np.lexsort((row, size, end))
    end, size, row, piece = end[order], size[order], row[order], piece[order]
    cuts = np.flatnonzero((end[1:] != end[:-1]) | (size[1:] != size[:-1])) + 1
    bounds = [0, *cuts.tolist(), len(end)]
    return [(int(end[a]), row[a:b], piece[a:b], int(size[a])) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def forward(words: list[str], known: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Log probabilities (word, language) of words. ``probs``: (piece, language), the last row for other letters."""
    logs, width = np.log(probs), max(map(len, words), default=0) + 1
    alpha = np.full((width + 1, len(words), probs.shape[1]), -np.inf)
    alpha[0] = 0.0
    for end, row, piece, size in arcs(words, known):
        alpha[end, row] = np.logaddexp(alpha[end, row], alpha[end - size, row] + logs[piece])
    return alpha[[len(w) + 1 for w in words], np.arange(len(words))]


def long_forward(word: str, known: Vocabulary, probs: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """``forward`` of one word of any length, in memory for a stretch of it."""
    logs, letters, carry = np.log(probs), START + word, np.zeros((1, probs.shape[1]))
    get, other = known.beginnings.get, len(known)
    for first in range(0, len(letters), stretch):
        last = min(first + stretch, len(letters))
        base = first - len(carry) + 1
        alpha = np.full((last - base + 1, probs.shape[1]), -np.inf)
        alpha[: len(carry)] = carry
        for at in range(base, last):
            now, alone = alpha[at - base], False
            for end in range(at + 1, min(last, at + known.width) + 1):
                k = get(letters[at:end])
                if k is None:
                    break
                if k >= 0:
                    alone |= end == at + 1
                    if end > first:
                        alpha[end - base] = np.logaddexp(alpha[end - base], now + logs[k])
            if not alone and at + 1 > first:
                alpha[at + 1 - base] = np.logaddexp(alpha[at + 1 - base], now + logs[other])
        carry = alpha[-known.width :]
    return carry[-1]


def _batches(words: list[str]) -> Iterator[list[int]]:
    """Numbers of ``words`` by length, in batches whose lattices have about ``BATCH_LETTERS`` positions; a word over ``STRETCH`` is alone."""
    batch: list[int] = []
    for k in sorted(range(len(words)), key=lambda k: len(words[k])):
        if batch and ((len(batch) + 1) * (len(words[k]) + 2) > BATCH_LETTERS or len(words[k]) > STRETCH):
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def fit_pieces(words: list[str], counts: np.ndarray, known: Vocabulary, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its words, by expectation maximisation over all segmentations."""
    n = len(known)
    probs = np.full(n + 1, 1.0 / max(n, 1))
    probs[n] = OTHER_LETTER
    batches = [([len(words[k]) + 1 for k in some], counts[some], arcs([words[k] for k in some], known)) for some in _batches(words)]
    for _ in range(rounds):
        expected, logs = np.zeros(n + 1), np.log(probs)
        for ends, times, lattice in batches:
            own, width = np.arange(len(ends)), max(ends)
            alpha, beta = np.full((2, width + 1, len(ends)), -np.inf)
            alpha[0], beta[ends, own] = 0.0, 0.0
            for end, row, piece, size in lattice:
                alpha[end, row] = np.logaddexp(alpha[end, row], alpha[end - size, row] + logs[piece])
            whole = alpha[ends, own]
            for end, row, piece, size in reversed(lattice):
                rest = logs[piece] + beta[end, row]
                np.add.at(expected, piece, np.exp(alpha[end - size, row] + rest - whole[row]) * times[row])
                beta[end - size, row] = np.logaddexp(beta[end - size, row], rest)
        smooth = expected[:n] + SMOOTHING
        probs = np.append(smooth / smooth.sum(), OTHER_LETTER)
    return probs


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, vocab: Vocabulary, fit_docs: int = FIT_DOCS, fit_letters: int = FIT_LETTERS, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their piece probabilities (piece, language), from labelled rows that aren't held out.

    The sample is bounded by the parameters: the ``languages`` with most labelled rows (the first by
    name of equals), ``fit_docs`` different rows of each, and texts that begin within ``fit_letters``
    characters of a language's sample.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "lang", "text").alias("key"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()}
    if not sizes:
        return [], np.zeros((len(vocab) + 1, 0))
    # keys are uniform: below this bound are about four times the rows wanted, so little is ranked
    most = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, (1 << 63) - 1 if n <= 8 * fit_docs else int(-(1 << 63) + (1 << 64) * (4 * fit_docs / n)))])
    some = rows.where(F.col("key") <= most[F.col("lang")])
    by_key = Window.partitionBy("lang").orderBy("key")
    before = F.coalesce(F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = some.groupBy("lang", "key").agg(F.max(F.length("text")).cast("long").alias("size")).select("lang", "key", F.row_number().over(by_key).alias("rank"), before.alias("before"))
    keys = keys.where((F.col("rank") <= fit_docs) & (F.col("before") < fit_letters)).select("lang", "key")
    picked = some.join(keys, ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in words_of(text):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    def model(key: tuple[str], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("word")
        probs = fit_pieces(part["word"].tolist(), part["n"].to_numpy(float), vocab)
        return pd.DataFrame({"lang": [key[0]], "probs": [probs.astype("<f8").tobytes()]})

    counted = picked.select("lang", "text").mapInArrow(words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    models = {r["lang"]: np.frombuffer(bytes(r["probs"]), "<f8") for r in counted.groupBy("lang").applyInPandas(model, "lang string, probs binary").collect()}
    langs = sorted(models)
    return langs, np.stack([models[x] for x in langs], axis=1) if langs else np.zeros((len(vocab) + 1, 0))


class Scorer:
    """Scores texts in all languages and remembers the words it has seen."""

    def __init__(self, vocab: Vocabulary, probs: np.ndarray):
        self._vocab, self._probs = vocab, probs
        self._most = max(1 << 10, CACHE_BYTES // (8 * max(1, probs.shape[1])))
        self._rows: dict[str, int] = {}
        self._table = np.zeros((1 << 10, probs.shape[1]))

    def _learn(self, words: list[str]) -> None:
        if len(self._rows) + len(words) > self._most:
            self._rows, self._table = {}, np.zeros((max(1 << 10, len(words)), self._probs.shape[1]))
        n = len(self._rows)
        if n + len(words) > len(self._table):
            self._table = np.vstack([self._table, np.zeros((max(len(self._table), len(words)), self._table.shape[1]))])
        for some in _batches(words):
            own = [words[k] for k in some]
            long = len(own) == 1 and len(own[0]) > STRETCH
            self._table[n : n + len(own)] = long_forward(own[0], self._vocab, self._probs) if long else forward(own, self._vocab, self._probs)
            self._rows.update(zip(own, range(n, n + len(own)), strict=True))
            n += len(own)

    def score(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log probabilities of each text by language; None where there is no letter."""
        out = []
        for some in pieces([t or "" for t in texts]):
            split = [words_of(texts[k]) for k in some]
            here = set().union(*split)
            new = [w for w in here if w not in self._rows]
            if new:
                self._learn(new)
                if any(w not in self._rows for w in here):
                    self._learn([w for w in here if w not in self._rows])
            rows = self._rows
            out += [self._table[[rows[w] for w in words]].sum(axis=0) if words else None for words in split]
        return out


_scorers: dict[bytes, Scorer] = {}


def scorer_of(vocab: Vocabulary, probs: np.ndarray) -> Scorer:
    """The worker's scorer for that model, kept from task to task."""
    key = hashlib.sha256(probs.tobytes()).digest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(vocab, probs)
    return _scorers[key]


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab: Vocabulary) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text).

    ``score`` is the posterior probability of the predicted language under equal priors. A text
    that is null or has no letter is ``und`` with score 0, as is every text if no labelled row was
    there to learn from; ties go to the first language by name; repeated rows each get the same
    result; an empty table gives an empty result. Texts and words of any length are scored whole.
    """
    langs, probs = model
    sent = docs.sparkSession.sparkContext.broadcast((vocab, probs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(*sent.value)
        for batch in batches:
            scores = scorer.score(batch.column(2).to_pylist()) if langs else [None] * batch.num_rows
            best, sure = [], []
            for x in scores:
                if x is None:
                    best.append(UNKNOWN)
                    sure.append(0.0)
                else:
                    k = int(x.argmax())
                    best.append(langs[k])
                    sure.append(float(1.0 / np.exp(x - x[k]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, vocab_path: str | None = None, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Fits on labelled rows of ``docs`` (doc_id, text, lang) that aren't held out; predicts all rows."""
    vocab = vocabulary(vocab_path)
    return predicted(docs, fit(docs, vocab, fit_docs), vocab)


def identified_documents(docs: DataFrame, least_score: float = 0.5, vocab_path: str | None = None, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The rows of ``docs`` whose language is told with ``least_score`` or more, with all their columns.

    Texts that are null or have no letter go; the languages are those of the labelled rows.
    """
    vocab = vocabulary(vocab_path)
    langs, probs = fit(docs, vocab, fit_docs)
    sent = docs.sparkSession.sparkContext.broadcast((vocab, probs))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(*sent.value)
        for batch in batches:
            scores = scorer.score(batch.column(place).to_pylist()) if langs else [None] * batch.num_rows
            keep = [x is not None and 1.0 / np.exp(x - x.max()).sum() >= least_score for x in scores]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
