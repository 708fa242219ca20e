"""Shape statistics and normalised forms of recognised text, as Columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space by Unicode, the terms of a bank statement, and the folded letters.
SPACE = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
VOCABULARY = ("IBAN", "BIC", "TITULAIRE", "INTITULE", "COMPTE", "BANQUE", "GUICHET", "DOMICILIATION", "RELEVE", "IDENTITE", "AGENCE", "CLE")
LOWER_ACCENTS, LOWER_FOLDED = "éèêëàâäîïôöùûüç", "EEEEAAAIIOOUUUC"
UPPER_ACCENTS, UPPER_FOLDED = "ÉÈÊËÀÂÄÎÏÔÖÙÛÜÇ", "EEEEAAAIIOOUUUC"
ASCII_LOWER, ASCII_UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words between runs of white space."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")


def folded(text: Column) -> Column:
    """Capitals without accents for ASCII and lower-case accented letters; other capitals stay."""
    return F.translate(text, ASCII_LOWER + LOWER_ACCENTS, ASCII_UPPER + LOWER_FOLDED)


#: Bytes of text profiled at a time (a longer text goes alone).
CHUNK = 1 << 18
_STATS = "lines int, words int, chars int, digits int, alphas int, symbols int, short_lines int, single_char_words int, mixed_words int, vocabulary_hits int, has_iban_prefix boolean, has_postal_code boolean"
_IBAN_PREFIX = re.compile("FR[0-9][0-9]")


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: bits for white space (1), ASCII digit (2), letter (4) and other number (8); and the folded character."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds, fold = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype="<u4")
    for bit, pattern in ((1, f"[{SPACE}]"), (2, "[0-9]"), (4, r"\p{Alphabetic}"), (8, r"\p{N}")):
        found = np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")
        kinds[found] |= bit
    fold[[ord(c) for c in ASCII_LOWER + LOWER_ACCENTS]] = [ord(c) for c in ASCII_UPPER + LOWER_FOLDED]
    return kinds, fold


def _capital(x: np.ndarray) -> np.ndarray:
    return (x >= 65) & (x <= 90)


def profile(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of ``text_stats`` for some texts, over their code points as one array."""
    kinds, fold = _classes()
    code = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "replace"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], ends[:-1]])
    kind, up = kinds[code], fold[code]
    per_text = lambda mask: np.add.reduceat(mask, first, dtype=np.int64)
    space, digit, letter = kind & 1 > 0, kind & 2 > 0, kind & 4 > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, stops = edges[::2], edges[1::2]  # each text ends with a line break, so every word ends
    of_word = np.searchsorted(ends, starts, side="right")
    count = lambda some: np.bincount(of_word[some], minlength=len(texts))
    length = stops - starts
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    digits_upto, letters_upto = upto(digit), upto(letter)
    digits = digits_upto[stops] - digits_upto[starts]
    mixed = np.flatnonzero((length >= 3) & (digits > 0) & (letters_upto[stops] > letters_upto[starts]))
    head = lambda some, k: np.where(length[some] > k, np.where((c := code[np.minimum(starts[some] + k, len(code) - 1)]) - 97 < 26, c - 32, c), 0)
    h = [head(mixed, k) for k in range(6)]
    iban = (h[0] == 70) & (h[1] == 82) & (h[2] - 48 < 10) & (h[3] - 48 < 10)
    bic = _capital(h[0]) & _capital(h[1]) & _capital(h[2]) & _capital(h[3]) & (h[4] == 70) & (h[5] == 82)
    postal = np.flatnonzero((length == 5) & (digits == 5))
    postal = postal[postal + 1 < len(starts)]
    after = postal + 1
    pair = (of_word[after] == of_word[postal]) & (length[after] > 1) & _capital(up[starts[after]]) & _capital(up[np.minimum(starts[after] + 1, len(up) - 1)])
    breaks = np.flatnonzero(code == 10)
    line_first = np.searchsorted(starts, np.concatenate([[0], breaks[:-1] + 1]))
    line_last = np.searchsorted(starts, breaks) - 1
    full = np.flatnonzero(line_last >= line_first)
    of_line = np.searchsorted(ends, breaks[full], side="right")
    short = stops[line_last[full]] - starts[line_first[full]] < 3
    folded_text = up.astype("<u4").tobytes().decode("utf-32-le")
    folded_texts = [folded_text[a : b - 1] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    return {
        "lines": np.bincount(of_line, minlength=len(texts)),
        "words": np.bincount(of_word, minlength=len(texts)),
        "chars": per_text(~space),
        "digits": per_text(digit),
        "alphas": per_text(letter),
        "symbols": per_text(kind & 13 == 0),
        "short_lines": np.bincount(of_line[short], minlength=len(texts)),
        "single_char_words": count(length == 1),
        "mixed_words": count(mixed[~(iban | bic)]),
        "vocabulary_hits": np.array([sum(v in t for v in VOCABULARY) for t in folded_texts]),
        "has_iban_prefix": np.array([_IBAN_PREFIX.search(t) is not None for t in folded_texts]),
        "has_postal_code": np.bincount(of_word[postal[pair]], minlength=len(texts)) > 0,
    }


def _portions(batch: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of a batch's texts of up to ``CHUNK`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        yield at, end - at
        at = end


def _profiles(texts: pa.Array) -> pa.Array:
    found = profile([t or "" for t in texts.to_pylist()]) if len(texts) else {}
    columns = [pa.array(found.get(name, []), pa.bool_() if kind == "boolean" else pa.int32()) for name, kind in map(str.split, _STATS.split(", "))]
    return pa.StructArray.from_arrays(columns, names=[f.split()[0] for f in _STATS.split(", ")])


def text_stats(text: Column) -> Column:
    """struct of ten counts and two flags that describe the shape of a text; null counts as empty.

    lines (not blank), words, chars (not white space), digits, alphas, symbols (neither letter nor
    digit), short_lines (below 3 characters), single_char_words, mixed_words (3 or more characters,
    a digit and a letter, and no start of an IBAN or BIC), vocabulary_hits (of 12 terms),
    has_iban_prefix and has_postal_code (5 digits, then a word that starts with two capitals).

    One Arrow pass: every count comes from one table look-up per character, which expressions over
    whole strings would each repeat. Only the texts at hand become Python strings, so memory is that of
    the Arrow batch and some 20 MB.
    """

    @F.arrow_udf(_STATS)
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_profiles(batch.slice(at, n)) for at, n in _portions(batch)]
            yield pa.concat_arrays(parts) if parts else _profiles(batch)

    return stats(text)


def is_unreadable(stats: Column) -> Column:
    """Almost nothing was read: below 20 letters and digits, no term and no IBAN prefix."""
    return (stats["digits"] + stats["alphas"] < 20) & (stats["vocabulary_hits"] == 0) & ~stats["has_iban_prefix"]


def strip_accents(text: Column) -> Column:
    return F.translate(text, LOWER_ACCENTS + UPPER_ACCENTS, LOWER_FOLDED + UPPER_FOLDED)


def holder_strict(holder: Column) -> Column:
    """Lines trimmed, empty ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(holder, "\n"), trimmed), lambda x: x != ""), "\n")


def holder_loose(holder: Column) -> Column:
    """Case, accents, punctuation and line breaks ignored."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(holder)), "[^\\p{IsAlphabetic}\\p{N}]+", " "))


def holder_content(holder: Column) -> Column:
    """As ``holder_loose``, without spaces."""
    return F.replace(holder_loose(holder), F.lit(" "), F.lit(""))


def split_digit_letter(word: Column) -> Column:
    """Two words where two or more leading digits run into a letter."""
    return F.split(F.regexp_replace(word, "^([0-9]{2,})(?=\\p{L})", "$1 "), " ")
