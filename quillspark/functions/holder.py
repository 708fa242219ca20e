"""Account holder blocks in page text laid out in columns.

Finding a block walks over lines and columns with early stops, which window functions can't say;
the walk runs in Arrow batches (``pandas_udf``). Blocks are separated by two spaces, as layout
preserving text extraction prints them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that open, head or close a holder block.
_I = re.IGNORECASE
LEGAL_FORMS = ("SCI", "SAS", "SASU", "SARL", "EURL", "SA", "SNC", "SC", "ASSOCIATION", "ASS", "GIE", "SEL", "SELARL", "EARL", "GAEC", "SCP", "SCM", "SCEA")
TITLES = ("m", "monsieur", "mr", "mademoiselle", "ml", "mle", "mlle", "melle", "madame", "mme")
LEGAL_FORM = re.compile(rf"^\s*(?:{'|'.join(LEGAL_FORMS)})\b", _I)
TITLE = re.compile(rf"(?:^|\s)(?:{'|'.join(TITLES)})\.?\s", _I)
POSTAL = re.compile(r"(?:^| )[0-9]{5}(?: ?- ?| ?)(?:[A-Za-z]+ ?)+")
HOLDER, BRANCH = re.compile("titulaire|intitulé", _I), re.compile("domiciliation|cadre réservé", _I)
BLOCK_TOP = re.compile("titulaire|intitulé|domiciliation|cadre réservé", _I)
BLOCK_HEAD = re.compile("titulaire|intitulé|identit[eé] bancaire", _I)
BLOCK_END = re.compile(r"domiciliation|cadre réservé|identification|\bIBAN\b|\bBIC\b|FR\d{2} ?\d{4}", _I)
NOT_HOLDER = re.compile(r"titulaire|domiciliation|cadre réservé|identification|numero de|\bIBAN\b|\bBIC\b|FR\d{2} ?\d{4}", _I)
LABEL = re.compile("titulaire", _I)
LABEL_START = re.compile(r"^\s*(?:titulaire|intitul[eé])(?:\s+du|\s+de)?(?:\s+compte)?\s*(?:[:\-/]\s*)?(?:\(?account\s+(?:owner|holder)\)?)?\s*[:\-]?\s*", _I)
ACCOUNT_TITLE = re.compile("intitulé du compte", _I)
#: Lines above a postal code, and below a label, that can belong to a block.
LINES_UP, LINES_DOWN = 6, 6


@dataclass
class Block:
    """Lines of a column block, with what stands to the left of each."""

    inner: list[str]
    left: list[str]

    @property
    def lines(self) -> list[str]:
        return [s for s in map(str.strip, self.inner) if s]

    def kind(self) -> str:
        """holder, branch or unknown, by the block's words, else by those to its left."""
        for text in (" ".join(self.lines), " ".join(self.left)):
            if HOLDER.search(text):
                return "holder"
            if BRANCH.search(text):
                return "branch"
        return "unknown"


def span_of(line: str, start: int, end: int) -> tuple[int, int] | None:
    """First and last character of the block that holds characters start to end; None past the line's end.

    The block reaches left to just after a double space (or the line's start), and right to just
    before one (or the line's end); a single space at its edge isn't part of it.
    """
    end = min(end, len(line) - 1)
    if not 0 <= start <= end:
        return None
    gap = line.rfind("  ", 0, min(start + 2, end + 1))
    left = gap + 2 if gap >= 0 else int(line.startswith(" "))
    if left > end:
        return None
    gap = line.find("  ", max(left, end - 1))
    right = gap - 1 if gap >= 0 else len(line) - 1 - line.endswith(" ")
    return left, right


def block_around(lines: list[str], row: int, start: int, end: int, rows: range, stop: re.Pattern) -> Block | None:
    """The block over ``rows`` (walked in that order) in the columns of the anchor; None if the anchor is out of its line.

    A line too short for the columns is passed over; one that matches ``stop``, in the block or to
    its left, is the last.
    """
    anchor = span_of(lines[row], start, end)
    if anchor is None:
        return None
    found = []
    for k in rows:
        if (span := span_of(lines[k], *anchor)) is None:
            continue
        inner, left = lines[k][span[0] : span[1] + 1], lines[k][: span[0]]
        found.append((inner, left))
        if stop.search(inner) or stop.search(left):
            break
    if rows.step < 0:
        found.reverse()
    return Block([x for x, _ in found], [x for _, x in found])


def _bytes(line: str, at: int) -> int:
    """Byte offset of a character: postal codes are placed in bytes, columns are counted in characters."""
    return len(line[:at].encode("utf-8", "surrogatepass"))


def address_block(text: str) -> Block | None:
    """The block above the first postal code that is a holder's, else the first of unknown kind."""
    lines = text.split("\n")
    unknown = None
    for row, line in enumerate(lines):
        for m in POSTAL.finditer(line):
            block = block_around(lines, row, _bytes(line, m.start()), _bytes(line, m.end()) - 1, range(row, max(row - LINES_UP, 0) - 1, -1), BLOCK_TOP)
            if block is None:
                continue
            kind = block.kind()
            if kind == "holder":
                return block
            if kind == "unknown" and unknown is None:
                unknown = block
    return unknown


def _after_colon(line: str) -> str:
    """What stands between the first colon and the next; the line itself without one."""
    return line.split(":")[1] if ":" in line else line


def address_lines(block: list[str]) -> list[str]:
    """Holder lines of an address block: from the title on, or the company form just above it, labels left out."""
    first = next((k for k, line in enumerate(block) if TITLE.search(line)), 0)
    if first and LEGAL_FORM.search(block[first - 1]):
        first -= 1
    cut = (ACCOUNT_TITLE.sub("", _after_colon(line)) for line in block[first:])
    return [line.strip() for line in cut if not BLOCK_HEAD.search(line)]


def _unlabelled(line: str) -> str:
    if not LABEL.search(line):
        return line
    return _after_colon(line) if ":" in line else LABEL_START.sub("", line, count=1)


def labelled_lines(block: list[str]) -> list[str]:
    """Holder lines of a block that starts at its label."""
    kept = (line for line in map(_unlabelled, block) if line and not NOT_HOLDER.search(line))
    return [s for s in (_after_colon(line).strip() for line in kept) if s]


def labelled_holder(text: str, least: int) -> str | None:
    """The block at and below the first holder label, down to a blank line; else the first line with a title."""
    lines = text.splitlines() if "\n" not in text else re.sub(r"\r?\n$", "", text).split("\n")
    lines = [line.removesuffix("\r") for line in lines]
    for row, line in enumerate(lines):
        if m := LABEL.search(line):
            end = next((k for k in range(row + 1, len(lines)) if not lines[k].strip()), len(lines))
            deep = min(max(end - row, least), LINES_DOWN)
            block = block_around(lines, row, _bytes(line, m.start()), _bytes(line, m.end()) - 1, range(row, min(row + deep, len(lines))), BLOCK_END)
            if block and (found := labelled_lines(block.lines)):
                return "\n".join(found)
            break
    for line in lines:
        if m := TITLE.search(line):
            start, end = _bytes(line, m.start()), _bytes(line, m.end()) - 1
            gap = line.find("  ", max(start, min(end, len(line) - 1) - 1))
            return line[start : gap if gap >= 0 else len(line)].strip() if start < len(line) else None
    return None


def account_holder_of(text: str | None, least: int = 3) -> str | None:
    """The account holder of a page of text, lines joined by newlines; None if there is none."""
    if not text:
        return None
    block = address_block(text)
    return "\n".join(address_lines(block.lines)) if block is not None else labelled_holder(text, least)


# Labels of a holder field, and a pair of names printed in capitals.
HOLDER_LABEL = re.compile(r"(?:nom et adresse du )?(?:titulaire|intitul[ée]|account owner|b[ée]n[ée]ficiaire)s?(?: du compte| de compte| du client)?\s*(?:n[°o]\s*)?[:.\-]*", _I)
COUPLE = re.compile("[A-Z]+ +[A-Z]+ +OU +[A-Z]+ +[A-Z]+")
CROP_POSTAL = re.compile(r"[0-9]{5}\s*[A-Za-z]")


def title_at(text: str) -> int | None:
    """Where a title starts, or else a pair of names in capitals joined by OU."""
    found = TITLE.search(text) or COUPLE.search(text)
    return found.start() if found else None


def after_label(text: str) -> int | None:
    """Where what a holder label names starts: on the label's line, else on the next."""
    found = HOLDER_LABEL.search(text)
    if not found:
        return None
    rest, newline, _ = text[found.end() :].partition("\n")
    if rest.strip():
        return found.end() + len(rest) - len(rest.lstrip())
    return found.end() + len(rest) + 1 if newline else None


def trimmed_holder(text: str | None) -> str | None:
    """The holder in the text of a crop, from the later of title and label to the first postal line.

    None without either of them, and for a block that has neither title nor postal line.
    """
    starts = [x for x in (title_at(text), after_label(text)) if x is not None] if text else []
    if not starts:
        return None
    block = text[max(starts) :].strip()
    lines = block.split("\n")
    last = next((k for k, line in enumerate(lines) if CROP_POSTAL.search(line)), None)
    if not block or last is None and title_at(block) is None:
        return None
    return "\n".join(lines if last is None else lines[: last + 1])


def account_holder(text: Column, least: int = 3) -> Column:
    """``account_holder_of`` as a Column, in Arrow batches."""

    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: account_holder_of(t, least), na_action="ignore").astype(object)

    return find(text)


def crop_holder(text: Column) -> Column:
    """``trimmed_holder`` as a Column, in Arrow batches."""

    @F.pandas_udf("string")
    def trim(texts: pd.Series) -> pd.Series:
        return texts.map(trimmed_holder, na_action="ignore").astype(object)

    return trim(text)
