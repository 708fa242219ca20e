"""Fetching documents by URL, in the tasks that need them, with a cap on their size."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.sources.files import MOST_BYTES

#: Seconds to wait for an answer, and bytes read at a time.
PATIENCE_S, CHUNK = 60, 1 << 16


def fetch(url: str | None, most: int = MOST_BYTES, seconds: float = PATIENCE_S) -> tuple[bytes | None, int, str | None, int | None, str | None]:
    """(content, status, error, upstream status, upstream body) of a URL.

    Status is what a service would answer with: 200; 422 for a document over ``most`` bytes; 502
    if the upstream failed (5xx); 500 for its other refusals and for no answer.
    """
    if url is None:
        return None, 422, "no url", None, None
    try:
        with urllib.request.urlopen(url, timeout=seconds) as answer:
            if int(answer.headers.get("Content-Length") or 0) > most:
                return None, 422, "File too big", None, None
            content = bytearray()
            while chunk := answer.read(CHUNK):
                content += chunk
                if len(content) > most:
                    return None, 422, "File too big", None, None
            return bytes(content), 200, None, None, None
    except urllib.error.HTTPError as refusal:
        body = refusal.read(CHUNK).decode("utf-8", "replace")
        return None, 502 if refusal.code >= 500 else 500, "upstream error", refusal.code, body
    except (OSError, ValueError) as fault:
        return None, 500, f"no answer: {type(fault).__name__}", None, None


def fetched(requests: DataFrame, most: int = MOST_BYTES, partitions: int | None = None) -> DataFrame:
    """Rows (url, hint) with content, status, error, upstream_status and upstream_body; others are dropped."""
    rows = requests.select("url", "hint")
    if partitions:
        rows = rows.repartition(partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, url in enumerate(batch.column(0).to_pylist()):
                got = fetch(url, most)
                kinds = (pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *[pa.array([v], t) for v, t in zip(got, kinds, strict=True)]],
                    ["url", "hint", "content", "status", "error", "upstream_status", "upstream_body"],
                )

    return rows.mapInArrow(run, "url string, hint string, content binary, status int, error string, upstream_status int, upstream_body string")


def answer_status(error: str | None, upstream: int | None = None) -> int:
    """The status that a service answers an analysis with: 200 without an error; 422 for a document it can't
    take (too big, of an unsupported type, unknown hint); 502 for an upstream that failed; else 500."""
    if error is None:
        return 200
    if error == "File too big" or error.startswith(("Unsupported file type", "No reader for ", "unknown hint", "no url")):
        return 422
    return 502 if upstream is not None and upstream >= 500 else 500


def ping_status(folder: str) -> int:
    """What a health check answers: 404 while a file called maintenance lies in the folder, else 200."""
    return 404 if (Path(folder) / "maintenance").is_file() else 200
