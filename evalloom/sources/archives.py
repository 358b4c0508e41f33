"""Archives of JSON lines, read member by member inside a task."""

from __future__ import annotations

import bz2
import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa

ROWS = 1024


def _lines(content: bytes) -> Iterator[bytes]:
    with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
        for member in tar:
            held = tar.extractfile(member) if member.isfile() else None
            if held is None:
                continue
            raw = held.read()
            try:
                raw = bz2.decompress(raw)
            except OSError:
                pass  # not compressed
            yield from raw.split(b"\n")


def _paragraph(parts: list, least: int) -> str:
    for part in parts:
        text = (" ".join(map(str, part)) if isinstance(part, list) else str(part)).strip()
        if len(text) > least:
            return text
    return ""


def archived_passages(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, str]] = []

    def batch() -> pa.RecordBatch:
        titles, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(titles), pa.array(texts)], ["title", "passage"])

    for given in batches:
        for content in given["content"].to_pylist():
            for line in _lines(content):
                try:
                    doc = json.loads(line.decode("utf-8", "replace"))
                except ValueError:
                    continue
                if not isinstance(doc, dict):
                    continue
                title, text = str(doc.get("title", "")).strip(), _paragraph(doc.get("text") or [], least)
                if text:
                    rows.append((title, " ".join((f"{title}. {text}" if title else text).split())))
                if len(rows) == ROWS:
                    yield batch()
                    rows.clear()
    if rows:
        yield batch()
