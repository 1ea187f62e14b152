"""Greedy paragraph chunkers: a text becomes chunks near a target size. Their state runs along one
text, so they work on Arrow batches of whole rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where an overlong paragraph may be cut, by chunker; for the second in order of rank.
ENDS = ("다.", "요.", "\n", ". ")
RANKED_ENDS = ("\n\n", "\n", "다.", "요.", "까.", "죠.", ". ", "! ", "? ")
#: Characters that a cut leaves before itself; what a cut of the first chunker passes.
NEAREST, STEP = 200, 2
#: Target, largest and least size of a chunk, by chunker.
TRAINING_SIZES, EVALUATION_SIZES = (4200, 6000, 1200), (5000, 7000, 2500)


def paragraphs(text: str) -> list[str]:
    return [p for p in (part.strip() for part in re.split(r"\n{2,}", text)) if p]


def _last_end(paragraph: str, at: int, target: int, least: int) -> int:
    """Where the first chunker ends a piece that starts at `at`: behind the last mark within the
    target, if that lies beyond the least size."""
    stop = at + target
    if stop >= len(paragraph):
        return len(paragraph)
    mark = max(paragraph.rfind(m, at, stop) for m in ENDS)
    return mark + STEP if mark > at + least else stop


def _ranked_end(paragraph: str, at: int, target: int, most: int) -> int:
    """Where the second one does: behind the last place of the first mark that has one far enough."""
    stop = min(at + most, len(paragraph))
    places = ((paragraph.rfind(m, at + 1, stop), m) for m in RANKED_ENDS)
    return next((k + len(m) for k, m in places if k >= at + NEAREST), min(at + target, len(paragraph)))


def _pieces(paragraph: str, end_of: Callable[[int], int], least: int) -> Iterator[str]:
    at = 0
    while at < len(paragraph):
        end = max(end_of(at), at + 1)
        if len(piece := paragraph[at:end].strip()) >= least:
            yield piece
        at = end


def training_chunks(text: str, target: int, most: int, least: int) -> Iterator[str]:
    """Paragraphs joined until they reach `target`, never beyond `most`; sizes count two characters
    after each paragraph. One over `most` is cut by itself; what is shorter than `least` is dropped."""
    held: list[str] = []

    def size() -> int:
        return sum(len(p) + STEP for p in held)

    for paragraph in [*paragraphs(text), None]:
        over = paragraph is not None and len(paragraph) > most
        if held and (paragraph is None or over or size() + len(paragraph) + STEP > most):
            if size() >= least:
                yield "\n\n".join(held)
            held = []
        if over:
            yield from _pieces(paragraph, lambda at, p=paragraph: _last_end(p, at, target, least), least)
        elif paragraph is not None:
            held.append(paragraph)
            if size() >= target:
                yield "\n\n".join(held)
                held = []


def evaluation_chunks(text: str, target: int, most: int, least: int) -> Iterator[str]:
    """As above, by the joined text's own size; a chunk that reached the target is also dropped if it
    is too short. Cuts go to the best mark within `most`."""
    held: list[str] = []
    for paragraph in [*paragraphs(text), None]:
        over = paragraph is not None and len(paragraph) > most
        joined = "\n\n".join(held)
        full = paragraph is None or over or (held and (len(joined) >= target or len(joined) + STEP + len(paragraph) > most))
        if held and full:
            if len(joined) >= least:
                yield joined
            held = []
        if over:
            yield from _pieces(paragraph, lambda at, p=paragraph: _ranked_end(p, at, target, most), least)
        elif paragraph is not None:
            held.append(paragraph)


def chunk_documents(docs: DataFrame, target: int | None = None, most: int | None = None, least: int | None = None, evaluation: bool = False) -> DataFrame:
    """docs(doc_id, text) as doc_id, chunk_index, chunk; texts are cleaned before, if at all."""
    chunker = evaluation_chunks if evaluation else training_chunks
    sizes = [given if given is not None else usual for given, usual in zip((target, most, least), EVALUATION_SIZES if evaluation else TRAINING_SIZES, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, c) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for k, c in enumerate(chunker(t.as_py() or "", *sizes))]
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.string())], names=["doc_id", "chunk_index", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_index int, chunk string")
