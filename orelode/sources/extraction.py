"""Extraction of records from chunks by a model behind a plain function, and what to do when its answer can't be read."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

QUANTITY = re.compile(r"(?P<property>[а-яёa-z][а-яёa-z ]{3,60}?)\s*[-–—:]?\s*(?P<value>\d+(?:[.,]\d+)?)\s*(?P<unit>%|°C|мг/л|г/л|г/т|мм|мин|ч\b|МПа|м3/ч)", re.I)


def rule_extractor(chunk: str) -> str:
    """A deterministic stand-in for a model: quantities with a unit in each sentence as facts, in JSON."""
    facts = []
    for sentence in re.split(r"(?<=[.!?])\s+", chunk):
        for m in QUANTITY.finditer(sentence):
            quote = " ".join(sentence.split()[:15])
            facts.append({"result": {"property": m["property"].strip().lower(), "value": m["value"], "unit": m["unit"]}, "confidence": "low", "source_quote": quote})
    return json.dumps({"facts": facts, "conclusions": []}, ensure_ascii=False)


def parse_answer(answer: str) -> dict:
    parts = answer.split("```")
    inner = parts[1].removeprefix("json") if len(parts) >= 3 else answer
    found = json.loads(inner.strip())
    if not isinstance(found, dict):
        raise ValueError("the answer is no object")
    return {k: [x for x in found.get(k) or [] if isinstance(x, dict)] if isinstance(found.get(k), list) else [] for k in ("facts", "conclusions")}


def extract(chunks: DataFrame, extractor: Callable[[str], str] = rule_extractor) -> DataFrame:
    """(source_file, chunk_id, record_type, record, failed) for chunks with source_file, chunk_id and chunk.

    An answer that can't be read is asked for once more; then the raw answer stands in ``failed`` and no record is made.
    An extractor that raises gives neither.
    """
    schema = "source_file string, chunk_id long, record_type string, record string, failed string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, number, chunk in zip(batch["source_file"], batch["chunk_id"], batch["chunk"]):
                answer = None
                for _ in range(2):
                    try:
                        answer = extractor(chunk)
                    except Exception:
                        break
                    try:
                        found = parse_answer(answer)
                    except ValueError:
                        continue
                    for kind, items in (("fact", found["facts"]), ("conclusion", found["conclusions"])):
                        rows += [(source, number, kind, json.dumps(x | {"record_type": kind, "source_file": source, "chunk_id": number}, ensure_ascii=False), None) for x in items]
                    answer = None
                    break
                if answer is not None:
                    rows.append((source, number, None, None, answer))
            frame = pd.DataFrame(rows, columns=["source_file", "chunk_id", "record_type", "record", "failed"]).astype(object)
            yield frame.where(frame.notna(), None)

    return chunks.select("source_file", "chunk_id", "chunk").mapInPandas(run, schema)
