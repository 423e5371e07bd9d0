"""The pipeline's stages against brute force, one after another, on a small fixture."""

from __future__ import annotations

import collections
import zlib

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import decontaminate, graph, quality

from . import helpers as H


def holds_any(text: str, items: list[tuple[str, int]]) -> bool:
    """Whether some item occurs in a text within its edits: the dynamic programme over the text, for all items at once."""
    width = max(len(x) for x, _ in items)
    letters = np.array([[ord(c) for c in x.ljust(width, "\0")] for x, _ in items])
    at, most = np.array([len(x) for x, _ in items]), np.array([n for _, n in items])
    steps = np.arange(width + 1)
    row = np.tile(steps, (len(items), 1))
    for c in text:
        new = np.empty_like(row)
        new[:, 0] = 0
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (letters != ord(c)))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        if (row[np.arange(len(items)), at] <= most).any():
            return True
    return False


def awkward_documents(spark, data):
    """Documents with nulls in every column, repeated rows, empty and blank texts, and extra columns that clash with inner names."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    first = docs.limit(3)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]
    some = docs.unionByName(first).unionByName(first).unionByName(first.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(first.select(*nothing))
    for k, text in enumerate((None, "", " \n", "x")):
        some = some.unionByName(first.limit(1).withColumn("doc_id", F.lit(10_000 + k).cast("long")).withColumn("text", F.lit(text).cast("string")))
    return some.withColumns({c: F.lit(1) for c in ("id", "chunk", "range", "component", "rest", "kept", "open", "score", "item_id")})


@pytest.mark.parametrize("stage", range(len(C.STAGES)))
def test_stages_on_awkward_rows(spark, data, stage):
    name, function = C.STAGES[stage]
    docs = graph.saved(awkward_documents(spark, data), "test-awkward")
    got = function(spark, docs, data)
    if stage < len(C.STAGES) - 1:
        assert got.dtypes == docs.dtypes
        found = {r.doc_id for r in got.collect()}
        assert None in found and (name == "quality classifier" or {10_001, 10_003} <= found)
        # Of repeated rows with one id the deduplications keep all or none.
        counts = got.where("doc_id is not null").groupBy("doc_id").count().collect()
        before = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
        assert all(r["count"] == before[r.doc_id] for r in counts)
    else:
        assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert got.where("piece = 0").count() == docs.count()
    assert function(spark, docs.limit(0), data).count() == 0


def test_stages(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = graph.saved(stage(spark, docs, data), "test-stage")
        if name != C.STAGES[-1][0]:
            assert after.columns == columns
            kept = {r.doc_id: r for r in after.collect()}
        rows = [(i, r.text) for i, r in before.items()]
        if name == "quality classifier":
            labels = spark.read.parquet(f"{data}/labels.parquet")
            scores = {r.doc_id: r.predicted for r in quality.scores(docs, quality.fit(docs, labels)).collect()}
            assert set(kept) == {i for i in before if scores[i]}
        elif name == "n-gram Jaccard join":
            assert set(kept) == {i for i, _, c in H.jaccard(rows) if i == c}
        elif name == "suffix-array dedup":
            want = {i: n - gone for i, n, gone, *_ in H.byte_repeats(rows)}
            assert set(kept) == {i for i, n in want.items() if n or not before[i].text}
            assert all(0 <= want[i] - len(r.text.encode()) <= 6 * want[i] for i, r in kept.items())
            assert all(r.n_chars == len(r.text) for r in kept.values())
        elif name == "benchmark decontamination":
            items = decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()])
            assert set(kept) == {i for i, t in rows if not items.find(decontaminate.normal(t))}
            benchmark = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert set(kept) == {i for i, t in rows if not holds_any(decontaminate.normal(t), [(x, len(x) // 20) for x in benchmark])}
        else:
            found = after.collect()
            pieces = collections.Counter(r.doc_id for r in found)
            assert set(pieces) == set(before)
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            for i, t in rows:
                ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
                own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in found if r.doc_id == i)
                assert own == [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
            places = collections.defaultdict(list)
            for r in found:
                places[r.sequence_id].append((r.offset, r.length))
            for held in places.values():
                assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
        docs = after


def test_run(spark, data):
    found = C.run(spark, data)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 100
