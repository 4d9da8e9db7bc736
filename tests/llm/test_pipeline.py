"""Each stage on its own input, and the whole."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
from frames import DATA
from test_dedup import LAST, cut_brute, groups_of, print_of
from test_packing import ids_of
from texts import lower

from lorespark.llm.common import materialize

PASSAGE = " ".join(f"shared{i}" for i in range(60))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    state = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "quality_classifier":
            assert set(got) <= set(state) and len(got) > 0.7 * len(state)
        elif name == "exact_dedup":
            keep = {}
            for d, t in state:
                keep[lower(t)] = max(d, keep.get(lower(t), d))
            assert got == sorted((d, t) for d, t in state if keep[lower(t)] == d)
        elif name == "simhash_near_dedup":
            ids = [d for d, _ in state]
            group = groups_of([print_of(t) for _, t in state], ids)
            assert got == sorted(s for s, g in zip(state, group) if s[0] == g)
        else:
            assert got == sorted((d, kept.decode("utf-8", "replace")) for d, kept, *_ in cut_brute(state, 50, False))
        state = got
    made = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    ids = dict(zip([d for d, _ in state], ids_of([t for _, t in state])))
    assert made.length.sum() == sum(map(len, ids.values())) and set(made.doc_id) == set(ids)
    for r in made.itertuples():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_stage_edges(spark, odd, empty):
    for rows in (odd, empty):
        docs = rows.select("doc_id", "text", "lang").withColumnsRenamed({"lang": "source"}).selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, DATA), name)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count()


def test_rows_kept(spark, odd_rows):
    """Rows that repeat a doc_id or have none keep their own texts."""
    near = " ".join(f"near{i}" for i in range(400))
    more = [(None, "no id, first"), (None, "no id, second"), (None, "no id, second"), (16, near + " other"), (1, "id one again, " * 9), (None, near + " last"), (None, f"no id {PASSAGE} third")]
    rows = [*odd_rows, *more]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    as_key = lambda r: (LAST if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())
    keep = {}
    for d, t in rows:
        keep[lower(t)] = max(keep.get(lower(t), -1), -1 if d is None else d)
    want = {min((d, t or "") for d, t in rows if lower(t) == k and (-1 if d is None else d) == best) for k, best in keep.items()}
    docs = materialize(stage["exact_dedup"](spark, docs, DATA), "exact")
    state = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(as_key, state)) == sorted(map(as_key, want))
    state.sort(key=as_key)
    group = groups_of([print_of(t) for _, t in state], range(len(state)))
    want = [s for i, s in enumerate(state) if group[i] == i]
    assert len(want) < len(state) and {s[1] for s in want} >= {"same id, one", "same id, two", "no id, first"}
    docs = materialize(stage["simhash_near_dedup"](spark, docs, DATA), "near")
    state = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(as_key, state)) == sorted(map(as_key, want))
    got = [(r.doc_id, r.text) for r in stage["suffix_array_dedup"](spark, docs, DATA).collect()]
    want = [(d, kept.decode("utf-8", "replace")) for d, kept, *_ in cut_brute(state, 50, False)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
