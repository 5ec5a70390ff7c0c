"""What neighbour search and the embedding run hold and repeat."""

import tracemalloc

import numpy as np
import pyarrow as pa

from registry import report_queries
from registry.base import QUERIES
from upswell.operators.similarity import Cells
from upswell.plans import embed_run


def cells_of(sizes, parts, centres=None, radius=None):
    cells = object.__new__(Cells)
    cells.sizes, cells.parts, cells.centres = sizes, parts, centres
    cells.radius = np.zeros(max(sizes) + 1) if radius is None else radius
    return cells


def test_reached_blocks_are_no_objects(spark):
    """Every song reaches all of 120 blocks but its own: 8 bytes for each, not a dictionary."""
    n, parts = 10_000, {0: 40, 2: 79, 7: 1}
    cells = cells_of(dict.fromkeys(parts, 1), parts)
    vectors = pa.array(np.ones((n, 2)).tolist(), pa.list_(pa.float32()))
    own = [(2, k % 79) for k in range(n - 1)] + [(7, 0)]
    cell, part = (pa.array(x, pa.int32()) for x in zip(*own))
    reach = cells.reached().func
    tracemalloc.start()
    found = reach(vectors, pa.array(np.full(n, 0.5)), cell, part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n and len(found.flatten()) == 119 * n
    every = [(c, p) for c, many in parts.items() for p in range(many)]
    for k in (0, 100, n - 1):
        assert [(x["cell"], x["part"]) for x in found[k].as_py()] == [b for b in every if b != own[k]]
    assert peak < 50 << 20


def test_reached_blocks_by_distance(spark):
    """Only cells within the chord of the k-th neighbour are reached, with all their parts."""
    centres = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    cells = cells_of({0: 1, 1: 1, 2: 1}, {0: 2, 1: 2, 2: 1}, centres, np.array([0.1, 0.1, 0.1]))
    vectors = pa.array([[1.0, 0.0], [0.0, 2.0], [0.0, 0.0]], pa.list_(pa.float32()))
    args = pa.array([0.01, 0.9, 0.9]), pa.array([0, 1, 0], pa.int32()), pa.array([1, 0, 0], pa.int32())
    found = cells.reached().func(vectors, *args).to_pylist()
    blocks = [[(x["cell"], x["part"]) for x in each] for each in found]
    assert blocks[0] == [(0, 0)]
    assert blocks[1] == [(0, 0), (0, 1), (1, 1), (2, 0)]
    assert blocks[2] == [(0, 1), (1, 0), (1, 1), (2, 0)]
    nothing = cells.reached().func(vectors[:0], *(x[:0] for x in args))
    assert nothing.to_pylist() == []


def small_tables(spark, root):
    rows = {
        "orders": ([(k, "FOP"[k % 3], "1-URGENT" if k % 2 else "5-LOW") for k in range(30)], "o_orderkey bigint, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(k % 30, k % 7, k % 5, "A") for k in range(90)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string"),
        "supplier": ([(k, f"maker {k}") for k in range(5)], "s_suppkey bigint, s_name string"),
        "part": ([(k, f"tag {k}", "TIN", "brand", k) for k in range(7)], "p_partkey bigint, p_name string, p_type string, p_brand string, p_size int"),
    }
    for name, (found, kinds) in rows.items():
        frame = spark.createDataFrame(found, kinds)
        if name == "orders":
            frame = frame.selectExpr("*", "timestamp'2024-01-01' as o_orderdate")
        frame.write.parquet(f"{root}/{name}.parquet")


def test_embedding_run_makes_its_tables_once(spark, tmp_path):
    """The stored table is read again for the upsert, not joined and collected again."""
    small_tables(spark, tmp_path)
    table = QUERIES["v6_run_embed"](spark, str(tmp_path))
    assert not [f for f in table.inputFiles() if "lineitem" in f]
    found = {r.song_id: r for r in table.collect()}
    assert len(found) == 30 and {r.model for r in found.values()} == {"m1"}
    for key, r in found.items():
        fresh = key % 3 or key % 2
        assert (r["size"], r.letters) == ((len(r.source_text), r.source_text.count("a")) if fresh else (0, 0))


def test_batches_leave_a_task_together(spark, monkeypatch):
    """One frame for every Arrow batch of texts, whatever the size of the service's batches."""
    made = []
    whole = embed_run.materialize

    def watched(df):
        made.append(df)
        return whole(df)

    monkeypatch.setattr(embed_run, "materialize", watched)
    stale = spark.range(500).selectExpr("id as song_id", "concat('text ', id) as source_text")
    got = embed_run.embed_texts(stale, report_queries._measure, size=8, calls_at_once=2)
    replies = made[0].collect()
    assert sum(r.n for r in replies) == 500 and len({r.batch_no for r in replies}) == len(replies)
    assert all(r.n == len(r.songs) == len(r.texts) <= 8 for r in replies)
    assert {(r.song_id, r.source_text, int(r.embedding[0])) for r in got.collect()} == {
        (k, f"text {k}", len(f"text {k}")) for k in range(500)
    }
