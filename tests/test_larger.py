"""Engine queries against their SQL on tables that are larger, or tie more, than the smallest ones."""

import itertools
import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from pulsecohort.operators import womersley
from pulsecohort.plans import queries as engine


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def both(spark, folder, name, table):
    """Rows of the query and of its SQL, columns by name."""
    df = engine.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    found = c.execute(engine.ORACLE[name])
    names = [d[0] for d in found.description]
    got = sorted(repr([plain(r[k]) for k in cols]) for r in df.collect())
    return got, sorted(repr([plain(r[names.index(k)]) for k in cols]) for r in found.fetchall())


def test_circles_of_many_radii(spark, tmp_path):
    """From radius 10 on, beat * 10 + radius is one number for two of a branch's profiles; each is fitted by itself."""
    rng = np.random.default_rng(3)
    n = 2 * 180
    vectors = rng.normal(size=(n, 9)) - (np.arange(9) - 4.0) ** 2
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 2 for i in range(n)], pa.int32())}), tmp_path / "embeddings.parquet")
    got, want = both(spark, tmp_path, "wm_relaxation_topk", "embeddings")
    assert len(got) == 6 and got == want


def test_coherence_at_its_bound(spark, tmp_path):
    """Differences whose coherence is 7/10: the order in which they are added decides on which side of 0.7 it comes out."""
    lines = list(itertools.permutations([(0.02, 0.03, 1), (0.06, 0.06, 2), (0.01, 0.07, 3), (0.03, 0.07, 4)]))
    rows = [{"l_orderkey": 7 * i + 3, "l_partkey": 1, "l_suppkey": i, "l_linenumber": n, "l_quantity": 50.0, "l_discount": d, "l_tax": t, "l_returnflag": "N"} for i, frame in enumerate(lines) for d, t, n in frame]
    pq.write_table(pa.Table.from_pylist(rows).set_column(3, "l_linenumber", pa.array([x["l_linenumber"] for x in rows], pa.int32())), tmp_path / "lineitem.parquet")
    got, want = both(spark, tmp_path, "wm_frame_classes", "lineitem")
    assert len(got) == len(lines) and got == want
    given = spark.createDataFrame([(1, i, n, 1, 0.95, d - 0.02, t) for i, frame in enumerate(lines) for d, t, n in frame], "acq long, frame long, branch int, radius int, probability double, difference double, normal_std double")
    # without an order all of them reach the bound
    assert [r["motion_class"] for r in womersley.frame_classes(given).select(F.col("motion_class")).distinct().collect()] == [1]


def test_frames_half_way_between_two_results(spark, tmp_path):
    """Coherences and means with a 5 as seventh digit: the order of the sums decides on the sixth, and how a double is rounded."""
    rng = np.random.default_rng(1)
    # discount and tax in hundredths; the coherences are 113, 109 and 23 parts of 128
    tied = [[(5, 1), (1, 2), (2, 1), (4, 6), (8, 5), (4, 1), (8, 4)], [(8, 7), (0, 7), (4, 7), (3, 1), (2, 3), (8, 3), (8, 4), (1, 6)], [(0, 1), (8, 5), (0, 8), (8, 7), (5, 7), (5, 4), (2, 3)]]
    frames = [[(50.0, d, t, n % 7 + 1) for n, (d, t) in enumerate(rows)] for rows in tied for _ in range(16)]
    for n, parts in ((128, 61), (640, 301), (640, 303), (640, 307), (640, 309)):
        for _ in range(8):
            q = rng.integers(1, 45, n)
            while (missing := 53 * parts - q.sum()) != 0:
                i = rng.integers(n)
                q[i] = np.clip(q[i] + missing, 1, 47)
            frames.append([(float(x), 2, 1, k % 7 + 1) for k, x in enumerate(q)])
    lines = [(i, *frame[k]) for i, frame in enumerate(frames) for k in rng.permutation(len(frame))]
    frame, quantity, discount, tax, line = zip(*lines)
    columns = {
        "l_orderkey": pa.array([3] * len(lines), pa.int64()), "l_partkey": pa.array([1] * len(lines), pa.int64()), "l_suppkey": pa.array(frame, pa.int64()), "l_linenumber": pa.array(line, pa.int32()),
        "l_quantity": quantity, "l_discount": [d / 100 for d in discount], "l_tax": [t / 100 for t in tax], "l_returnflag": ["N"] * len(lines),
    }
    pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet")
    got, want = both(spark, tmp_path, "wm_frame_classes", "lineitem")
    assert len(got) == len(frames) and got == want
