import os

import duckdb
import pytest

from cellspark.plans import catalog

DATA = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_small_object_filter_keeps_the_limit(spark):
    from cellspark.operators import segment as sg

    runs = [("s", 1, 0, 0, 2 * k, 0, n - 1) for k, n in enumerate((49, 50, 51))]
    kept = sg.remove_small_objects(sg.connected_components(spark.createDataFrame(runs, sg.RUN), 4, 64), 50).collect()
    assert sorted(r["x1"] for r in kept) == [49, 50]


def test_read_fastq(spark, tmp_path):
    import gzip

    from cellspark.sources.files import read_fastq

    (tmp_path / "d").mkdir()
    (tmp_path / "a.fastq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nGG\n+\nII\n")
    with gzip.open(tmp_path / "d" / "b.fastq.gz", "wt") as f:
        f.write("@r3\nTT\n+\nII\n")
    rows = read_fastq(spark, [str(tmp_path / "a.fastq"), str(tmp_path / "d")]).collect()
    assert sorted((r["read_id"], r["seq"], r["qual"]) for r in rows) == [("r1", "ACGT", "@III"), ("r2", "GG", "II"), ("r3", "TT", "II")]


def test_read_fastq_across_splits(spark, tmp_path):
    from cellspark.sources.files import read_fastq

    want = [(f"r{k}", "ACGT" * (k % 9 + 1), "@+I!" * (k % 9 + 1)) for k in range(400)]
    (tmp_path / "a.fastq").write_text("".join(f"@{i} x\n{s}\n+\n{q}\n" for i, s, q in want) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = read_fastq(spark, [str(tmp_path / "a.fastq")])
        assert sorted((r["read_id"], r["seq"], r["qual"]) for r in got.collect()) == sorted(want)
        (tmp_path / "b.fastq").write_text("@r1\nACGT\n+\nIIII\n@r2\nACGT\n")
        with pytest.raises(ValueError, match="incomplete"):
            read_fastq(spark, [str(tmp_path / "b.fastq")])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lineage_of_a_long_chain(spark):
    from cellspark.operators.tracking import lineage

    n = 150
    tracks = spark.createDataFrame([("m", f"{k:03}") for k in range(n)], "movie string, track_id string")
    splits = spark.createDataFrame([("m", f"{k:03}", f"{k - 1:03}") for k in range(1, n)], "movie string, track_id string, parent string")
    rows = lineage(tracks, splits).collect()
    assert len(rows) == n and {r["root"] for r in rows} == {"000"}


def test_distance_transform_of_every_frame(spark, duck):
    import numpy as np

    masks = {}
    for r in catalog._mask(spark, DATA).where("channel = 0").collect():
        masks.setdefault(r["t"], {})[r["y"]] = r["mask"]
    want = {}
    for t, lines in masks.items():
        mask = np.array([lines[y] for y in sorted(lines)])
        back = np.argwhere(~mask)
        want |= {(t, y, x): float(np.sqrt(((back - (y, x)) ** 2).sum(1).min())) for y, x in np.argwhere(mask).tolist()}
    got = {(r["t"], r["y"], r["x"]): r["distance"] for r in catalog.QUERIES["distance_transform_planes"](spark, DATA).where("channel = 0").collect()}
    assert len({k[0] for k in want}) > 1 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
