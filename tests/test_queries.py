"""Every query runs, and where it has SQL the two agree row by row."""

import os

import duckdb
import pytest

import __spark_entry__
from biowave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"denoise_ceemdan", "denoise_vmd", "denoise_emd", "sweep_ceemdan", "sweep_vmd", "fold_classification"}  # their operators have tests of their own


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, frame[cols].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_query(spark, sf_dir, con, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in catalogue.ORACLE_SQL:
        assert rows(got) == rows(con.execute(catalogue.ORACLE_SQL[name]).fetchdf())


def test_entry_and_names(spark):
    assert os.path.isdir("/root/testdata/sf0.001")
    assert __spark_entry__.entry(spark).columns == ["metric", "snr", "k", "mean", "std", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_partitioning_changes_nothing(spark, sf_dir):
    from biowave.operators import sequences
    from biowave.sources.adapters import signals

    s = signals(spark, sf_dir)
    for of in (lambda d: sequences.islands(d), lambda d: sequences.sliding(d, 8, 4), lambda d: sequences.tumbling(d, 16)):
        one, two = (sorted(map(repr, of(s.repartition(n)).select("rec", *[c for c in of(s).columns if c in ("n", "start", "label", "trial_start", "w")]).collect())) for n in (1, 7))
        assert one == two
