"""Every relational query against its hand-written SQL in DuckDB, at the smallest scale factor."""

import datetime
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from probator.functions import columns
from probator.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (bool, str, datetime.date)):
        return value
    return round(float(value), 6) + 0.0


def sorted_rows(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted_rows(got.select(*columns).collect()) == sorted_rows(want.fetchall())


def test_gram_vectors_match_a_plain_count(spark):
    import zlib

    got = {}
    for r in catalog.QUERIES["f03_gram_hash"](spark, DATA).collect():
        got.setdefault(r.p_partkey, {})[r.bucket] = r.weight
    for r in spark.read.parquet(f"{DATA}/part.parquet").collect():
        counts = [0] * 32
        for i in range(max(1, len(r.p_type) - 2)):
            counts[zlib.crc32(r.p_type[i : i + 3].encode()) % 32] += 1
        norm = math.sqrt(sum(c * c for c in counts))
        assert got[r.p_partkey] == pytest.approx({b: c / norm for b, c in enumerate(counts) if c}, abs=1e-6)


def test_gram_vectors_read_their_text_once(spark):
    # A random text differs each time it is made: a norm of other counts would not make the length 1.
    for r in spark.range(20).select(columns.gram_vector(F.expr("uuid()")).alias("v")).collect():
        assert sum(w * w for w in r.v) == pytest.approx(1)
        assert sum(w > 0 for w in r.v) > 5


def test_gram_vectors_of_odd_texts(spark):
    import zlib

    texts = ["", None, "a", "ab", "abc", "\n\n\n\n", "é😀", "😀é😀ß", "a\u0301😀x\u0000y", "^.*|$", "añ😀z" * 2500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", columns.gram_vector(F.col("t")).alias("v"))
    for r in df.collect():
        t, counts = texts[r.i] or "", [0] * 32
        for i in range(max(1, len(t) - 2)):
            counts[zlib.crc32(t[i : i + 3].encode()) % 32] += 1
        norm = math.sqrt(sum(c * c for c in counts))
        assert r.v == pytest.approx([c / norm for c in counts], abs=1e-12), t[:9]
