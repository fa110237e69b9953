"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from corpusguard.plans.oracles import ORACLES
from corpusguard.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def shown(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        return str(v) if isinstance(v, str) else str(round(float(v), 8) + 0.0)

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


def test_which_queries_have_no_oracle():
    assert set(QUERIES) - set(ORACLES) == {"gzip_ratio", "markdown_blocks", "alignment", "mojibake_repair", "glyph_codes", "audit_complete", "document_check", "word_findings", "reconciled_words", "passage_places"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    got, wanted = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert shown(got) == shown(wanted)
