"""The registered queries against their SQL on the smallest tables, and what the driver's contract asks of the others."""

import zlib

import pytest
from compare import connect, difference
from helpers_llm import SMALL

from vigilog.llm.oracles import ORACLES
from vigilog.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    problem, rows = difference(spark, connect(SMALL), QUERIES[name], ORACLES[name], SMALL)
    assert not problem
    assert rows > 0


def test_every_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name, label, least", [("op4_subword_classifier", "quality", 0.8), ("op5_kneser_ney", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    folder = SMALL.replace("0.001", "0.01")
    found = {r["doc_id"]: r for r in QUERIES[name](spark, folder).collect()}
    labels = [(r["doc_id"], r[label]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(found[i]["predicted"], y) for i, y in labels if found[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) >= least
