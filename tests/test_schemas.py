import uuid

import pytest

from foliograph import schemas


def test_bootstrap_twice(spark):
    name = "db_" + uuid.uuid4().hex[:8]
    for _ in range(2):
        schemas.bootstrap(spark, name)
    assert {r.tableName for r in spark.sql(f"SHOW TABLES IN {name}").collect() if not r.isTemporary} == {"documents", "chunks", "prefix_cache"}
    assert spark.table(f"{name}.chunks").columns[-1] == "doc_id"
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_evolve_and_keys(spark):
    old = spark.createDataFrame([(1, "a", None, "x"), (1, "b", ["m"], "y")], "id long, filename string, applicable_models array<string>, extra string")
    new = schemas.evolve(old, schemas.DOCUMENTS).collect()
    assert [(r.applicable_models, r.serial_prefixes, r.title) for r in new] == [([], [], None), (["m"], [], None)]
    assert [tuple(r) for r in schemas.duplicate_keys(old, ["id"]).collect()] == [(1, 2)]
    assert schemas.duplicate_keys(old, ["filename"]).count() == 0
    with pytest.raises(Exception):
        schemas.evolve(old, "id struct<a:int>").collect()
