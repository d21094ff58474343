"""Referential checks."""

import contextlib
import io

from kgspark.operators.integrity import check_references


def test_references_are_checked_without_all_ids_in_a_task(spark):
    chunks = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "chunk_id long, source_id long")
    entities = spark.createDataFrame([(10, 5, 1), (11, 11, 7), (12, None, None)], "entity_id long, name long, source_id long")
    rows = [("r1", 10, 11, 1), ("r2", 99, 12, 4), ("r3", None, 98, None)]
    relations = spark.createDataFrame(rows, "relation_id string, src_entity_id long, tgt_entity_id long, source_id long")
    found = check_references(chunks, entities, relations)
    assert sorted(map(tuple, found.collect())) == sorted([
        ("chunk_source", "2"), ("entity_source", "11"), ("entity_source", "12"), ("entity_name", "11"), ("relation_source", "r2"),
        ("relation_source", "r3"), ("relation_src", "r2"), ("relation_src", "r3"), ("relation_tgt", "r3"),
    ])
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        found.explain()
    assert "Broadcast" not in plan.getvalue()
