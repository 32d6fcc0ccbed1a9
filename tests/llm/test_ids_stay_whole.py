import pytest

pytest.importorskip("public_tokenizers")

from sourcelode.llm.embedding_dedup import near_duplicates  # noqa: E402
from sourcelode.llm.packing import pack  # noqa: E402

BIG = 2**53


def test_links_of_large_ids_beside_a_null_one(spark):
    rows = [(None, [1.0, 0.0]), (BIG + 1, [1.0, 0.0]), (BIG + 2, [1.0, 0.01]), (BIG + 3, [0.0, 1.0]), (BIG + 3, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    found = {tuple(r) for r in near_duplicates(frame).collect()}
    assert {(None, 0, None, True), (BIG + 1, 1, BIG + 1, True), (BIG + 2, 1, BIG + 1, False)} <= found
    assert {r[2] for r in found if r[0] == BIG + 3} == {BIG + 3}


def test_packed_pieces_keep_large_ids_beside_a_null_one(spark):
    rows = [(None, 0, 0, 5, 1), (BIG + 1, 0, 0, 7, 2), (BIG + 3, 0, 0, 9, 3), (BIG + 3, 0, 0, 9, 3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").coalesce(1)
    found = pack(frame, 10).collect()
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in found) == [(0, 1), (BIG + 1, 2), (BIG + 3, 3), (BIG + 3, 3)]
    assert len({r["sequence_id"] for r in found}) == 4 and {r["bound"] for r in found} <= {3, 4}


def test_partitions_with_gaps_exchange_until_nothing_is_saved(spark):
    rows = [(i, 0, 0, 3 + i * 7 % 5, i) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    found = pack(frame, 10, group=20).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(400))
    filled = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 10 and len(filled) < 1.1 * sum(r["length"] for r in found) / 10 + 1
