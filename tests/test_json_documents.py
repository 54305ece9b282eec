"""Documents that are split in many places give the rows of the plain reader."""

import json
import random

import pytest

from tallywright.sources import files
from tallywright.sources.json_documents import split_document


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, size if n == names[0] else 1) for n in names]
    for n, v in before.items():
        spark.conf.set(n, v)


def odd_rows(n, seed=1):
    rng = random.Random(seed)
    texts = ["plain", 'quote " here', "brace } and { here", "back\\slash", "ends in \\", '\\" both', "]}[{", "é日本", "", 'a "b": [{"c": 1}]']
    return [{"id": i, "text": rng.choice(texts), "deep": {"x": {"y": [{"z": rng.choice(texts)}, {"z": None}]}}, "list": [1, 2, i], "long": rng.choice(texts) * rng.choice([1, 1, 1, 60])} for i in range(n)]


def both(spark, path):
    split, plain = files.read_json(spark, path, split_bytes=0), files.read_json(spark, path, split_bytes=1 << 60)
    assert split.schema == plain.schema
    return sorted(map(str, split.collect())), sorted(map(str, plain.collect()))


@pytest.mark.parametrize("shape, indent, size", [("root", None, 997), ("root", 1, 1 << 20), ("data", 1, 1999), ("data", None, 1 << 20), ("largest", None, 2003), ("largest", 1, 1 << 20)])
def test_equals_the_plain_reader(spark, tmp_path, small_splits, shape, indent, size):
    rows = odd_rows(60)
    document = {
        "root": rows,
        "data": {"meta": {"rows": [{"no": 1}], "x": {"y": {"z": 2}}}, "errors": [{"id": i, "why": "]"} for i in range(90)], "data": rows, "after": [1, {"p": 2}], "end": None},
        "largest": {"few": [{"id": 1}], "nu}m{bers": [1, 2, 3], "ma}ny": rows, "empty": [], "nested": [[{"id": 3}], [{"id": 4}]]},
    }[shape]
    (tmp_path / "d.json").write_text(json.dumps(document, indent=indent, ensure_ascii=shape == "root"))
    small_splits(size)
    if shape == "largest" and size < 1 << 20:
        try:
            ours, plain = both(spark, str(tmp_path / "d.json"))
        except Exception as error:  # a name that two splits share is refused, not misread
            assert "top-level name" in str(error)
            return
    else:
        ours, plain = both(spark, str(tmp_path / "d.json"))
    assert ours == plain and len(ours) == 60


def test_many_tasks_and_one_giant_element(spark, tmp_path, small_splits):
    rows = [{"id": 1, "parts": [{"n": i} for i in range(1_500)]}, {"id": 2, "parts": []}, {"id": 3, "parts": [{"n": 1}]}]
    (tmp_path / "d.json").write_text(json.dumps({"data": rows}))
    small_splits(2_000)
    assert split_document(spark, str(tmp_path / "d.json"), str(tmp_path / "lines")) == "data"
    got = spark.read.json(str(tmp_path / "lines"))
    assert sorted((r["id"], len(r["parts"])) for r in got.collect()) == [(1, 1_500), (2, 0), (3, 1)]
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "d.json")).rdd.getNumPartitions() >= 10


def test_documents_without_rows(spark, tmp_path):
    for i, document in enumerate(({"a": 1, "b": {"c": [1]}}, {"data": [], "x": [1, 2]}, [1, 2, 3])):
        (tmp_path / f"{i}.json").write_text(json.dumps(document))
        assert split_document(spark, str(tmp_path / f"{i}.json"), str(tmp_path / f"to{i}")) is None
    assert files.read_json(spark, str(tmp_path / "0.json"), split_bytes=0).columns == ["a", "b"]


def test_a_folder_of_documents(spark, tmp_path, small_splits):
    for i in range(5):
        (tmp_path / f"{i}.json").write_text(json.dumps({"other": [{"x": 1}], "items": [{"id": 10 * i + j} for j in range(4)]}))
    small_splits(64)
    got = files.read_json(spark, str(tmp_path), split_bytes=0)
    assert sorted(r["id"] for r in got.collect()) == [10 * i + j for i in range(5) for j in range(4)]
