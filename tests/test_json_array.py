import json
import random

import pytest
from pyspark.sql import functions as F

from sellerlens.sources import jsonarray as J
from sellerlens.sources.files import read_json_table

SCHEMA = ("id long, name string, nested struct<a: array<struct<x: string, y: long>>, b: string>, "
          "flags array<boolean>, note string")


def write(tmp_path, text, name="a.json"):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{p}"


def objects(n, seed=1):
    """Objects with braces, brackets, quotes, escapes and multi-byte texts."""
    r = random.Random(seed)
    odd = ["}", "{", "]", "[", '"', "\\", "\\\\", '\\"', "é", "đ", "日本", "\U0001F600", "\n", "\t", ",", " ", "}}]", '{"a":', "x" * 50, "/"]
    out = []
    for i in range(n):
        text = lambda: "".join(r.choices(odd, k=r.randrange(0, 12)))
        out.append({"id": i, "name": text(), "note": None if i % 3 else text(), "flags": [bool(i % 2)] * (i % 4),
                    "nested": {"a": [{"x": text(), "y": k} for k in range(r.randrange(0, 4))], "b": text()}})
    return out


def found(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


def wanted(given):
    return sorted(json.dumps(o, sort_keys=True) for o in given)


@pytest.mark.parametrize("split, style", [(37, "dense"), (64, "lines"), (200, "dense"), (200, "ascii"), (5000, "lines"),
                                          (1 << 20, "dense")])
def test_any_split_gives_all_elements(spark, tmp_path, split, style):
    given = objects(12 if split < 100 else 40 if split == 200 else 200)
    text = {"dense": json.dumps(given, ensure_ascii=False, separators=(",", ":")),
            "lines": "﻿" + json.dumps(given, ensure_ascii=False, indent=2) + "\r\n",
            "ascii": " " + json.dumps(given) + " "}[style]
    df = J.read_json_array(spark, write(tmp_path, text), SCHEMA, split)
    assert found(df) == wanted(given)
    if split == 200 and style == "dense":
        whole = read_json_table(spark, write(tmp_path, text, "b.json"), SCHEMA)
        assert found(whole) == wanted(given)


def test_many_tasks_read_one_file(spark, tmp_path):
    given = [{"id": i, "name": "}" * (i % 5)} for i in range(5000)]
    path = write(tmp_path, json.dumps(given))
    df = J.element_texts(spark, path, 4096)
    scans = df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert scans >= 20 and df.count() == 5000


def test_longer_elements_than_ranges(spark, tmp_path):
    given = [{"id": 1, "name": "a}" * 700}, {"id": 2, "name": "b{[" * 900}, {"id": 3, "name": "c"}]
    df = J.read_json_array(spark, write(tmp_path, json.dumps(given)), "id long, name string", 100)
    assert found(df) == wanted(given)


def test_several_files_and_the_sorted_way(spark, tmp_path):
    given = objects(200, 5)
    for k in range(4):
        write(tmp_path, json.dumps(given[50 * k:50 * (k + 1)], ensure_ascii=False), f"{k}.json")
    write(tmp_path, "[]", "none.json")
    write(tmp_path, " [ \n ] \n", "blank.json")
    texts = J.element_texts(spark, f"file://{tmp_path}", 300, broadcast_splits=0)
    df = texts.select(F.from_json("json", SCHEMA).alias("r")).select("r.*")
    assert found(df) == wanted(given)


@pytest.mark.parametrize("text", ['{"id": 1}', '[1, {"id": 1}]', '[{"id": 1}, 2]', '[{"id": 1}', '[[{"id": 1}]]', "1"])
def test_other_documents_are_refused(spark, tmp_path, text):
    with pytest.raises(Exception, match="not a JSON array"):
        J.read_json_array(spark, write(tmp_path, text), "id long", 1000).collect()


def test_missing_path_and_fields(spark, tmp_path):
    assert J.read_json_array(spark, f"file://{tmp_path}/none.json", "id long") is None
    df = J.read_json_array(spark, write(tmp_path, '[{"id":"x","z":1},{"id":7},{}]'), "id long")
    assert sorted([r.id for r in df.collect()], key=str) == [7, None, None]
