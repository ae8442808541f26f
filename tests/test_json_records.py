"""Records of JSON documents in many small splits, against the json module."""

import json
import random

import pytest

from orderloom.sources import files, json_records


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "397b")
    yield
    spark.conf.set(key, before)


def value(rng, depth=0):
    kind = rng.randint(0, 8 if depth < 3 else 5)
    if kind == 0:
        return None
    if kind == 1:
        return rng.randint(-5, 5)
    if kind < 6:
        return "".join(rng.choice('ab{}[]",:\\\n é') for _ in range(rng.randint(0, 8)))
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}}}": value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def items(seed, n=120):
    rng = random.Random(seed)
    out = [{"id": i, "v": value(rng)} for i in range(n)]
    return [x for r in out for x in ([r, value(rng)] if rng.random() < 0.2 else [r])]


def texts(spark, tmp_path, doc, keys, **how):
    (tmp_path / "d.json").write_bytes(json.dumps(doc, **how).encode() if not isinstance(doc, str) else doc.encode())
    return sorted((json.dumps(json.loads(r["j"]), sort_keys=True) for r in json_records.json_texts(spark, str(tmp_path / "d.json"), keys).collect()))


def want(records):
    return sorted(json.dumps(r, sort_keys=True) for r in records if isinstance(r, dict))


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"indent": 1, "ensure_ascii": False})])
def test_lists_over_many_splits(spark, small_splits, tmp_path, seed, how):
    own = items(seed)
    assert texts(spark, tmp_path, own, [], **how) == want(own)
    doc = {"meta": {"items": [{"no": 1}], "x": "items"}, "other": [{"no": 2}, [{"no": 3}]], "data": {"a": {"items": [{"no": 4}]}, "items": own, "z": [{"no": 5}]}, "items": {"data": [{"no": 6}]}}
    assert texts(spark, tmp_path, doc, ["data", "items"], **how) == want(own)


def test_edges(spark, tmp_path):
    one = [{"a": 1}, {"a": "}"}, {}]
    assert texts(spark, tmp_path, one, []) == want(one)
    for doc, keys in (("", []), ("[]", []), ("7", []), ({"a": [{"b": 1}]}, []), (one, ["a"]), ({"a": {"b": 1}}, ["a"]), ('[{"a": 1}, {"b": 2', []), ('[{"a": 1}, {"b": "2}]', []), ('{"a": [{"b": 1}], "a": 3}', ["a"]), ('{"a": {"b": [{"c": 1}]}, "a": {}}', ["a", "b"])):
        assert texts(spark, tmp_path, doc, keys) == [], doc
    assert texts(spark, tmp_path, '{"a": [{"b": 1}], "a": [{"b": 2}]}\n', ["a"]) == want([{"b": 2}])  # of equal keys the last counts
    (tmp_path / "bad.json").write_text('{"pedidos": [{"a": 1}, {"a": tru}]}')
    assert files.read_json(spark, str(tmp_path / "bad.json"), "pedidos").columns == []


def test_folder_of_documents(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"pedidos": [{"k": k, "x": {"y": ["é"]}}] * 2}))
    df = files.read_json(spark, str(tmp_path), "pedidos")
    assert sorted((r["k"], r["x"]["y"][0]) for r in df.collect()) == [(k, "é") for k in range(3) for _ in range(2)]


def test_groups_of_chunks(spark, tmp_path, monkeypatch):
    """What is scanned and joined are groups of some kilobytes, not chunks; records and keys may go over their ends."""
    rows = {}
    keep = json_records.materialise
    monkeypatch.setattr(json_records, "materialise", lambda df, tag: rows.setdefault(tag, keep(df, tag)))
    own = [{"id": i, "v": [{"x": "}{" * (i % 9)}, {"y": {}}] * (i % 5), "t": "é\\\"}" * (i % 400)} for i in range(1500)]
    doc = {"meta": "a, [ } b", "data": own, "z": [{"no": 1}]}
    assert texts(spark, tmp_path, doc, ["data"]) == want(own)
    text = json.dumps(doc)
    assert rows["groups"].count() <= len(text.encode()) // json_records.GROUP + 40 < text.count("}") // 50
    assert rows["cut"].count() < 2 * len(own)


def test_braces_in_keys(spark, tmp_path):
    """A key that holds closing braces is one key, also over the end of a group."""
    own = [{"a": 1}, {"a": 2}]
    assert texts(spark, tmp_path, {"data": 1, "we}ird": [{"no": 1}]}, ["data"]) == []
    for n in (1, 3000, 9000):
        for key in ("x}" * n, "x}" * n + 'é"[', "}" * n):
            doc = {"data": {key[:-1]: [{"no": 1}], key: own, "z": "}" * n}, key: [{"no": 2}]}
            assert texts(spark, tmp_path, doc, ["data"]) == []
            if n < 9000:  # longer ones are told from others by their ends alone, and aren't found
                assert texts(spark, tmp_path, doc, ["data", key]) == want(own), n
