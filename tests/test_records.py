"""Delimited text against Python's csv module, in many small splits."""

import csv
import io
import random

import pytest

from orderloom.sources import files, json_records, records


def expect(text, sep, has_header=True):
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
    names = [n.strip() for n in rows[0]] if has_header else [f"col{i}" for i in range(len(rows[0]))]
    return names, [tuple(r[k].strip() if k < len(r) else None for k in range(len(names))) for r in rows[1 if has_header else 0 :]]


def field(rng, sep):
    kind = rng.randint(0, 9)
    text = "".join(rng.choice('ab é"\n' + sep) for _ in range(rng.randint(0, 12)))
    if kind < 5:
        return "".join(c for c in text if c not in f'"\n{sep}')
    if kind == 5:  # a quote within a plain field, and text after a closing quote
        return 'a"b' if rng.random() < 0.5 else '"x"y"z'
    return '"' + text.replace('"', '""') + '"'


def sample(seed, sep, lines=600, end="\n"):
    rng = random.Random(seed)
    out = ["id" + sep + '"na\nme"' + sep + " x "]
    for i in range(lines):
        if rng.random() < 0.05:
            out.append("")
        else:
            out.append(sep.join([str(i), *[field(rng, sep) for _ in range(rng.randint(0, 4))]]))
    return end.join(out) + (end if seed % 2 else "")


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "211b")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize(("seed", "sep", "end"), [(1, ",", "\n"), (2, ";", "\n"), (3, "|", "\r\n"), (4, "\t", "\n"), (5, "^", "\n")])
def test_equals_csv_module_over_many_splits(spark, small_splits, tmp_path, seed, sep, end):
    text = sample(seed, sep, end=end)
    (tmp_path / "a.csv").write_bytes(text.encode())
    df = records.read_records(spark, str(tmp_path / "a.csv"), sep)
    names, want = expect(text, sep)
    assert df.columns == names
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20


def test_long_quoted_field_over_splits(spark, small_splits, tmp_path):
    """A field over several splits, with whole lines in it that look like records."""
    inner = "\n".join(f'{i},""q"",x' for i in range(300))
    text = f'a,b\n1,"{inner}"\n2,y\n\n3,"z"\n'
    (tmp_path / "a.csv").write_text(text)
    names, want = expect(text, ",")
    assert sorted(map(str, map(tuple, files.read_csv(spark, str(tmp_path / "a.csv"), ",").collect()))) == sorted(map(str, want))


def test_edges(spark, tmp_path):
    def read(text, name, **more):
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
        df = files.read_csv(spark, str(tmp_path / name), **more)
        return df.columns, [tuple(r) for r in df.collect()]

    assert read("", "empty.csv") == ([], [])
    assert read("a,b\n", "head.csv") == (["a", "b"], [])
    assert read("a,b\n\n , \n1\n", "blank.csv")[1] == [(None, None), ("", ""), ("1", None)]
    assert read('1;"x;y"\n2;z;w', "bare.csv", has_header=False) == (["col0", "col1"], [("1", "x;y"), ("2", "z")])
    assert read("a,b,a\n1,2,3\n", "twice.csv") == (["a", "b"], [("3", "2")])
    assert read('a,b\n1,"never closed\n2,x\n', "open.csv")[1] == [("1", "never closed\n2,x")]
    assert read("a,b\n1,é\n".encode("latin-1"), "latin.csv", encoding="latin-1")[1] == [("1", "é")]
    assert read("a,b\n1,x\ry\n2,z\n", "cr.csv")[1] == [(None, None), ("2", "z")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_csv(spark, str(tmp_path / "gone.csv"), ",")


def test_folder_of_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text(f'k,"v"\n{k},"a\nb"\n')
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path), ",").collect())) == [(str(k), "a\nb") for k in range(3)]


def test_splits_are_summed_without_a_sort(spark, tmp_path):
    """A split's last line is found by hash aggregates, which hold a row a split, not its lines."""
    for name, schema, found in (("lines", records.LINES, records._true_cases), ("groups", json_records.GROUPS, json_records._splits)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
        plan = found(spark.read.schema(schema).parquet(f"{tmp_path}/{name}"))._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
