import json
import random

import pytest
from pyspark.sql import functions as F

from deltascope import scan
from deltascope.functions import fixed
from deltascope.sources.records import JSON, csv_grammar
from deltascope.sources.scan import has_quoted_breaks, scan_csv


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


CELLS = ['"a ""quoted"" word"', '"two\nlines"', '"\n\n"', '"comma, inside"', "plain", "", '""', '"x\n""\n"', '"end"""', 'in"ch', '3" pipe', '"tail" rest', '"many\n' + "line\n" * 80 + '"', "é😀"]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("sep", [",", "\t", "|"])
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, small_splits, sep, ending):
    rng = random.Random(sep + ending)
    for k in range(2):
        rows = [sep.join([str(i), *(rng.choice(CELLS).replace("\n", ending) for _ in range(3))]) for i in range(150)]
        title = "n" + sep + '"the' + ending + 'title"' + sep + "b" + sep + "c"
        (tmp_path / f"part-{k}.csv").write_bytes(ending.join([title, *rows, "" if k else '9' + sep + '"never' + ending + 'closed']).encode())
    path = str(tmp_path)
    one_task = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True).csv(path)
    assert has_quoted_breaks(spark, path, sep)
    found = scan_csv(spark, path, sep=sep, infer_types=False)
    assert found.columns == one_task.columns
    cleared = one_task.select(*[F.when(~F.col(f"`{c}`").isin(*fixed.CSV_NA_STRINGS), F.col(f"`{c}`")).alias(c) for c in one_task.columns])
    # the reader turns line breaks inside quotes into line feeds; here they stay as they are in the file
    assert any("\r" in (c or "") for r in found.collect() for c in r) == (ending == "\r\n")
    assert rows_of(found.select(*[F.regexp_replace(c, "\r\n", "\n").alias(c) for c in map(lambda n: f"`{n}`", found.columns)])) == rows_of(cleared)


def test_many_tasks_take_part(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f'{i},"x\ny{i}"\n' for i in range(2000)))
    found = scan_csv(spark, str(tmp_path / "t.csv"))
    assert found.rdd.getNumPartitions() > 4 and found.count() == 2000
    assert found.agg(F.sum("a")).first()[0] == 1999 * 1000
    assert found.where("b = 'x\ny77'").count() == 1


def test_plain_files_are_read_as_before(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x"\n2,"y ""z"""\n')
    assert not has_quoted_breaks(spark, str(tmp_path / "t.csv"), ",")
    assert rows_of(scan(spark, str(tmp_path / "t.csv"))) == [(1, "x"), (2, 'y "z"')]


def documents(rng, n):
    def value(depth):
        kind = rng.randint(0, 7 if depth < 3 else 4)
        if kind == 5:
            return {rng.choice("pqr"): value(depth + 1) for _ in range(rng.randint(0, 3))}
        if kind == 6:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return rng.choice(["}{][", 'a "quote" }', "back\\slash\\", "line\nbreak", "é😀", 7, -1.5, None, True])

    return [{"i": i, "s": rng.choice(["}", '"', "\\", "plain", '{"i": 1}, [', "\\\"}"]), "v": json.dumps(value(0)), "o": {"x": str(value(1))}} for i in range(n)]


@pytest.mark.parametrize("layout", ["compact", "pretty", "stream", "object"])
def test_json_documents_over_many_splits(spark, tmp_path, small_splits, layout):
    docs = documents(random.Random(layout), 1 if layout == "object" else 300)
    path = tmp_path / "t.json"
    path.write_text({
        "compact": lambda: json.dumps(docs), "pretty": lambda: json.dumps(docs, indent=2, ensure_ascii=False) + "\n",
        "stream": lambda: "\n".join(json.dumps(d, indent=1) for d in docs), "object": lambda: json.dumps(docs[0], indent=3),
    }[layout]())
    found = scan(spark, str(path))
    assert sorted(found.columns) == ["i", "o", "s", "v"]
    assert sorted((r.i, r.s, r.v, r.o.x) for r in found.collect()) == [(d["i"], d["s"], d["v"], d["o"]["x"]) for d in docs]
    if layout in ("compact", "pretty"):
        assert rows_of(found) == rows_of(spark.read.option("multiLine", True).json(str(path)))


def test_guesses_of_a_split():
    csv = csv_grammar(",").advance
    assert csv('a,"b', False) == (True, 0) and csv('a,"b"', False) == (False, 0) and csv('5" x,"y"', False) == (False, 0)
    assert csv('b",c', True) == (False, 0) and csv('b"",c', True) == (True, 0) and csv('b","c', True) == (True, 0)
    assert JSON.advance('[{"a": "}', False)[0] is True
    assert JSON.advance('[{"a": 1', False) == (False, 1) and JSON.advance('"', True) == (False, -1)
