import io
import os

import pyarrow.parquet as pq
import pytest

from sluice import cli
from sluice.operators.typed import parse_lines
from sluice.plans.convert import convert
from sluice.sinks.parquet import output_path, rows_per_group, write_parquet
from sluice.sources.dialect import detect_delimiter, unique_names
from sluice.sources.scan import line_count, read_delimited, shape
from sluice.streaming.ingest import ingest_stream
from sluice.types import ColumnSpec


def put(tmp_path, raw, name="in.csv"):
    p = tmp_path / name
    p.write_bytes(raw if isinstance(raw, bytes) else raw.encode())
    return str(p)


def got(spark, tmp_path, raw, **kw):
    out = str(tmp_path / "out.parquet")
    report = convert(spark, put(tmp_path, raw), out, **kw)
    return [tuple(r) for r in spark.read.parquet(out).collect()], report


@pytest.mark.parametrize("line, want", [("a,b", ","), ("a;b", ";"), ("a\tb", "\t"), ("a|b", "|"), ("a:b", ":"), ("a b", " "), ("a,b;c", ";"), ("abc", " "), ('"a,b",c;d', ",")])
def test_delimiter(spark, tmp_path, line, want):
    assert detect_delimiter(spark, put(tmp_path, line + "\n1\n")) == want


def test_ragged_rows_are_repaired_and_counted(spark, tmp_path):
    rows, report = got(spark, tmp_path, "a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    assert [tuple(x if x is None else int(x) for x in r) for r in rows] == [(1, 2, 3), (4, 5, None), (6, 7, 8)]
    assert (report.rows, report.ragged) == (3, 2)


@pytest.mark.parametrize("eol", ["\n", "\r\n", "\r"])
def test_line_ends_and_bom(spark, tmp_path, eol):
    rows, report = got(spark, tmp_path, "﻿" + eol.join(["name,n", "x,1.5", "", "y,2"]) + eol)
    assert rows == [("x", 1.5), ("y", 2.0)] and [s.name for s in report.specs] == ["name", "n"]


def test_quotes(spark, tmp_path):
    rows, _ = got(spark, tmp_path, 'a,b\n"x ""q""",1.5\n"bs\\",2.5\n"two\nlines",3.5\n"cr\r\nlf",4.5\n')
    assert rows == [('x "q"', 1.5), ("bs\\", 2.5), ("two\nlines", 3.5), ("cr\nlf", 4.5)]


def test_white_space_line_is_a_ragged_row(spark, tmp_path):
    rows, report = got(spark, tmp_path, "a,b\nx,y\n\n   \nz,w\n")
    assert rows == [("x", "y"), (None, None), ("z", "w")] and report.ragged == 1


def test_undecodable_lines_are_dropped(spark, tmp_path):
    rows, report = got(spark, tmp_path, b"a,b\nx,1\n\xff\xfe,2\ny,3\n")
    assert [r[0] for r in rows] == ["x", "y"] and report.undecodable == 1 and report.ragged == 0


def test_header_only_and_empty(spark, tmp_path):
    rows, report = got(spark, tmp_path, "a,b\n")
    assert rows == [] and [s.kind for s in report.specs] == ["text", "text"]
    with pytest.raises(RuntimeError, match="failed"):
        convert(spark, put(tmp_path, "", "e.csv"))


def test_repeated_and_empty_names(spark, tmp_path):
    assert unique_names(["a", "A", "", "x.y", "a"]) == ["a", "A_2", "_c2", "x.y", "a_3"]
    out = str(tmp_path / "out.parquet")
    report = convert(spark, put(tmp_path, "a,a,,x.y\nu,v,w,z\n"), out)
    assert spark.read.parquet(out).columns == ["a", "a_2", "_c2", "x.y"] and report.specs[1].header == "a"


def test_sample_and_full_inference(spark, tmp_path):
    raw = "n,t\n" + "".join(f"{i + 5},x\n" for i in range(1000)) + "3.5,x\n"
    rows, report = got(spark, tmp_path, raw, count_nulled=True)
    assert report.specs[0].kind == "uint64" and rows[-1][0] is None and report.nulled == {"n": 1, "t": 0}
    rows, report = got(spark, tmp_path, raw, full_inference=True)
    assert report.specs[0].kind == "float64" and rows[-1][0] == 3.5


def test_parse_lines_with_a_schema(spark):
    lines = spark.createDataFrame([("1,true,2024-01-01",), ("2,false,2024-01-02",)], "value string")
    out = parse_lines(lines, [ColumnSpec("a", "int64"), ColumnSpec("b", "boolean"), ColumnSpec("c", "date32")], ",")
    assert [(r.a, r.b, str(r.c)) for r in out.collect()] == [(1, True, "2024-01-01"), (2, False, "2024-01-02")]
    with pytest.raises(ValueError, match="unsupported"):
        ColumnSpec("a", "time64")


def test_data_path_has_no_exchange(spark, tmp_path):
    raw = read_delimited(spark, put(tmp_path, "a,b\n1,2\n"))
    plan = parse_plan = raw.rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in parse_plan


def test_row_groups_codec_and_order(spark, tmp_path):
    assert [rows_per_group(n) for n in (20, 21, 50, 51)] == [250_000, 150_000, 150_000, 5_000]
    out = str(tmp_path / "g.parquet")
    write_parquet(spark.range(2500), out, group_rows=1000, single_file=True)
    part = next(f for f in os.listdir(out) if f.endswith(".parquet"))
    meta = pq.ParquetFile(os.path.join(out, part)).metadata
    assert meta.row_group(0).num_rows == 1000 and meta.row_group(0).column(0).compression == "ZSTD"
    path = put(tmp_path, "n\n" + "".join(f"{i}.5\n" for i in range(20000)))
    convert(spark, path, out)
    assert [r[0] for r in spark.read.parquet(out).collect()] == [i + 0.5 for i in range(20000)]


def test_paths(tmp_path):
    assert output_path("/d/x.tar.csv") == "/d/x.tar.parquet" and output_path("/d/x") == "/d/x.parquet"
    with pytest.raises(ValueError):
        output_path("/d/x.parquet")


def test_shape_and_line_count(spark, tmp_path):
    assert shape(spark, put(tmp_path, 'a\n"x\ny"\n')) == (True, 0, 3, False)
    assert line_count(spark, put(tmp_path, "a\n1\n2\n")) == 2


def test_timestamp_unit_is_kept(spark, tmp_path):
    out = str(tmp_path / "out.parquet")
    convert(spark, put(tmp_path, "t,b\n2024-01-01T00:00:00.123456,x\n"), out, delimiter=",")
    f = spark.read.parquet(out).schema["t"]
    assert f.dataType.typeName() == "timestamp_ntz" and f.metadata["unit"] == "us"


def test_cli(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main([]) == 1
    assert cli.main(["-"], stdin=_Stream(b"")) == 1
    assert cli.main(["-"], stdin=_Stream(b"a,b\nx,2\n")) == 0
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "stdin.parquet")).collect()] == [("x", 2)]
    assert cli.main([put(tmp_path, "a,b\nx,2,3\n", "f.csv")]) == 0 and (tmp_path / "f.parquet").exists()
    assert cli.main([str(tmp_path / "missing.csv")]) == 1
    capsys.readouterr()


class _Stream(io.BytesIO):
    def isatty(self):
        return False


def test_stream(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    specs = [ColumnSpec("a", "int64"), ColumnSpec("b", "text")]
    for k in range(2):
        (folder / f"{k}.csv").write_text(f"a,b\n{k},x{k}\n")
        ingest_stream(spark, str(folder), str(tmp_path / "o"), str(tmp_path / "ck"), specs, ",", header="a,b").awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(0, "x0"), (1, "x1")]


def test_headers_in_a_folder(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\nx,1\na,b\n")
    (folder / "2.csv").write_text("a,b\ny,2\nz,3\n")
    report = convert(spark, str(folder), out := str(tmp_path / "many.parquet"))
    assert report.rows == 4 and sorted(r[0] for r in spark.read.parquet(out).collect()) == ["a", "x", "y", "z"]


def test_an_unclosed_quote_is_reported(spark, tmp_path):
    rows, report = got(spark, tmp_path, 'a,b\n"open,1\nx,2\n')
    assert report.unclosed_quote and len(rows) == 1
    assert not got(spark, tmp_path, "a,b\nx,1\n")[1].unclosed_quote


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from sluice.shared import scratch_path

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, other=None: {"spark.master": "spark://host:7077"}.get(key, other))

    with pytest.raises(ValueError, match="share"):
        scratch_path(Session, "x")
