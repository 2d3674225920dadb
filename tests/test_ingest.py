import datetime
import zipfile

from lattica.sources import ingest
from lattica.sources.build import infer

CSV = """# made by hand
id,name,when,at,ok,sizes,amount,name
1,"a, b",2020-01-02,09:30,yes,"<1, 2>",1.5,x
2,NULL,2020-02-03,10:45,no,< >,0.25,y
3,c,2020-03-04,23:59,yes,<7>,oops,z
"""


def test_sniff(tmp_path, spark):
    x, rows = ingest.sniff(CSV.encode())
    assert (x.delimiter, x.comment, x.header) == (",", "#", True)
    assert [(f.name, f.kind) for f in x.fields] == [("id", "integer"), ("name", "string"), ("when", "date"), ("at", "time"), ("ok", "boolean"), ("sizes", "list_integer"), ("amount", "string"), ("name_2", "string")]
    x.fields[6].kind = "decimal"
    p = tmp_path / "a.csv"
    p.write_text(CSV)
    got = ingest.read_csv(spark, str(p), x).orderBy("id").collect()
    assert got[0]["name"] == "a, b" and got[1]["name"] is None and got[0]["sizes"] == [1, 2] and got[1]["sizes"] == []
    assert got[0]["when"] == datetime.date(2020, 1, 2) and got[2]["amount"] is None and got[2][ingest.ERROR] == ["amount"] and got[0][ingest.ERROR] == []


def test_no_header_and_delimiters():
    x, _ = ingest.sniff(b"1;2\n3;4\n5;6\n")
    assert not x.header and x.delimiter == ";" and [f.name for f in x.fields] == ["Field_1", "Field_2"]
    assert ingest.column_names(["", "a", "a"], 4) == ["Field_1", "a", "a_2", "Field_4"]


def test_kinds():
    k = lambda *v: ingest.kind_of(list(v))[0]
    assert k("01", "2") == "string" and k("0", "-12") == "integer" and k("1.5", "2") == "decimal" and k("Y", "no") == "boolean"
    assert k('{"a": 1}') == "json" and k('{"type": "Point", "coordinates": [1, 2]}') == "geojson" and k("<a>x</a>") == "xml" and k("POINT (1 2)") == "wkt"
    assert k("2020-01-02 10:11:12") == "datetime" and k("", "NULL") == "string" and k("1, 2", "3, 4") == "list_integer"


def test_zip(tmp_path, spark):
    p = tmp_path / "a.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("b.csv", CSV)
        z.writestr("c.csv", "p;q\n1;2\n")
    assert ingest.read(spark, str(p)).count() == 3 and ingest.read(spark, str(p), member="c.csv").columns[:2] == ["p", "q"]


def test_encoding_and_inference():
    assert ingest.encoding_of("é".encode("cp1252") + b" and more text") == "windows-1252" and ingest.encoding_of(b"\xff\xfea\x00") == "UTF-16LE"
    assert infer(["1", "2", "12345"]) == "integer" and infer(["1.5", "2"]) == "float" and infer([None]) == "string" and infer([[1, 2], None]) == "list_integer"
