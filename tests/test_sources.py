"""Record sources and sinks: files written here and read back."""
import json

from pyspark.sql import functions as F

from sourcinglens.sources import records_io as io


def test_suppliers_from_json(spark, tmp_path):
    records = [
        {"_id": "a", "lastScraped": 86400.5, "name": "A", "classifications": {"Kompass": [{"code": "01234", "label": "x"}, {"code": "7"}], "NACE": "0112", "CPV": ["03", "1.5"], "none": []},
         "postalAddress": {"addressCountry": "France"}, "yearEstablished": 1990, "keywords": ["k"], "website": ""},
        {"_id": "b", "classifications": {}}, {"_id": "c", "classifications": {"NACE": None, "SIC": 112}}, {"_id": "d"}]
    (tmp_path / "r.json").write_text(json.dumps(records))
    got = {r["_id"]: r for r in io.read_suppliers(spark, str(tmp_path / "r.json")).collect()}
    assert got["a"].classifications == {"Kompass": ["01234", "7"], "NACE": ["0112"], "CPV": ["03", "1.5"], "none": []}
    assert got["a"].postalAddress.addressCountry == "France" and got["a"].website == "" and got["b"].website is None
    assert got["b"].classifications == {} == got["d"].classifications and got["c"].classifications == {"NACE": [], "SIC": ["112"]}
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records)))
    assert io.read_suppliers(spark, str(tmp_path / "lines.json"), lines=True).count() == 4


def test_codes_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("classification,code,label,relevant\nNACE,0112,Rice,1\nNACE,0113,Other,0\n")
    assert [tuple(r) for r in io.read_industry_codes(spark, str(tmp_path / "codes.csv")).collect()] == [("NACE", "0112", "Rice", 1)]


def test_shortlist_and_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q1", "s1", ["l0", "l1"]), ("q2", "s1", [])], "request_id string, mongo_id string, subDomains array<string>")
    io.write_shortlist(df, str(tmp_path / "short"))
    back = spark.read.json(str(tmp_path / "short"))
    assert {(r.request_id, r.mongo_id, tuple(r.subDomains)) for r in back.collect()} == {("q1", "s1", ("l0", "l1")), ("q2", "s1", ())}
    assert [tuple(r) for r in io.shortlist_report(df, 3).orderBy("request_id").collect()] == [("q1", "s1", "l0", "l1", None), ("q2", "s1", None, None, None)]
    io.export_records(df, str(tmp_path / "csv"), "csv")
    csv = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert csv.where(F.col("request_id") == "q1").first().subDomains == '["l0","l1"]'
    io.export_records(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    names = spark.createDataFrame([("b",), ("a",), (None,), ("",), ("b",)], "Ingredients string")
    assert [r[0] for r in io.distinct_products(names).collect()] == ["a", "b"]
