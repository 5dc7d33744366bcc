"""The probe of JSON files parses a record once."""

from tidemark.operators.schema_infer import json_file_schemas


def test_probe_parses_a_record_once(spark, capsys):
    lines = spark.createDataFrame(
        [('{"a": 1}', "x"), ('{"a": 1', "x"), ("  ", "x"), (None, "x"), ('{"b": "t"}', "y"), ("", "z"), ("{", "z")],
        "value string, _source_file string",
    )
    found = json_file_schemas(lines, file="_source_file")
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("parseJson(") == 1
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == {"x": ("OBJECT<a: BIGINT>", 2, 1), "y": ("OBJECT<b: STRING>", 1, 0), "z": ("VOID", 1, 1)}
