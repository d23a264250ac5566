import json

import pytest

from siteloom.operators import chooser


def test_a_failing_model_is_silent():
    calls = []

    def call(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return "yes"

    assert chooser.ask(call, "p") == "yes" and len(calls) == 3
    assert chooser.ask(lambda p: 1 / 0, "p") == "" and chooser.ask(lambda p: None, "p") == ""


@pytest.mark.parametrize(("text", "value"), [(None, {}), ("no", {}), ("[1]", {}), ('x {"a": {"b": 1}} y', {"a": {"b": 1}}), ("{broken}", {}), ('{"a":1} {"b":2}', {})])
def test_json_object(text, value):
    assert chooser.json_object(text) == value


def test_proposals_and_picks(spark):
    texts = spark.createDataFrame([(1, "Acme"), (2, None)], "page_id long, text string")
    got = chooser.proposals(texts, lambda p: '{"name": "Acme", "city": ""}' if "Acme" in p else "nothing").collect()
    assert [tuple(r) for r in got] == [(1, "name", "Acme")]
    ranked = spark.createDataFrame([("a", "q", 1, "u", "t"), ("a", "q", 2, "u", "good"), ("b", "q", 1, "u", "t"), ("c", "q", 1, "u", "bad")], "qid string, query string, rank int, url string, text string")
    got = chooser.picks(ranked, lambda p: '{"index": 1}' if "[1] u\ngood" in p else '{"index": "x"}' if "bad" in p else '{"index": null}').collect()
    assert sorted((r.qid, r.pick) for r in got) == [("a", 1), ("b", None)]


def test_command_line(spark, data, tmp_path, capsys):
    from siteloom.__main__ import main

    site = spark.read.parquet(f"{data}/sites.parquet").first().site
    assert main(["--data", data, "--site", site, "--query", "what are the hours?", "--out", str(tmp_path), "--master", "local[2]"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["nap_fields"] == 7 and (tmp_path / "query.txt").read_text() == "what are the hours?"
    assert {p.name for p in tmp_path.iterdir()} == {"audit.json", "nap_report.json", "answer.json", "run_meta.json", "demo_url.txt", "query.txt"}
