from __future__ import annotations

import json

import pytest

from gradeframe import schemas
from gradeframe.functions.parsing import explode_scores
from gradeframe.functions.predictor import apply_predictor
from gradeframe.operators import tables as tab
from gradeframe.sources import (
    read_baselines, read_corpus, read_items, read_predictions, read_prompt_templates, write_results,
)

ITEM = {"id": "R_1", "task_type": "temporal_reasoning", "question": "Q?", "answer": "A", "context": "line\nbreak"}


@pytest.mark.parametrize("shape", [lambda x: x, lambda x: {"items": x}, lambda x: {"data": x}])
def test_read_items(spark, tmp_path, shape):
    path = tmp_path / "items.json"
    path.write_text(json.dumps(shape([ITEM, {**ITEM, "id": "R_2"}])), encoding="utf-8")
    got = read_items(spark, str(path)).orderBy("id").collect()
    assert [r["id"] for r in got] == ["R_1", "R_2"] and got[0]["context"] == "line\nbreak" and got[0]["source"] is None


def test_read_items_with_other_wrapper(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps({"records": [ITEM]}), encoding="utf-8")
    assert read_items(spark, str(path), wrapper="records").count() == 1


def test_read_items_by_line(spark, tmp_path):
    path = tmp_path / "items.jsonl"
    path.write_text(json.dumps(ITEM) + "\n" + json.dumps({**ITEM, "id": "R_2"}) + "\n", encoding="utf-8")
    assert read_items(spark, str(path), lines=True).count() == 2


def test_read_predictions(spark, tmp_path):
    header = "id,task_type,difficulty,question,ref_answer,prediction,correct,model_version\n"
    (tmp_path / "alpha_results.csv").write_text(header + '1,t,easy,q,r,"two\nlines, ""quoted""",1,v\n2,t,easy,q,r,FAIL: x,0,v\n', encoding="utf-8")
    (tmp_path / "beta_results.csv").write_text(header + "1,t,easy,q,r,p,0,v\n", encoding="utf-8")
    got = read_predictions(spark, str(tmp_path / "*_results.csv"), {"alpha_results": "Alpha"}).collect()
    assert sorted((r["model"], r["id"], r["correct"]) for r in got) == [("Alpha", "1", 1), ("Alpha", "2", 0), ("beta_results", "1", 0)]
    assert 'two\nlines, "quoted"' in {r["prediction"] for r in got}


def test_missing_predictions_give_no_rows(spark, tmp_path):
    got = read_predictions(spark, [str(tmp_path / "none*.csv")])
    assert got.count() == 0 and got.columns == [*schemas.PREDICTIONS.names, "model"]


def test_corpus_and_templates(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.txt").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "b.md").write_text("three", encoding="utf-8")
    (tmp_path / "c.pdf").write_text("skip", encoding="utf-8")
    assert sorted((r["source"], r["text"]) for r in read_corpus(spark, str(tmp_path)).collect()) == [("a.txt", "one\ntwo"), ("b.md", "three")]
    templates = read_prompt_templates(spark, str(tmp_path / "deep")).collect()
    assert [(r["task_type"], r["template"]) for r in templates] == [("a", "one\ntwo")]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_write_results(spark, tmp_path, fmt):
    df = spark.createDataFrame([("1", 'a "b"\nc', 1, "m", "extra")], "id string, prediction string, correct int, model string, other string")
    path = str(tmp_path / fmt)
    write_results(df, path, fmt, ["id", "question", "prediction", "correct"], ["model"])
    reader = spark.read.schema("id string, question string, prediction string, correct int, model string")
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    row = reader.format(fmt).load(path).first()
    assert (row["id"], row["question"], row["prediction"], row["correct"], row["model"]) == ("1", None, 'a "b"\nc', 1, "m")


def test_baselines(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps([{"model_id": "x", "label": "X", "hf_id": "o/x", "overall": 0.8, "scores": {"REG": 0.9, "NUM": 0.7}}]))
    got = explode_scores(read_baselines(spark, str(path))).collect()
    assert sorted((r["hf_id"], r["task"], r["score"]) for r in got) == [("o/x", "NUM", 0.7), ("o/x", "REG", 0.9)]


def test_resolve_columns(spark):
    df = spark.createDataFrame([("a", 1, "x", "y")], "ID string, was_correct int, model_output string, gold string")
    assert tab.resolve_columns(df).columns == ["id", "correct", "prediction", "ref_answer"]
    with pytest.raises(KeyError, match="no correctness column"):
        tab.resolve_columns(spark.createDataFrame([("a",)], "id string"))


def test_predictor_resumes_and_records_failures(spark):
    def predict(prompt):
        if prompt == "bad":
            raise RuntimeError("x" * 200)
        return prompt.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "item_id int, prompt string")
    first = apply_predictor(df, predict).collect()
    assert {r["item_id"]: r["prediction"] for r in first} == {1: "A", 2: "FAIL: " + "x" * 80, 3: "C"}
    done = spark.createDataFrame([(r["item_id"], r["prediction"]) for r in first], "item_id int, prediction string")
    assert [r["item_id"] for r in apply_predictor(df, predict, done=done).collect()] == [2]


def test_read_items_under_any_key(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps({"version": 2, "questions": [ITEM, {**ITEM, "id": "R_2"}]}), encoding="utf-8")
    assert sorted(r["id"] for r in read_items(spark, str(path)).collect()) == ["R_1", "R_2"]
    path.write_text(json.dumps(ITEM), encoding="utf-8")
    assert [r["id"] for r in read_items(spark, str(path)).collect()] == ["R_1"]
    path.write_text("[{]", encoding="utf-8")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        read_items(spark, str(path)).collect()


def test_predictions_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("task_type,id,reference_answer,prediction,correct,note\nt,1,gold,p,1.0,x\n", encoding="utf-8")
    (tmp_path / "b c.csv").write_text('prediction,id,correct\n"q\nr",2,0\n', encoding="utf-8")
    got = {r["model"]: r for r in read_predictions(spark, str(tmp_path / "*.csv")).collect()}
    assert (got["a"]["id"], got["a"]["ref_answer"], got["a"]["correct"], got["a"]["difficulty"]) == ("1", "gold", 1, None)
    assert (got["b c"]["id"], got["b c"]["prediction"], got["b c"]["correct"]) == ("2", "q\nr", 0)
