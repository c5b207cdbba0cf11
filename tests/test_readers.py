"""JSON and CSV reads with a rule for records that do not fit, and one shape for choices."""

import os

import pytest
from pyspark.sql import functions as F

from kdframe.sources import readers as rd


def _file(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


JSON = '{"a": 1, "b": "x"}\n{"a": "no", "b": "y"}\nbroken\n{"a": 3}\n'
CSV = 'a,b\n1,"x ""q"", y"\nno,y\n3,\n'


@pytest.mark.parametrize("fmt,text,n_bad", [("json", JSON, 2), ("csv", CSV, 1)])
def test_corrupt_records(spark, tmpdir_path, fmt, text, n_bad):
    path = _file(tmpdir_path, f"t.{fmt}", text)
    schema = "a long, b string"
    with pytest.raises(Exception):
        rd.read_dataset(spark, path, fmt, schema).collect()
    dropped = rd.read_dataset(spark, path, fmt, schema, corrupt="drop").collect()
    assert [r.a for r in dropped] == [1, 3]
    kept = rd.read_dataset(spark, path, fmt, schema, corrupt="keep").cache()
    assert [r[0] for r in kept.where(F.col(rd.CORRUPT_COLUMN).isNull()).select("a").collect()] == [1, 3]
    assert kept.where(F.col(rd.CORRUPT_COLUMN).isNotNull()).count() == n_bad
    kept.unpersist()
    with pytest.raises(ValueError, match="schema"):
        rd.read_dataset(spark, path, fmt)


def test_csv_text_is_as_written(spark, tmpdir_path):
    path = _file(tmpdir_path, "t.csv", 'a,b\n1,"x ""q"", y"\n2," two\nlines "\n3,\n')
    assert [r.b for r in rd.read_dataset(spark, path, "csv", "a long, b string", multiLine=True).collect()] == ['x "q", y', " two\nlines ", None]


def test_choices_of_every_shape(spark, tmpdir_path):
    lines = ['{"item_id": 1, "question": "q", "answerKey": "B", "choices": ["u", "v"]}',
             '{"item_id": 2, "question": "q", "answerKey": "2", "choices": {"text": ["u", "v"], "label": ["1", "2"]}}',
             '{"item_id": 3, "question": "q", "answerKey": "A", "choices": {"text": ["u", "v", "w"]}}',
             '{"item_id": 4, "question": "q", "answerKey": "A", "choices": []}',
             '{"item_id": 5, "question": "q", "answerKey": "A", "choices": null}',
             '{"item_id": 6, "question": "q", "choices": "u"}']
    got = {r.item_id: r.choices and (r.choices.text, r.choices.label) for r in rd.read_choices(spark, _file(tmpdir_path, "c.json", "\n".join(lines))).collect()}
    assert got == {1: (["u", "v"], ["A", "B"]), 2: (["u", "v"], ["1", "2"]), 3: (["u", "v", "w"], ["A", "B", "C"]), 4: ([], []), 5: None, 6: None}
