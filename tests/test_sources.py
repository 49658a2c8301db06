"""Sources and streams on small files."""

from datetime import datetime, timedelta

from corvida.sources import files
from corvida.streaming import jobs


def events(spark, low, high):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + timedelta(minutes=i), 1, "click", 1.0, "{}") for i in range(low, high)], jobs.EVENTS).coalesce(1)


def test_retained_over_batches_and_a_restart(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    for low in (0, 40, 80):
        events(spark, low, low + 40).write.mode("append").parquet(folder)

    def run():
        stream = jobs.source(spark, folder, "*.parquet", files_per_trigger=1)
        return sorted(r["event_id"] for r in jobs.retained(stream, jobs.latest(60), "kept", table).collect())

    assert run() == list(range(60, 120))
    assert len(list((tmp_path / "table").glob("v*"))) == 3
    assert run() == list(range(60, 120))  # started again with nothing new
    events(spark, 120, 130).write.mode("append").parquet(folder)
    assert run() == list(range(70, 130))


def test_typed_csv_has_a_header_in_each_file(spark, tmp_path):
    for name, rows in (("a", "one,x|y,1/2/2023\n"), ("b", "two,z,\n,w,\n")):
        (tmp_path / f"{name}.csv").write_text("text,string_tag,date_when\n" + rows)
    got = {r["text"]: [(m["name"], m["value"]) for m in r["metadata"]] for r in files.typed_csv(spark, str(tmp_path)).collect()}
    assert got == {"one": [("tag", "x"), ("tag", "y"), ("when", "1.6726176E9")], "two": [("tag", "z")]}


def test_survey_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("title,text & string,text,number\nName,Why,How,Age\nann,because,so,7\nbob,,well,\n")
    got = sorted((r["row"], r["title"], r["text"], sorted((m["name"], m["value"]) for m in r["metadata"])) for r in files.survey_csv(spark, str(tmp_path / "s.csv")).collect())
    assert got == [
        (0, "ann", "because", [("Age", "7.0"), ("Question", "Why"), ("Why", "because")]),
        (0, "ann", "so", [("Age", "7.0"), ("Question", "How"), ("Why", "because")]),
        (1, "bob", "well", [("Question", "How")]),
    ]
