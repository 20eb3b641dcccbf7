from ratingscope.sources import sessions

FILE = """﻿Course,COURSE-S1-2024
Session Name,Peer Feedback Session 4 - S1, 2024
Question 1,"What went well, in words?"
Team,Giver's Name,a,b,c,d,e
T9,x,x@,,y,y@,3
Question 2,"Distribute a total of 60 points for the source code, all members"
Summary Statistics
Team,Recipient,Recipient Email,Total Points,Average Points,Points Received
T1,Ann,a@,21,10,x
T1,"Lee, Bob",b@,99,10,x
Team,Giver's Name,Email,Role,Recipient,Recipient Email,Points
T1,Ann,a@,,Ann,a@,10
T1,Ann,a@,,"Lee, Bob",b@,12
T1,Ann,a@,,"Lee, Bob",b@,14
T1,Ann,a@,,"Lee, Bob",b@,No Response
T1,"Lee, Bob",b@,,Ann,a@,11
T1,"Lee, Bob",b@,,"Lee, Bob",b@,Equal share + 5%
T1,"Lee, Bob",b@,,"Lee, Bob",b@,10d
T1,"Lee, Bob",b@,,Cy,c@,
T1,Cy,c@,,Ann,a@,N/A
T1,Cy,c@,,Cy,c@,Not Submitted
short,row
,Ann,a@,,Ann,a@,5
"""


def parsed(spark, tmp_path):
    (tmp_path / "one.csv").write_text(FILE, encoding="utf-8")
    (tmp_path / "skip.txt").write_text(FILE, encoding="utf-8")
    return sessions.parse(sessions.read_lines(spark, str(tmp_path)))


def test_parse(spark, tmp_path):
    out = parsed(spark, tmp_path)
    rows = out["ratings"].collect()
    assert {(r.year, r.semester, r.session_number, r.team, r.question) for r in rows} == {("2024", "S1", 4, "T1", "source code")}
    got = {(r.giver, r.recipient): r.score for r in rows}
    assert len(got) == 9
    assert got["a@", "b@"] == 14 and got["b@", "a@"] == 11 and got["b@", "b@"] is None and got["c@", "a@"] is None and got["c@", "b@"] is None
    assert {r.email: r.name for r in out["names"].collect()} == {"a@": "Ann", "b@": "Lee, Bob", "c@": "Cy"}
    assert {r.email: r.stated for r in out["summary"].collect()} == {"a@": 21.0, "b@": 99.0}


def test_diagnostics_and_round_trip(spark, tmp_path):
    out = parsed(spark, tmp_path)
    full = sessions.read_sessions(spark, str(tmp_path))
    events = {(r.event, r.student_email) for r in full["diagnostics"].collect()}
    assert ("rater_missing", "c@") in events and ("summary_cross_check", "b@") in events and ("summary_cross_check", "a@") not in events
    again = sessions.parse(sessions.as_lines(out["ratings"]))["ratings"]
    key = lambda r: (r.giver, r.recipient, r.score is None, r.score or 0)
    assert sorted(map(key, again.collect())) == sorted(map(key, out["ratings"].collect()))


def test_a_folder_without_files_is_an_error(spark, tmp_path):
    import pytest

    with pytest.raises(FileNotFoundError, match="no CSV files"):
        sessions.read_lines(spark, str(tmp_path))


def test_lines_are_read_once_for_marks_and_once_for_ratings(spark, tmp_path):
    """The grid has one shuffle of the rows, whose two uses are the same; the later score of a pair counts unless it is missing."""
    from pyspark.sql import functions as F

    from ratingscope.operators import members
    from ratingscope.schema import KEYS

    (tmp_path / "one.csv").write_text(FILE, encoding="utf-8")
    sessions.read_lines(spark, str(tmp_path)).write.parquet(str(tmp_path / "lines"))
    out = sessions.parse(spark.read.parquet(str(tmp_path / "lines")))
    columns = [*KEYS, "giver", "recipient", "score"]
    want, got = members.grid(out["rows"], KEYS).select(columns), out["ratings"].select(columns)
    assert got.count() == 9 and want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
    plan = out["ratings"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 2 and "SortMergeJoin" not in plan
    assert out["ratings"].where(F.col("year") != "2024").count() == 0
