"""Missing and extra frames in one pass."""

from framelane.operators import completeness


def test_frames_come_as_often_as_they_are_over(spark, monkeypatch):
    monkeypatch.setattr(completeness, "FRAMES_PER_TASK", 2)
    a = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2), (None, 3)], "source_id string, frame_index long")
    b = spark.createDataFrame([("s", 1), ("s", 4), ("s", 4)], "source_id string, frame_index long")
    got = completeness.frame_differences(a, b)
    rows = sorted(map(str, map(tuple, got.collect())))
    assert rows == sorted(map(str, [("s", 1, "missing"), ("s", 2, "missing"), (None, 3, "missing"), ("s", 4, "extra"), ("s", 4, "extra")]))
    assert got.rdd.getNumPartitions() == 4  # the number of tasks follows the rows
