"""What a Python task holds at once does not grow with the table."""

import numpy as np

from glossmill.operators import landmarks as L
from glossmill.operators import segments as S


def test_walks_stream_rows_and_pack_no_block(spark, monkeypatch):
    sizes, written = {}, S.written
    monkeypatch.setattr(S, "written", lambda df, name="table": sizes.setdefault(name, written(df, name)))
    rows = spark.createDataFrame([(i % 3, i * 10, i * 10 + 5) for i in range(300)], "video_id long, start_ms long, end_ms long")
    assert sum(r.parts for r in S.merge_short_intervals(rows, 4, 1000, 100).collect()) == 300
    assert sizes["blocks"].count() == 300


def test_clips_go_through_arrow_as_they_are():
    clips = [np.arange(24.0).reshape(2, 4, 3), np.full((1, 4, 3), 7.5), np.zeros((0, 0, 0))]
    lists = L._clip_lists(clips)
    assert lists.to_pylist() == [x.tolist() for x in clips]
    assert [L._clip_array(x).tolist() for x in lists] == [x.tolist() for x in clips]
    hidden = L._clip_lists([np.array([[[1.0, np.nan]]])])
    assert hidden.to_pylist() == [[[[1.0, None]]]] and np.isnan(L._clip_array(hidden[0])[0, 0, 1])
