"""Streams cut into many micro-batches."""

import datetime
import os
import random

from paperloom.streaming.ingest import request_windows, run_to_table, stream_table


def test_windows_do_not_depend_on_the_number_or_order_of_files(spark, tmp_path):
    """Files newest first, one a batch, over 50 days: old rows count, and a request sent again batches later counts once."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    start = datetime.datetime(2025, 10, 18)
    made = [(i, start + datetime.timedelta(hours=12 * i)) for i in range(100)]
    rows = list(reversed(made))
    again = random.Random(1).sample(made, 10) + [made[99], made[0]]
    folder = tmp_path / "search_requests.parquet"
    folder.mkdir()
    for k, part in enumerate([rows[:25], rows[25:50], rows[50:75], rows[75:], again]):
        f = folder / f"part-{k}.parquet"
        pq.write_table(pa.table({"request_id": [r[0] for r in part], "requested_at": pa.array([r[1] for r in part], pa.timestamp("us"))}), f)
        os.utime(f, (1_700_000_000 + 60 * k,) * 2)
    got = run_to_table(request_windows(stream_table(spark, str(folder), files_per_batch=1)))
    assert sorted((r.window_start, r.requests) for r in got.collect()) == [(t, 1) for _, t in made]
