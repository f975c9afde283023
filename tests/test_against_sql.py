"""Queries on made tables, against their SQL: zeros, ties and rows out of order, which the driver's small tables have not."""

import datetime
import itertools

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tarnwick.operators import series as S
from tarnwick.plans import catalog

START = datetime.datetime(2024, 1, 1)


def events(path, tracks, errors=()):
    """An event an hour for each value of each track; errors: (track, place from 0)."""
    rows = [(t, k, v) for t, values in tracks.items() for k, v in enumerate(values)]
    columns = {
        "event_id": [k for _, k, _ in rows], "ts": pa.array([START + datetime.timedelta(hours=k) for _, k, _ in rows], pa.timestamp("us")), "user_id": [t for t, _, _ in rows],
        "event_type": ["error" if (t, k) in errors else "view" for t, k, _ in rows], "value": [v for _, _, v in rows], "props": ["{}"] * len(rows),
    }
    pq.write_table(pa.table(columns), f"{path}/events.parquet")


def both(spark, path, name, *tables):
    """Rows of a query and of its SQL, in order."""
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(path))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, duck.execute(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall()))


def test_ratios_after_a_zero_and_at_a_tie_of_decimals(spark, tmp_path):
    events(tmp_path, {1: [3.0, 0.0, 5.0, 0.0, 0.0, 2.0], 2: [6.4, 6.71, 1.0]})
    found, wanted = both(spark, tmp_path, "successive_ratio", "events")
    assert found == wanted and "(1, 3, inf, inf)" in found and "(1, 5, nan, nan)" in found and any("1.048437," in r for r in found)


def test_colours_in_single_precision(spark, tmp_path):
    vectors = [[0.3116152584552765, 0.22763808071613312, -0.003333343891426921], [0.1, 0.2, 0.3], [-0.1, -0.1, -0.1]]
    pq.write_table(pa.table({"vec_id": [1, 2, 3], "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": [0, 1, 2]}), f"{tmp_path}/embeddings.parquet")
    found, wanted = both(spark, tmp_path, "colour_masks", "embeddings")
    assert found == wanted and "(1, 22.021277, 108.461538, 221.0, False)" in found


def test_candidates_equally_near(spark, tmp_path):
    values = [14.03, 33.7, 104.04, 54.63, 21.92, 68.37, 7.0, 3.61, 38.96, 17.6, 10.06, 27.32, 0.2, 42.49, 35.0, 9.81, 20.34, 79.24, 34.79, 13.5, 4.72, 110.09, 8.25, 46.73, 86.72, 5.53, 6.64, 6.65]
    events(tmp_path, {1: values})
    found, wanted = both(spark, tmp_path, "frame_association", "events")
    assert found == wanted


def test_a_value_that_is_the_mean_in_rows_out_of_order(spark, tmp_path):
    values = [
        6.81, 53.24, 20.32, 58.22, 25.57, 48.45, 82.17, 163.86, 14.95, 5.16, 0.06, 74.47, 49.03, 5.92, 20.39, 51.39, 66.61, 5.82, 33.63, 26.9, 22.64, 61.76, 38.28, 18.58, 84.03, 136.26, 20.12, 8.96, 2.16, 6.87,
        126.89, 37.89, 34.77, 36.35, 69.69, 66.61, 13.17, 111.92, 21.62, 10.87, 12.81, 14.38, 12.12, 38.62, 44.84, 16.41, 35.87, 91.28, 32.51, 44.21, 17.63, 79.33, 136.56, 36.63, 78.72, 52.04, 82.26, 59.85,
    ]
    errors = {(2, k) for k in (1, 2, 4, 13, 30, 41, 43, 51, 55, 57)}
    events(tmp_path, {2: values}, errors)
    found, wanted = both(spark, tmp_path, "measured_periods", "events")
    assert found == wanted
    rows = [(2, k, float(k), v, (2, k) not in errors) for k, v in enumerate(values)]
    orders = [rows, rows[::-1], sorted(rows, key=lambda r: r[3]), sorted(rows, key=lambda r: -r[3]), sorted(rows, key=lambda r: r[1] * 7 % 58)]
    frames = [spark.createDataFrame(o, "track long, i int, t double, y double, valid boolean").coalesce(1) for o in orders]
    assert len({S.crossing_period(df).first() for df in frames}) == 1


def without_a_track_or_a_time(path):
    """Twelve frames of no track, and of track 1 a frame early in the table without a time."""
    events(path, {1: [500.0 + k for k in range(12)], 2: [40.0] * 12, None: [600.0] * 12})
    t = pq.read_table(f"{path}/events.parquet")
    pq.write_table(t.set_column(1, "ts", pa.array([None if k == 3 else v for k, v in enumerate(t["ts"].to_pylist())], pa.timestamp("us"))), f"{path}/events.parquet")


def test_arrival_without_a_track_or_a_time(spark, tmp_path):
    without_a_track_or_a_time(tmp_path)
    found, wanted = both(spark, tmp_path, "arrival_speed", "events")
    assert found == wanted and len(found) == 2


def test_arrivals_of_pairs_without_a_track_or_a_time(spark, tmp_path):
    without_a_track_or_a_time(tmp_path)
    found, wanted = both(spark, tmp_path, "measured_arrivals", "events")
    assert found == wanted and len(found) == 2


def test_crossings_just_below_half_a_millisecond(spark, tmp_path):
    """A time of ...1134999 s: its thousandfold is ...113.5 as a double, and goes up."""
    events(tmp_path, {1: [10.0] + [0.0] * 9})
    t = pq.read_table(f"{tmp_path}/events.parquet")
    times = [START + datetime.timedelta(microseconds=126_111 * k) for k in range(10)]
    pq.write_table(t.set_column(1, "ts", pa.array(times, pa.timestamp("us"))), f"{tmp_path}/events.parquet")
    found, wanted = both(spark, tmp_path, "zero_crossings", "events")
    assert found == wanted == ["(1, 1, 1704067200.114)"]


def test_crossings_without_a_time_or_a_value(spark, tmp_path):
    """A crossing to a frame without a time has none, but counts; a frame without a value breaks the track."""
    events(tmp_path, {1: [9.0, 0.0, 9.0, 0.0, 0.0, 9.0, 3.0, 0.0], 2: [9.0, None, 0.0, 9.0, 0.0, None, 9.0, 0.0, 8.0], 3: [9.0, 0.0, 9.0, 0.0, 9.0, 0.0]})
    t = pq.read_table(f"{tmp_path}/events.parquet")
    times = [None if (u, k) in ((1, 2), (3, 0), (3, 1)) else v for u, k, v in zip(t["user_id"].to_pylist(), t["event_id"].to_pylist(), t["ts"].to_pylist())]
    pq.write_table(t.set_column(1, "ts", pa.array(times, pa.timestamp("us"))), f"{tmp_path}/events.parquet")
    for name in ("zero_crossings", "period_from_crossings", "full_cycle_period", "measured_periods", "release_return"):
        found, wanted = both(spark, tmp_path, name, "events")
        assert found == wanted, name
    assert sum(r.endswith("None)") for r in both(spark, tmp_path, "zero_crossings", "events")[0]) == 3


def test_ratios_of_negative_values_and_at_the_end_of_doubles(spark, tmp_path):
    events(tmp_path, {1: [3.0, -6.0, -1.5, 2.0, 0.0, -4.0], 2: [1e-300, 8.703675918979745, 2.0, 1e306]})
    found, wanted = both(spark, tmp_path, "successive_ratio", "events")
    assert found == wanted and "(1, 2, -2.0, nan)" in found and "(1, 3, 0.25, 0.5)" in found


def test_arrival_at_the_bound_to_the_cent(spark, tmp_path):
    """A way of just 4000.00, which doubles summed in order miss by a rounding; one whose values no decimal of the width holds is summed as doubles."""
    way = [71.68] * 39 + [1204.48, 1.0]
    assert list(itertools.accumulate(way))[39] < 4000
    events(tmp_path, {2: way, 4: [1e300, 1.0, 2.0], 6: [float("inf")] * 4})
    found, wanted = both(spark, tmp_path, "arrival_speed", "events")
    assert found == wanted and any(r.startswith("(2, 40, 0.022") for r in found)
    one = spark.createDataFrame([(2, k, float(k), v) for k, v in enumerate(way[39::-1])], "track long, i int, t double, y double")
    assert S.arrival(S.way(one), 4000).first().arrival == 39


def test_arrivals_at_the_bound_to_the_cent_and_of_negative_tracks(spark, tmp_path):
    """Tracks are halved towards zero: -2 and -3 are a pair, and -1 and 1 one track."""
    way = [52.57] * 39 + [949.77, 1.0]
    assert list(itertools.accumulate(way))[39] < 3000
    events(tmp_path, {2: way})
    found, wanted = both(spark, tmp_path, "measured_arrivals", "events")
    assert found == wanted and "('1', 't_metal', 40.0)" in found
    events(tmp_path, {-3: [300.0] * 12, -2: [400.0] * 12, -1: [200.0] * 12, 0: [500.0] * 12, 1: [100.0] * 12, 2**53 + 3: [350.0] * 12})
    found, wanted = both(spark, tmp_path, "measured_arrivals", "events")
    assert found == wanted and len(found) == 10
