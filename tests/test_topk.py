"""Protocols against the naive answer, steps against DuckDB, codecs by round trip."""

import random

import duckdb
import pytest

from crestline import registry
from crestline.functions import bits, sizing
from crestline.model import placed, top
from crestline.operators import report
from crestline.operators.protocols import PROTOCOLS
from crestline.operators.sketches import cost_ranges
from crestline.sources import lists

SF = "/root/testdata/sf0.001"
EXACT = [n for n, (exact, _) in PROTOCOLS.items() if exact]


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.sql(lists.zipf_sql(5, 200, 1.0, 0.5, 20, 7)).cache()


@pytest.mark.parametrize("name", EXACT)
def test_exact(skewed, name):
    want = [tuple(r) for r in top(skewed, 10).collect()]
    assert [tuple(r) for r in PROTOCOLS[name][1](skewed, 10).frame.collect()] == want


@pytest.mark.parametrize("name", [n for n in PROTOCOLS if n not in EXACT])
def test_approximate(skewed, name):
    truth = {r.item_id: r.score for r in top(skewed, 10**6).collect()}
    got = PROTOCOLS[name][1](skewed, 10).frame.collect()
    assert len(got) == 10 and all(r.score <= truth[r.item_id] for r in got)


def oracle(name):
    db = duckdb.connect()
    for t in ("lineitem", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db.sql(registry.oracle_sql()[name])


def same(spark, name):
    got, want = registry.queries()[name](spark, SF), oracle(name)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    want = want.project(",".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


@pytest.mark.parametrize("name", ["f3_prefix_one_below", "f7_upper_bound_prune", "j8_missing_estimate", "j9_score_range", "a12_over_under", "a14_kth_bounds", "a16_histogram", "w4_last_match", "x5_bloom_size", "x7_gcs_modulus", "x8_count_min_size", "i7_count_min_query", "i16_golomb_bits", "m5_distance", "k4_overview"])
def test_steps(spark, name):
    assert same(spark, name)


@pytest.mark.parametrize("name", ["t1_total_order", "w3_differences", "x10_log_scale", "o3_cell_difference", "s18_unique"])
def test_whole_steps(spark, name):
    assert same(spark, name)


def test_bytes_are_those_of_rounds(spark):
    rows = registry.export_rows(spark, SF).collect()
    for r in rows:
        assert r.bytes == sum(r[f"r{i}_sketch_bytes"] + 100 * r[f"r{i}_transferred_items_sum"] for i in range(1, 5))
    assert [r.rounds for r in rows] == [1, 1, 2, 3]
    same(spark, "k1_export")


def test_export_files_add_up(spark, tmp_path):
    rows = report.export(spark.sql(lists.zipf_sql(3, 50, 1.0, 0.5, 5, 7)), ["p1_naive"], 5, n=50)
    for _ in range(2):
        report.write_tsv(rows, str(tmp_path / "out"))
    again = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out"))
    assert again.count() == 2 and again.columns == rows.columns


def plain_ranges(scores, end, entries, modulus):
    """Ranges of one sorted list by walking down it."""
    out, at, left = [], 0, entries
    while at < len(scores) and scores[at] >= end and scores[at] > 0:
        width = (scores[at] - end) // left
        planned = low = scores[at] - width
        while True:
            rows = sum(low <= s <= scores[at] for s in scores)
            m = modulus(0, rows, scores[at])
            if m or not width:
                break
            width //= 2
            low = scores[at] - width
        if not m:
            break
        out.append((scores[at], low, m, rows))
        at += rows
        left -= 1
        if at < len(scores) and scores[at] >= planned or not left:
            break
    return out, scores[at] if at < len(scores) else 0


@pytest.mark.parametrize("limit", [0, 1, 4, 1000])
def test_cost_ranges(spark, limit):
    rng = random.Random(limit)
    scores = {n: sorted((int(1000 * rng.random() ** 3) for _ in range(60)), reverse=True) for n in (0, 1)}
    x = spark.createDataFrame([(n, i, s) for n, own in scores.items() for i, s in enumerate(own)], "node_id long, item_id long, score long")

    def modulus(node, rows, top):
        return 64 if rows <= limit else 0

    made, cutoffs = cost_ranges(x, {n: (own[0], 20, 5) for n, own in scores.items()}, modulus)
    for n, own in scores.items():
        want, cutoff = plain_ranges(own, 20, 5, modulus)
        assert [(r[2], r[3], r[4], r[5]) for r in made if r[0] == n] == want
        assert cutoffs[n] == cutoff


def test_places_with_ties_and_without_rows(spark):
    x = spark.createDataFrame([(i % 7, i) for i in range(200)], "a long, b long")
    got = sorted((r.place, r.a, r.b) for r in placed(x, ["a", "b"]).collect())
    assert got == [(i, *ab) for i, ab in enumerate(sorted(((i % 7, i) for i in range(200)), reverse=True))]
    assert placed(x.where("a > 9"), ["a"]).count() == 0


@pytest.mark.parametrize("name", [n for n in EXACT if n[:3] in ("p1_", "p4_", "p9_", "p10")])
def test_empty_lists(spark, name):
    empty = spark.createDataFrame([], "node_id long, item_id long, score long")
    assert PROTOCOLS[name][1](empty, 10).frame.collect() == []


def test_rounds_send_nothing_twice(skewed):
    r = PROTOCOLS["p4_tput"][1](skewed, 10)
    from crestline.operators.protocols import sent

    rows = sent(r.rounds)
    assert rows.count() == rows.select("node_id", "item_id").distinct().count()


def test_codecs():
    rng = random.Random(1)
    values = sorted(rng.sample(range(10_000), 1_000))
    assert bits.golomb_decode(bits.golomb_encode(values)) == values
    assert bits.unpack(bits.pack(values)) == values
    assert sizing.power_of_two(1448) == 1024 and sizing.gcs_modulus(10, 1.5) == 0
