import gzip
import struct

from crestline.model import top
from crestline.sources import topics, traces


def test_access_log(spark, tmp_path):
    rows = [(0, c, o, 9, 1, 1, 1, s) for c, o, s in [(1, 7, 0), (1, 8, 0), (2, 7, 1), (0, 7, 1)]]
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(struct.pack(traces.ACCESS, *r) for r in rows) + b"\0" * 7))
    got = {tuple(r) for r in traces.access_log(spark, f"{tmp_path}/*.gz", True).collect()}
    assert got == {(0, 1, 2), (1, 2, 1), (1, 0, 1)}
    assert [tuple(r) for r in top(traces.access_log(spark, f"{tmp_path}/*.gz", False), 1).collect()] == [(7, 3)]


def test_home_ip(spark, tmp_path):
    def record(client, server, url):
        return struct.pack(traces.HOME_IP, 0, 0, 0, 0, 0, 0, client, 0, server, 0, 0, 0, 0, 0, 0, 0, 0, len(url)) + url

    (tmp_path / "b.gz").write_bytes(gzip.compress(record(5, 23, b"GET 42.html HTTP/1.0") + record(6, 13, b"GET 42.gif HTTP/1.0") + record(6, 4, b"GET x HTTP/1.0")))
    assert {tuple(r) for r in traces.home_ip(spark, f"{tmp_path}/b.gz", False).collect()} == {(3, 42, 2)}
    assert {tuple(r) for r in traces.home_ip(spark, f"{tmp_path}/b.gz", True).collect()} == {(3, 5, 1), (3, 6, 1), (4, 6, 1)}


def test_search_results(spark, tmp_path):
    (tmp_path / "r.txt").write_text("noise\n0 Q0 docB 1 -1.5 run\n0 Q0 docA 2 -3.0 run\n1 Q0 docB 1 0.25 run\n")
    got = {tuple(r) for r in traces.numbered(traces.search_results(spark, str(tmp_path / "r.txt"))).collect()}
    assert got == {(0, 1, 2500), (0, 0, 1000), (1, 1, 4250)}


def test_topics(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<webtrack><topic number="1"><description>\n  find "red" cars? </description></topic><topic number="2"><description>the cars.</description></topic></webtrack>')
    found = topics.topics(spark, str(tmp_path / "t.xml"))
    assert {tuple(r) for r in found.collect()} == {(1, "find red cars"), (2, "the cars")}
    words = topics.vocabulary(found)
    assert {tuple(r) for r in words.collect()} == {("cars", 0), ("find", 1), ("red", 2), ("the", 3)}
    results = spark.createDataFrame([(0, 5, 9), (2, 5, 4), (1, 6, 1)], "node_id long, item_id long, score long")
    assert {tuple(r) for r in topics.topic_lists(found, results, 2).collect()} == {(0, 5, 9)}
    topics.write_queries(words, str(tmp_path / "q"), 3)
    assert spark.read.format("xml").option("rowTag", "query").load(str(tmp_path / "q")).count() == 4
