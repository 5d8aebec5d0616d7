from datetime import datetime

from trustlake.llm import url_filter

ENTRY = "kind string, pattern string, verdict string, action string, at timestamp, page_id string"
CAPTURE = "page_id long, url string, fetched timestamp, kind string"


def day(n, hour=0):
    return datetime(2024, 1 + (n - 1) // 28, 1 + (n - 1) % 28, hour)


def decide(spark, captures, entries):
    captures = spark.createDataFrame([(*c, "x") for c in captures], CAPTURE)
    entries = spark.createDataFrame([(*e, "x") for e in entries], ENTRY)
    rows = url_filter.evaluate(captures, entries).collect()
    return sorted((r.page_id or 0, r.blocked, r.listed, r.kind, r.pattern) for r in rows)


def test_entries_hold_from_add_to_remove(spark):
    entries = [
        ("host", "a.com", "deny", "add", day(3)),
        ("host", "a.com", "deny", "add", day(5)),  # it is listed already
        ("host", "a.com", "deny", "remove", day(40)),
        ("host", "a.com", "deny", "add", day(90)),
    ]
    url = "http://A.com/x"
    days = {1: 2, 2: 3, 3: 39, 4: 40, 5: 89, 6: 90, 7: 200}
    got = decide(spark, [(i, url, day(d)) for i, d in days.items()], entries)
    assert [blocked for _, blocked, *_ in got] == [False, True, True, False, False, True, True]


def test_the_most_specific_pattern_decides(spark):
    t = day(1)
    entries = [
        ("domain", "a.com", "deny", "add", t),
        ("domain", "b.a.com", "allow", "add", t),
        ("prefix", "b.a.com/x/", "deny", "add", t),
        ("url", "b.a.com/x/ok?q=1", "allow", "add", t),
        ("host", "both.org", "deny", "add", t),
        ("host", "both.org", "allow", "add", t),
    ]
    captures = [
        (1, "https://www.a.com", day(2)),
        (2, "https://u:p@b.a.com:8080/y#f", day(2)),
        (3, "https://b.a.com/x/z", day(2)),
        (4, "https://b.a.com/x/ok?q=1#f", day(2)),
        (5, "https://both.org/", day(2)),
        (6, "https://xa.com/", day(2)),
    ]
    assert decide(spark, captures, entries) == [
        (1, True, 1, "domain", "a.com"),
        (2, False, 2, "domain", "b.a.com"),
        (3, True, 3, "prefix", "b.a.com/x/"),
        (4, False, 4, "url", "b.a.com/x/ok?q=1"),
        (5, False, 2, "host", "both.org"),
        (6, False, 0, None, None),
    ]


def test_edges(spark):
    t, url = day(1), "http://a.com/"
    entries = [
        ("host", "a.com", "deny", "add", t), ("host", "a.com", "deny", "remove", t),  # add wins
        ("host", None, "deny", "add", t), ("host", "b.com", "deny", "add", None),
        ("planet", "b.com", "deny", "add", t), ("host", "b.com", "maybe", "add", t),
        ("host", "b.com", "deny", "drop", t),
    ]
    captures = [(1, None, day(2)), (2, "", day(2)), (3, "no url", day(2)), (4, url, None), (5, url, day(2)),
                (5, url, day(2)), (5, "http://b.com/" + "x/" * 2000, day(2)), (None, url, day(2))]
    got = decide(spark, captures, entries)
    assert [(n, blocked) for n, blocked, *_ in got] == [
        (0, True), (1, False), (2, False), (3, False), (4, False), (5, False), (5, True), (5, True),
    ]
    assert decide(spark, captures[:1], entries) == [(1, False, 0, None, None)]
    assert decide(spark, [], entries) == []
    assert [r[1] for r in decide(spark, captures, [])] == [False] * 8


def test_many_captures_of_a_host(spark):
    """A host with most captures is dealt into cells that each get its intervals."""
    entries = [("host", "a.com", "deny", "add" if d % 2 else "remove", day(d)) for d in range(1, 60)]
    captures = [(i, f"http://a.com/{i}", day(1 + i % 60, 12)) for i in range(600)]
    got = decide(spark, captures, entries)
    assert [blocked for _, blocked, *_ in got] == [
        1 + i % 60 == 59 or 1 + i % 60 == 60 or (1 + i % 60) % 2 == 1 for i in range(600)
    ]
