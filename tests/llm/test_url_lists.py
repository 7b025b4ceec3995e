import datetime as dt

from epigrain.llm import url_lists


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def plain(captures, entries):
    """Plays every pattern's entries in order up to the capture's time."""
    out = []
    for page_id, url, at in captures:
        active = {}
        for name, allows, pattern, action, when in sorted((e for e in entries if None not in e), key=lambda e: (e[4], e[3])):
            if at is not None and when <= at:
                active[name, allows, pattern.lower()] = action == "add"
        host, _, path = (url or "").partition("://")[2].lower().partition("#")[0].partition("?")[0].partition("/")
        host = host.rpartition("@")[2].partition(":")[0]
        hits = [
            (name, allows)
            for (name, allows, p), on in active.items()
            if on and host and (host == p or host.endswith("." + p) or ("/" in p and f"{host}/{path}".startswith(p)))
        ]
        block, allow = sum(not a for _, a in hits), sum(a for _, a in hits)
        out.append((page_id, url, at, block > 0 and not allow, block, allow, ",".join(sorted({n for n, _ in hits}))))
    return sorted(out, key=repr)


def test_matches_a_plain_version(spark):
    entries = [
        ("bad", False, "Evil.example", "add", day(10)), ("bad", False, "evil.example", "remove", day(20)), ("bad", False, "evil.example", "add", day(30)),
        ("bad", False, "evil.example", "add", day(30)), ("bad", False, "same.example", "add", day(5)), ("bad", False, "same.example", "remove", day(5)),
        ("dirs", False, "site.example/a/b/", "add", day(0)), ("ok", True, "good.evil.example", "add", day(12)), ("bad", False, None, "add", day(1)),
        ("bad", False, "x.example", "add", None), ("tld", False, "example", "add", day(100)), ("bad", False, "never.example", "remove", day(1)),
    ]
    urls = [
        "http://evil.example/", "https://www.EVIL.example:80/x?y#z", "http://good.evil.example/", "http://notevil.example", "http://same.example/",
        "http://site.example/a/b/c", "http://site.example/a/b", "http://site.example/A/b/?q=/", "http://u@evil.example/", None, "", "no url",
        "http://x.example/" + "d/" * 3000, "http://" + "a." * 1000 + "evil.example/",
    ]
    captures = [(i % 5, u, day(n)) for i, u in enumerate(urls) for n in (5, 10, 15, 20, 25, 30, 120)] + [(1, urls[0], None)]
    frame = spark.createDataFrame([(*c, "x") for c in captures], "page_id long, url string, fetched_at date, row string")
    lists = spark.createDataFrame(entries, "list_name string, allows boolean, pattern string, action string, at date")
    assert sorted((tuple(r) for r in url_lists.judge(frame, lists).collect()), key=repr) == plain(captures, entries)
    assert url_lists.judge(frame, lists.limit(0)).where("blocked").isEmpty()
    assert url_lists.judge(frame.limit(0), lists).isEmpty()
