import base64
import hashlib

from pyspark.sql import functions as F

from epigrain.llm import warc
from epigrain.llm.shared import new_folder


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, digest string, key long")


ROWS = [
    (5, "http://a.example/x", "<p>é one</p>"), (2, "http://a.example/y\r\nX: 1", "<p>é one</p>"), (9, None, None), (7, "http://b.example", ""),
    (3, "http://ü.example/ä", "z" * 300_000), (None, "http://c.example", "<p>é one</p>"), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (4, "v", "z" * 300_000),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    got = {r.page_id: tuple(r)[1:] for r in warc.page_round_trip(pages_of(spark, ROWS)).collect()}
    first = {}
    for page_id, _, html in ROWS:
        if page_id is not None:
            first[digest(html)] = min(first.get(digest(html), page_id), page_id)
    want = {}
    for page_id, _, html in ROWS:
        d = digest(html)
        own = page_id == first[d]
        want[page_id] = (len((html or "").encode()), d, "response" if own else "revisit", None if own else first[d])
    assert got == want


def test_payloads_and_filters(spark):
    folder = new_folder(spark, "w")
    warc.write_warc(pages_of(spark, ROWS), folder)
    archive = warc.read_warc(spark, folder)
    whole = {r.record_id: r for r in archive.collect()}
    assert bytes(whole["<urn:page:3>"].payload) == b"z" * 300_000 and whole["<urn:page:4>"].payload is None
    assert whole["<urn:page:2>"].target_uri == "http://a.example/y%0D%0AX:%201"
    revisits = archive.where("record_type = 'revisit'")
    assert "PythonScan" in revisits._jdf.queryExecution().toString() or revisits.count() == 4
    assert revisits.where(F.col("target_uri").startswith("http")).count() == 2
    assert archive.where(F.col("refers_to").isNull()).count() == 4
    assert archive.where(F.col("record_id").isin("<urn:page:8>", "none")).count() == 1


def test_unwanted_payloads_are_stepped_over(tmp_path):
    path = tmp_path / "x.warc.gz"
    sha = hashlib.sha1(b"").hexdigest()
    with open(path, "wb") as out:
        for i in range(20):
            kind = "response" if i % 2 else "revisit"
            out.write(warc.member(warc.record(kind, f"<r:{i}>", "u", None, sha, 0, b"p" * 50_000)))
    kept = warc._Members(str(path), window=4096)

    class Only:
        attribute = ("record_type",)
        value = "revisit"

    only = warc.EqualTo(("record_type",), "revisit")
    assert [h["record_id"] for h, _ in kept.records([only])] == [f"<r:{i}>" for i in range(0, 20, 2)]
    assert kept.inflated == 10
    import gzip

    other = tmp_path / "y.warc.gz"  # members without a stated length
    other.write_bytes(b"".join(gzip.compress(warc.record("response", f"<r:{i}>", "u", None, sha, 0, b"q" * 9000 * i)) for i in range(9)))
    read = list(warc._Members(str(other), window=1000).records([]))
    assert [len(b.partition(b"\r\n\r\n")[2]) for _, b in read] == [9000 * i for i in range(9)]


def test_empty_table(spark):
    assert warc.page_round_trip(pages_of(spark, [])).count() == 0


def test_digests_of_foreign_archives(spark):
    folder = new_folder(spark, "w")
    warc.write_warc(pages_of(spark, ROWS), folder)
    system, path = warc.open_filesystem(folder)
    bodies = {1: b"", 2: b"WARC-Payload-Digest: md5:0123456789abcdef0123456789abcdef\r\n"}
    with system.open_output_stream(f"{path}/foreign.warc.gz", compression=None) as out:
        for i, line in bodies.items():
            plain = warc.record("response", f"<f:{i}>", "u", None, hashlib.sha1(b"x").hexdigest(), 0, b"foreign")
            head, _, rest = plain.partition(b"WARC-Payload-Digest:")
            out.write(warc.member(head + line + rest.partition(b"\r\n")[2]))
    archive = warc.read_warc(spark, folder)
    want = warc.bare_digest(hashlib.sha1(b"foreign").digest())
    assert {r.record_id for r in archive.where(F.col("payload_digest") == want).collect()} == {"<f:1>", "<f:2>"}
    assert archive.where("payload_digest IS NULL").count() == 0
