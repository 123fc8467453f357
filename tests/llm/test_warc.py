import hashlib

from tallyweave.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string"


def plain(rows, least=1000):
    best = {}
    for page, _, html, _ in rows:
        key = (html or "").encode()
        if page is not None and len(key) >= least:
            best[key] = max(page, best.get(key, page))
    out = []
    for page, _, html, _ in rows:
        key = (html or "").encode()
        target = best.get(key)
        again = target is not None and (page is None or page < target)
        out.append((page, len(key), hashlib.sha1(key).hexdigest(), "revisit" if again else "response", target if again else None))
    return sorted(out, key=repr)


def test_round_trip_with_magic_inside_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    long = "é<p>" * 400
    rows = [(i, f"http://x/{i}", f"<html>{i} {'ü' * i}</html>", "p") for i in range(40)]
    rows += [(50, None, fake, None), (51, "u", fake * 30, None), (52, "u\r\nv", fake * 30, None), (53, "", None, None), (54, "", "", None)]
    rows += [(60, "a", long, None), (61, "b", long, None), (62, "c", long, None), (62, "d", long, None), (None, "e", long, None), (-7, "e", "WARC/1.1\r\n", None)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = str(tmp_path / "w")
    warc.write(pages, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # cut inside records
    try:
        got = warc.pages_of(warc.read(spark, path))
        kept = {r.page_id: r.payload for r in got.where("record_type = 'response' and page_id is not null").collect()}
        found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == plain(rows)
    assert bytes(kept[50]) == fake.encode() and bytes(kept[52]) == (fake * 30).encode() and bytes(kept[53]) == b""


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.pages_of(warc.read(spark, path)).collect() == []
