import hashlib

from graphloom.llm import warc

BIG = "<p>" + "é" * 600 + "</p>"
PAGES = [
    (1, "http://a", BIG),
    (5, "http://b\r\nX-Evil: 1", BIG),
    (3, None, BIG),
    (5, "http://b2", BIG),
    (2, "http://c", "x" * 999),
    (4, "http://d", "x" * 999),
    (6, "http://e", None),
    (7, "http://f", ""),
    (8, "http://g", "y\r\n\r\nWARC/1.1\r\n" * 100),
    (None, "http://h", "z" * 1000),
    (None, "http://i", "z" * 1000),
    (9, "http://j", "w" * 1000),
]


def brute(pages):
    out = []
    rows = [(p, (h or "").encode()) for p, _, h in pages]
    done = set()
    for p, body in rows:
        same = [q for q, b in rows if b == body]
        top = max(same, key=lambda q: (q is not None, q or 0))
        kind, to = "response", None
        if len(body) >= 1000 and len(same) > 1:
            if p == top and body not in done:
                done.add(body)
            else:
                kind, to = "revisit", top
        out.append((str(p), len(body), hashlib.sha1(body).hexdigest(), kind, to))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    archive = warc.write_archive(pages)
    got = warc.read_archive(spark, archive).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(PAGES)
    assert archive.payloads(spark).count() == len({h or "" for _, _, h in PAGES})
    files = warc.export(spark, archive, f"file://{tmp_path}/out").collect()
    assert sum(f.n_records for f in files) == len(PAGES)
    seen = [x for f in files for x in warc.read_warc(f.path)]
    assert len(seen) == len(PAGES) and all("X-Evil" not in h for h, _ in seen)
    bodies = {h["WARC-Record-ID"]: b for h, b in seen}
    assert len(bodies) == len(PAGES)
    back = []
    for h, b in seen:
        body = bodies[h["WARC-Refers-To"]] if h["WARC-Type"] == "revisit" else b
        assert "sha1:" + hashlib.sha1(body).hexdigest() == h["WARC-Payload-Digest"]
        back.append((h["X-Page-ID"] or "None", body))
    assert sorted(back) == sorted((str(p), (t or "").encode()) for p, _, t in PAGES)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(spark, warc.write_archive(pages)).count() == 0
