import base64
import hashlib
import os
import random

from lattica.llm import warc
from lattica.llm.common import new_path

SCHEMA = "page_id long, url string, html string, digest string, part int, sha string, size int, hot string"


def pages():
    rng = random.Random(2)
    rows = [(i, f"http://x.org/{i}", "<p>" + "wörd " * rng.randint(0, 400) + str(i), "d", 1, "s", 1, "h") for i in range(80)]
    rows += [(100 + i, None if i % 3 else "http://h.org/ a", "one page that many share", "d", 1, "s", 1, "h") for i in range(150)]
    rows += [(300 + i, "u", None if i % 2 else "", "d", 1, "s", 1, "h") for i in range(6)]
    rows += [(400, "u", "twice", None, None, None, None, None)] * 2 + [(None, "u", "twice", None, None, None, None, None), (500, "u", "y" * 3_000_000, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    last = {}
    for i, _, html, *_ in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    out, seen = [], set()
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        first = i == last[html or ""] and html not in seen
        if first:
            seen.add(html or "")
            seen.add(html)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else last[html or ""]))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    got = warc.archive_pages(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_files_are_the_same_each_time_roll_and_leave_nothing_temporary(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    folders = [new_path(spark, "test-warc").removeprefix("file://") for _ in range(2)]
    manifests = [{(r.file, r.records, r.bytes, r.sha1) for r in warc.write_archives(d.repartition(1 + 6 * n), f, roll_bytes=2000).collect()} for n, (d, f) in enumerate(((df, folders[0]), (df, folders[1])))]
    assert manifests[0] == manifests[1]
    names = sorted(x for x in os.listdir(folders[0]) if x.startswith("shard"))
    assert names == sorted(f for f, *_ in manifests[0]) and any(not n.endswith("-0000.warc.gz") for n in names)
    assert not [x for x in os.listdir(folders[0]) if x.startswith(".tmp")]
    for name, _, size, sha in manifests[0]:
        data = open(f"{folders[0]}/{name}", "rb").read()
        assert len(data) == size and hashlib.sha1(data).hexdigest() == sha


def test_payloads_come_back(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    folder = new_path(spark, "test-warc")
    manifest = warc.write_archives(df, folder)
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(manifest, folder, with_payload=True).where("record_type = 'response'").collect()}
    want = {r[0]: (r[2] or "").encode() for r in pages()}
    assert got and all(want[i] == p for i, p in got.items())


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
