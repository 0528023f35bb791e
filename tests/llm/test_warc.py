import base64
import gzip
import hashlib

import pytest
from pyarrow import fs

from semiweave.llm.warc import archive_round_trip, read_warc, write_warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def rows():
    out = [(k, f"http://a.example/{k}", f"<html>page {k % 7} {'é' * (k % 50)}</html>") for k in range(200)]
    out += [(1000 + k, "http://b.example/ x\n", "same") for k in range(60)]
    out += [(2000, "u", None), (2001, None, ""), (2002, "u", "x" * 300_000), (-5, "u", "same"), (10**15, "far", "far away")]
    return out + [(3000, "a", "twice"), (3000, "b", "twice"), (3000, "b", "other"), (None, "n", "same"), (None, "n", "alone")]


def expected(rows):
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html or ""] = min(least.get(html or "", page), page)
    out, seen = [], set()
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        first = least.get(html or "")
        revisit = (first is not None and first != page) or (page, html or "") in seen
        seen.add((page, html or ""))
        out.append((page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, shard string, kind int").repartition(3)
    assert got(archive_round_trip(df, file_bytes=2000, shard_bytes=5000)) == expected(rows)
    assert got(archive_round_trip(df)) == expected(rows)


def test_files_are_the_same_again(spark, rows, tmp_path):
    """Whatever the partitions, also for rows of one page_id and url, more of them than a shard takes."""
    ties = [(4000, "tie", f"text {k % 20} " * 300) for k in range(40)] + [(None, "tie", f"bare {k % 9} " * 500) for k in range(30)]
    df = spark.createDataFrame(rows + ties, "page_id long, url string, html string")
    found = []
    for k, parts in enumerate((2, 5, 3)):
        path = f"file://{tmp_path}/w{k}"
        manifest = write_warc(df.repartition(parts), path, file_bytes=3000, shard_bytes=20000)
        listed = sorted(map(tuple, manifest.collect()))
        store, root = fs.FileSystem.from_uri(path)
        for name, _, _, size, sha in listed:
            raw = store.open_input_stream(f"{root}/{name}", compression=None).read()
            assert len(raw) == size and base64.b32encode(hashlib.sha1(raw).digest()).decode() == sha
            assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert not [f for f in store.get_file_info(fs.FileSelector(f"{root}/_temporary"))]
        found.append(listed)
    assert found[0] == found[1] == found[2] and len(found[0]) > 5
    assert len({f[1] for f in found[0]}) > 8


def test_least_revisit_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    kinds = [r.record_type for r in archive_round_trip(df, least_revisit=10**6).collect()]
    assert kinds == ["response"] * len(rows)
    assert archive_round_trip(df.limit(0)).count() == 0


def test_broken_files_are_noticed(spark, rows, tmp_path):
    path = f"file://{tmp_path}/w"
    manifest = write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    name = manifest.first().file
    file = tmp_path / "w" / name
    file.write_bytes(file.read_bytes()[:-10])
    with pytest.raises(Exception, match="cut off|digest|invalid|incomplete"):
        read_warc(manifest, path).count()


def test_jobs_do_not_grow_with_shards(spark, tmp_path):
    df = spark.range(0, 3000).selectExpr("id * 7 as page_id", "cast(id as string) as url", "repeat(cast(id as string), 20) as html")
    tracker, counts = spark.sparkContext.statusTracker(), []
    for k, shard_bytes in enumerate((10**9, 20_000)):
        spark.sparkContext.setJobGroup(f"warc-{k}", "")
        write_warc(df, f"file://{tmp_path}/{k}", shard_bytes=shard_bytes)
        counts.append(len(tracker.getJobIdsForGroup(f"warc-{k}")))
    spark.sparkContext.setJobGroup("", "")
    assert counts[1] <= counts[0] + 6, counts
