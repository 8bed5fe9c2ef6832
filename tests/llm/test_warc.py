"""Archives: exact round trip, rolling, determinism, revisits, retries."""

import base64
import gzip
import hashlib
import os

import pytest

from seasonframe.common import work_dir
from seasonframe.llm.warc import read_archives, write_archives

SCHEMA = "page_id long, url string, html string"
ROWS = [(k, f"http://x/{k}", "same" if k % 3 == 0 else f"page {k} é " * (k % 40)) for k in range(200)]
ROWS += [(1000, None, None), (1001, "http://a b\r\n/ü", ""), (None, "http://n", "same"), (None, None, None), (6, "http://twin", "same"),
         (0, "http://twin", "same"), (-5, "http://first", "tail\r\n\r\nWARC/1.1\r\n"), (1 << 40, "http://far", "far")]


def expected(rows, least):
    first = {}
    for page_id, _, h in rows:
        if page_id is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", page_id), page_id)
    out = []
    for page_id, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "")
        revisit = page_id is not None and to is not None and page_id > to
        out.append((str(page_id), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
                    to if revisit else None, None if revisit else data))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,file,least", [(16_000_000, 64_000_000, 0), (3000, 900, 0), (500, 1, 4)])
def test_round_trip(spark, shard, file, least):
    path = work_dir(spark)
    write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(5), path, shard, file, least)
    out = read_archives(spark, path).collect()
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out]
    assert sorted(got, key=str) == expected(ROWS, least)
    names = [n for n in os.listdir(path) if n.endswith(".warc.gz")]
    assert not os.path.exists(f"{path}/_temporary") and (len(names) > 3) == (shard < 16_000_000)
    text = gzip.decompress(open(f"{path}/{sorted(names)[-1]}", "rb").read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_equal_input_gives_equal_files_and_sorted_records(spark):
    files = []
    for parts in (1, 6):
        path = work_dir(spark)
        write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(parts), path, 3000, 900)
        files.append({n: open(f"{path}/{n}", "rb").read() for n in os.listdir(path) if n.endswith(".gz")})
    assert files[0] == files[1]
    ids = [int(line.split()[1]) for n in sorted(files[0]) for line in gzip.decompress(files[0][n]).split(b"\r\n") if line.startswith(b"X-Page-Id:")]
    assert ids == sorted(ids)


def test_a_changed_file_is_noticed(spark):
    path = work_dir(spark)
    write_archives(spark.createDataFrame(ROWS[:20], SCHEMA), path)
    name = next(n for n in os.listdir(path) if n.endswith(".gz"))
    data = bytearray(open(f"{path}/{name}", "rb").read())
    data[-1] ^= 1
    open(f"{path}/{name}", "wb").write(data)
    with pytest.raises(Exception):
        read_archives(spark, path).collect()


def test_empty_table(spark):
    path = work_dir(spark)
    write_archives(spark.createDataFrame([], SCHEMA), path)
    assert read_archives(spark, path).count() == 0
