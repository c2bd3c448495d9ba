import io
import random

import pytest
from pyspark.sql import types as T

from tidemark.llm.warc import archived, base32_sha1, member, records, write

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("first", T.StringType()), T.StructField("same", T.StringType())])


def brute(pages, min_bytes=0):
    least = {}
    for page_id, _, html in pages:
        if page_id is not None:
            least[html or ""] = min(page_id, least.get(html or "", page_id))
    out = []
    for page_id, url, html in pages:
        data, first = (html or "").encode(), least.get(html or "")
        again = len(data) >= min_bytes and first is not None and first != page_id
        out.append((page_id, url, len(data), base32_sha1(data), "revisit" if again else "response", first if again else None, None if again else html or ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    rng = random.Random(4)
    pages = [(i, f"http://h/{i} \r\nX: é%0A", rng.choice(["", "<p>é\r\n\r\nWARC/1.1</p>", "a" * rng.randrange(9), f"<i>{i}</i>" * rng.randrange(40)])) for i in range(300)]
    pages += [(None, None, "only here"), (None, "u", pages[3][2]), (7, pages[7][1], pages[7][2]), (900, "", None), (901, "x", "z" * 3_000_000)]
    got = archived(spark.createDataFrame([(*p, "c", "c") for p in pages], SCHEMA), min_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(pages, min_bytes)


def test_no_pages(spark):
    assert archived(spark.createDataFrame([], SCHEMA)).collect() == []


def test_files_are_sequences_of_gzip_members(spark, tmp_path):
    import gzip

    files = write(spark.createDataFrame([(1, "u", "x", "", ""), (2, "v", "x", "", "")], SCHEMA).coalesce(1), f"file://{tmp_path}/w").collect()
    data = b"".join(open(f.path.removeprefix("file://"), "rb").read() for f in files)
    assert sum(f.n_records for f in files) == 2 and sum(f.n_bytes for f in files) == len(data)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 2


def test_damage_is_found():
    good = member(1, "u", b"payload", None)
    assert [r.payload for r in records(io.BytesIO(good + good))] == [b"payload"] * 2
    with pytest.raises(ValueError, match="ends"):
        list(records(io.BytesIO(good + good[:-9])))
    import gzip

    plain = gzip.decompress(good)
    for bad in (plain.replace(b"payload", b"paYload"), plain.replace(b"Content-Length: ", b"Content-Length: 1", 1), plain[8:]):
        with pytest.raises(ValueError):
            list(records(io.BytesIO(gzip.compress(bad))))
