import hashlib
import random

import pytest

from codeloom.llm import warc


@pytest.fixture
def pages(spark):
    r = random.Random(1)
    big = "<p>" + "é" * 1200
    rows = [(i, f"http://x/{i}", "".join(r.choices("abc<>", k=r.randrange(3000)))) for i in range(60)]
    rows += [(100, None, big), (101, "u\r\nv", big), (102, "w", big), (103, "s", "tiny"), (104, "s", "tiny"), (105, "n", None), (106, "e", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_round_trip(pages):
    df, rows = pages
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        if i in (100, 101):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 102, None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, raw)


def test_random_access_by_the_index(pages, tmp_path):
    df, rows = pages
    index = warc.write(df, f"file://{tmp_path}")
    at = index.where("page_id = 17").head()
    bundle = warc.Bundle(at["bundle"])
    headers, block = bundle.record(at["frame"], at["offset"])
    assert headers["WARC-Record-ID"] == "<urn:record:17>" and block == rows[17][2].encode()
    bundle.close()


def test_a_bundle_is_a_plain_zstandard_file(pages, tmp_path):
    import io

    import zstandard

    df, _ = pages
    path = warc.write(df.coalesce(1), f"file://{tmp_path}").head()["bundle"].removeprefix("file://")
    with open(path, "rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    n, at = 0, 0
    while at < len(plain):
        _, _, at = warc.parse_record(plain, at)
        n += 1
    assert n > 0


def test_empty_table(pages):
    assert warc.round_trip(pages[0].limit(0)).count() == 0
