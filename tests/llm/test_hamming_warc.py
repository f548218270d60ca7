import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from temporalis.llm import hamming, warc
from temporalis.llm.hamming import comparison_code, top_k
from temporalis.llm.shared import scratch_path
from temporalis.llm.warc import read_warc, write_warc


def brute(rows, queries, k):
    out = []
    for q, code in set(queries):
        if q is None or code is None:
            continue
        near = {}
        for i, c in rows:
            if i is not None and c is not None:
                d = (code ^ c).bit_count()
                near[i] = min(near.get(i, 99), d)
        out += [(q, n, i, d) for n, (d, i) in enumerate(sorted((d, i) for i, d in near.items())[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits,k,masks", [(32, 5, 20_000), (16, 7, 10), (16, 400, 100)])
def test_top_k_equals_brute_force(spark, monkeypatch, bits, k, masks):
    monkeypatch.setattr(hamming, "MASKS", masks)
    r = random.Random(bits + k)
    base = [r.getrandbits(bits) for _ in range(40)]
    rows = [(i, r.choice(base) ^ (1 << r.randrange(bits)) if r.random() < 0.5 else r.getrandbits(bits)) for i in range(200)]
    rows += [(1000 + i, base[0]) for i in range(60)] + [(1000, base[0]), (None, base[0]), (5000, None)]
    queries = [x for x in rows if x[0] is None or x[0] % 20 == 0] + [(7000, r.getrandbits(bits))]
    df = spark.createDataFrame([(*x, 1) for x in rows], "id long, code long, distance int")
    got = sorted(map(tuple, top_k(df, spark.createDataFrame(queries, "id long, code long"), k, bits).collect()))
    assert got == brute(rows, queries, k)
    assert top_k(df.where("false"), df, k, bits).count() == 0 and top_k(df, df.where("false"), k, bits).count() == 0


def test_ids_with_several_codes(spark):
    r = random.Random(8)
    for n, each, k, near in ((20, 5, 4, 3), (60, 4, 5, 6)):
        q = r.getrandbits(32)
        rows = [(i, q ^ sum(1 << b for b in r.sample(range(32), r.randint(0, near)))) for i in range(n) for _ in range(each)]
        queries = [(0, q), (1, r.getrandbits(32)), (1, q ^ 1)]  # a query of two codes
        frame = lambda x: spark.createDataFrame(x, "id long, code long")
        got = sorted(map(tuple, top_k(frame(rows), frame(queries), k).collect()))
        want = []
        for name in (0, 1):
            least: dict = {}
            for i, c in rows:
                least[i] = min([least.get(i, 99), *((c ^ code).bit_count() for n, code in queries if n == name)])
            want += [(name, nth, i, d) for nth, (d, i) in enumerate(sorted((d, i) for i, d in least.items())[:k], 1)]
        assert got == want and len(got) == 2 * k


def test_codes(spark):
    rows = [([1.0, 5.0, 2.0, 4.0],), ([1.0, 5.0, 0.5, 6.0],), (None,), ([1.0],), ([1.0, None, 2.0, 3.0],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(comparison_code(F.col("v"), 2)).collect()]
    assert got == [2, 1, None, None, None]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    page = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 20
    rows = [(5, "http://a/5", page), (3, "http://a/3\r\nX: y", page), (9, None, page), (3, "http://a/3", page), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", None), (None, "n", page), (7, "u", "x" * 100), (8, "u", "x" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "z", "日" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = scratch_path(spark, "warc")
    write_warc(df, path, "2024-01-01T00:00:00Z")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_warc(spark, path).collect()), key=str)
    first = {page: 3, "x" * 100: 7}
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "")
        again = i is not None and to is not None and i != to
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    assert got == sorted(want, key=str)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path + "/part-*").collect()]
    raw = b"".join(gzip.decompress(x) for x in files)
    assert raw == b"".join(warc.inflated(memoryview(x)) for x in files) and len(files) > 1
    assert raw.count(page.encode()) == 3 and raw.count(f"WARC-Refers-To: <urn:page:3:{hashlib.sha256(page.encode()).hexdigest()[:16]}>\r\n".encode()) == 2 and raw.count(b"WARC-Refers-To-Target-URI: http://a/3\r\n") + raw.count(b"WARC-Refers-To-Target-URI: http://a/3%0AX: y\r\n") == 2
    empty = scratch_path(spark, "warc")
    write_warc(df.where("false"), empty, "2024-01-01T00:00:00Z")
    assert read_warc(spark, empty).count() == 0


def test_records_larger_than_a_member(monkeypatch):
    data = bytes(range(256)) * 300
    packed = warc.members(data)
    assert packed[-1] == 0 and gzip.decompress(packed) == data == warc.inflated(memoryview(packed))
    monkeypatch.setattr(warc, "MEMBER", 1000)
    packed = warc.members(data)
    assert packed.count(b"\x1f\x8b\x08") >= 76 and packed[-1] == 0 and warc.inflated(memoryview(packed)) == data
    with pytest.raises(ValueError):
        warc.inflated(memoryview(packed[:-2]))
