import hashlib
import math
import re
import struct

import pytest
import xxhash
import zstandard
from llm_odd import rows_of

from argentum.llm import url_filter as uf
from argentum.llm import warc

# --- url filter -------------------------------------------------------------

URLS = [None, "", "x", "no scheme/en/", "HTTP://Foo.COM?x/en/", "a://b://c/d", "http://ÉX.com/en/#", "http://a.com/en/" + "y" * 50_000, "http://xcom/en/", "http://example.com/en/7?x", "http://a.example.com/en/71", "https://example.net/de/81", "https://example.net/de/71", "http://q.org/es/1#a", "http://casino-win.example.org/fr/1", "http://thing.example.org/fr/1", "://h/p", "http://h\n/p\nq"]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def rule(host, path):
    fits = [(d + p, v) for v, d, p in uf.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


@pytest.fixture(scope="module")
def weights(spark):
    return uf.production_weights(spark)


def test_urls(spark, weights):
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(URLS)] + [(None, "http://com/en/", "x", "y"), (1, "", None, "z")], "page_id bigint, url string, host string, rule string")
    got = uf.judge_urls(pages, weights).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None:
            host, path = parts(URLS[r.page_id])
            name, verdict = rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, name)
            assert r.verdict == (verdict or ("block" if r.p_block >= 0.5 else "allow"))
    assert {r.rule for r in got if r.page_id is None} == {"com/en/"}
    by_id = {r.page_id: r.verdict for r in got}
    assert by_id[URLS.index("http://casino-win.example.org/fr/1")] == "block" and by_id[URLS.index("http://thing.example.org/fr/1")] == "allow" and by_id[0] == "allow"
    assert uf.judge_urls(pages.limit(0), weights).collect() == []


def plain_buckets(host, path):
    """Bucket numbers by the hash's own library: xxh64 with seed 42, signed, modulo the number of buckets."""
    out = set()
    for text, mark in ((host, "h"), (path, "p")):
        text = "^" + re.sub("[0-9]", "0", text) + "$"
        for i in range(len(text) - 2):
            h = xxhash.xxh64_intdigest((mark + text[i : i + 3]).encode(), 42)
            out.add((h - 2**64 if h >= 2**63 else h) % uf.BUCKETS)
    return out


def test_scores_equal_a_plain_computation(spark, weights):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("thing.example.com", "/en/12"), ("", ""), ("é.com", "/ü"), ("a", "/a\nb"), ("casino.test", "/" + "x/y" * 500)], "host string, path string")
    got = rows.select("host", "path", uf.buckets(F.col("host"), F.col("path")).alias("b"), uf.probability(F.col("host"), F.col("path"), weights).alias("p")).collect()
    for r in got:
        b = plain_buckets(r.host, r.path)
        assert set(r.b) == b and len(r.b) == len(b)
        z = weights[-1] + sum(weights[x] for x in b) / math.sqrt(max(1, len(b)))
        assert math.isclose(r.p, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_weights_equal_a_plain_fit(spark, weights):
    rows = sorted((hashlib.md5(r.url.encode()).hexdigest(), r.label, r.url) for r in uf.labelled_table(spark).where("NOT held_out").collect())
    w = [0.0] * (uf.BUCKETS + 1)
    for _ in range(uf.EPOCHS):
        for _, y, url in rows:
            b = plain_buckets(*parts(url))
            scale = 1 / math.sqrt(max(1, len(b)))
            g = uf.RATE * (y - 1 / (1 + math.exp(-(w[-1] + sum(w[x] for x in b) * scale))))
            w = [x * (1 - uf.DECAY) for x in w]
            for x in b:
                w[x] += g * scale
            w[-1] += g
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(w, weights))


def test_training_takes_nulls_and_any_order(spark, weights):
    table = uf.labelled_table(spark).where("NOT held_out").select("url", "label")
    again = uf.train(table.union(spark.createDataFrame([("http://x.com", None), (None, None)], "url string, label int")).repartition(5))
    assert again == weights


def test_accuracy_on_hosts_absent_from_training(spark, weights):
    from pyspark.sql import functions as F

    table = uf.labelled_table(spark)
    host, path = uf.host_and_path(F.col("url"))
    rows = table.select("held_out", host.alias("host"), (F.col("label") == 1).alias("unwanted"), (uf.probability(host, path, weights) >= 0.5).alias("blocked")).collect()
    assert not {r.host for r in rows if r.held_out and r.host} & {r.host for r in rows if not r.held_out}
    for held, least in ((True, 0.8), (False, 0.95)):
        own = [r.unwanted == r.blocked for r in rows if r.held_out == held]
        assert len(own) > 40 and sum(own) >= least * len(own)


# --- archives ----------------------------------------------------------------

BIG, OTHER = "<html>" + "a" * 1000, "<html>" + "é" * 600
PAGES = [(1, "http://a/\r\n x", BIG), (2, "http://b", BIG), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", OTHER), (8, "u", OTHER), (8, "u", OTHER), (None, "n", BIG), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (12, "u", "y" * 3_000_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", None) for r in rows], "page_id bigint, url string, html string, digest string, target string").repartition(3)


def wanted(rows):
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        t = top.get(h) if len(data) >= 1000 else None
        again = t is not None and t != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", t if again else None))
    return sorted(out, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("size", [8 << 20, 500])
def test_archives_round_trip(spark, size):
    to = warc.write_archives(pages(spark), archive_bytes=size)
    back = warc.read_archives(spark.read.parquet(to))
    assert rows_of(back, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == wanted(PAGES)
    whole = {r.page_id: bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()}
    assert whole[12] == "y" * 3_000_000 and whole[5] == "" and whole[11].startswith("\r\n\r\nWARC")


def test_empty_table_makes_no_archive(spark):
    to = warc.write_archives(pages(spark).limit(0))
    assert warc.read_archives(spark.read.parquet(to)).collect() == []


def test_archive_layout_and_damage(spark, tmp_path):
    to = warc.write_archives(pages(spark, PAGES[:4]).coalesce(1))
    data = bytes(spark.read.parquet(to).head().content)
    magic, n = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    at, frames = 8 + n, 0
    while at < len(data):
        end = warc.frame_end(data, at)
        record = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).decompress(data[at:end])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        at, frames = end, frames + 1
    assert frames == 4
    (tmp_path / "a.warc.zst").write_bytes(data)
    assert warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).count() == 4
    for broken in (data[:-5], b"x" + data[1:], data[:-30] + bytes([data[-30] ^ 1]) + data[-29:]):
        with pytest.raises((ValueError, zstandard.ZstdError, struct.error, IndexError)):
            list(warc.records(broken))
    headers, block = next(warc.records(data))
    with pytest.raises(ValueError):
        warc.parse_record(headers | {"warc-payload-digest": "sha1:" + "0" * 40, "warc-type": "response"}, block + b"")


def test_archives_as_files(spark, tmp_path):
    to = warc.write_archives(pages(spark), archive_bytes=500)
    folder = str(tmp_path / "archives")
    for _ in range(2):
        made = warc.export_archives(spark.read.parquet(to), folder).collect()
    files = {p.name: p.read_bytes() for p in (tmp_path / "archives").iterdir()}
    assert len(files) > 1 and {r.name: r.bytes for r in made} == {n: len(d) for n, d in files.items()}
    assert all(n.endswith(".warc.zst") and struct.unpack_from("<I", d)[0] == warc.DICTIONARY_MAGIC for n, d in files.items())
    back = warc.read_archives(spark.read.format("binaryFile").load(folder))
    assert rows_of(back, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == wanted(PAGES)
