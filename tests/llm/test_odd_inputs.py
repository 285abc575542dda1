"""Coded bodies, false addresses, and examples whose identifier repeats."""

import gzip
import zlib

from cueweave.llm import pii, toxicity, warc


def told(body, coding):
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: {coding}\r\n\r\n".encode()
    about, text = (warc.parse(r[-1]) for r in warc.derive(warc.build({"WARC-Type": "response"}, head + body)))
    decoded = [x for x in about.block.decode().split("\r\n") if x.startswith("content-decoded")][0].endswith("true")
    return decoded, text.block.decode()


def test_members_cut_bodies_and_large_content(monkeypatch):
    one, two = gzip.compress(b"<p>first"), gzip.compress(b" second</p>")
    assert told(one + two, "gzip") == (True, "first second") == told(one + two + b"\0\0", "x-gzip")
    assert told((one + two)[:-9], "gzip") == (False, "") == told(one[: len(one) // 2], "gzip") == told(one + b"junk", "gzip")
    flat = zlib.compress(b"<p>flat</p>")
    assert told(flat, "deflate") == (True, "flat") == told(flat[2:-4], "deflate") and told(flat[:-6], "deflate") == (False, "")
    assert told(gzip.compress(flat), "deflate, gzip") == (True, "flat") and told(b"", "gzip") == (True, "") and told(one, "br") == (False, "")
    monkeypatch.setattr(warc, "MOST_CONTENT", 1000)
    assert told(gzip.compress(b"a" * 1001), "gzip") == (False, "") and told(gzip.compress(b"a" * 1000), "gzip") == (True, "a" * 1000)


def found(text):
    return [text[a:b] for a, b in pii.disguised_addresses(text)]


def test_addresses_need_a_top_label():
    for text in ("they arrive at 10.5.3.2 today", "sold at a.b", "open at 9.30", "meet at room 3 dot 4", "at 1.x2"):
        assert found(text) == []
    assert found("write to jo at example.com now") == ["jo at example.com"] and found("jo [at] mail dot example dot org") == ["jo [at] mail dot example dot org"]
    assert found("x (at) xn--e1a.xn--p1ai") == ["x (at) xn--e1a.xn--p1ai"]


def test_repeated_examples_have_one_text(spark):
    rows = [(1, "good day"), (1, "vile words"), (1, None), (2, "fine weather")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    learned = [toxicity.learn(spark.createDataFrame(order, "doc_id long, text string").repartition(3), labels) for order in (rows, rows[::-1], rows)]
    assert len({(x.terms.tobytes(), x.weight.tobytes()) for x in learned}) == 1 and sorted(learned[0].ids.tolist())[-1] == 2
