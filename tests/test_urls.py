"""URLs and host names by the standards' own examples, and what each part percent-encodes."""

import random

import pytest

from cleanlake.functions.hosts import siphash13
from cleanlake.functions.urls import parse, parse_url, to_ascii

BASE = "https://host.example/a/b/c?d#e"
#: value, base, href (None if it cannot be joined).
CASES = (
    ("http:evil.com/p", BASE, "http://evil.com/p"), ("https://%65vil.com/", BASE, "https://evil.com/"), ("https:///evil.com/", BASE, "https://evil.com/"), ("///evil.com/x", BASE, "https://evil.com/x"),
    ("https:evil.com/p", BASE, "https://host.example/a/b/evil.com/p"), ("/a b.png", BASE, "https://host.example/a%20b.png"), ("/é.png", BASE, "https://host.example/%C3%A9.png"), ("\\\\evil.com\\x", BASE, "https://evil.com/x"),
    ("", BASE, "https://host.example/a/b/c?d"), ("#x", BASE, "https://host.example/a/b/c?d#x"), ("?x", BASE, "https://host.example/a/b/c?x"), (".", BASE, "https://host.example/a/b/"), ("..", BASE, "https://host.example/a/"),
    ("../../../x", BASE, "https://host.example/x"), ("%2e%2E/x", BASE, "https://host.example/a/x"), ("./x/.", BASE, "https://host.example/a/b/x/"), ("//o.org", BASE, "https://o.org/"), ("x:y", BASE, "x:y"), ("java\nscript:alert(1)", BASE, "javascript:alert(1)"),
    (" \t/x y\n", BASE, "https://host.example/x%20y"), ("/x?a b'\"<>#c `d", BASE, "https://host.example/x?a%20b%27%22%3C%3E#c%20%60d"), ("https://u:p@h.org:444/", BASE, "https://u:p@h.org:444/"), ("https://a@b@h.org/", BASE, "https://a%40b@h.org/"),
    ("https://:p@h.org/", BASE, "https://:p@h.org/"), ("https://@/", BASE, None), ("https://h.org:/x", BASE, "https://h.org/x"), ("https://h.org:443", BASE, "https://h.org/"), ("https://h.org:70000/", BASE, None), ("https://h.org:a/", BASE, None),
    ("https://", BASE, None), ("https://h org/", BASE, None), ("https://h%20org/", BASE, None), ("https://a_b.org/", BASE, "https://a_b.org/"), ("https://%zz/", BASE, None), ("https://h%2Forg/", BASE, None), ("https://A.Example/", BASE, "https://a.example/"),
    ("https://[::1]/", BASE, "https://[::1]/"), ("https://[1:0::0:2]/", BASE, "https://[1::2]/"), ("https://[::127.0.0.1]/", BASE, "https://[::7f00:1]/"), ("https://[1:0:0:2:0:0:0:3]/", BASE, "https://[1:0:0:2::3]/"), ("https://[::1", BASE, None), ("https://[::g]/", BASE, None), ("https://[fe80::1%25a]/", BASE, None),
    ("https://127.1/", BASE, "https://127.0.0.1/"), ("https://0x7F000001/", BASE, "https://127.0.0.1/"), ("https://1.2.3.4.5/", BASE, None), ("https://08.1/", BASE, None), ("https://１２７.1/", BASE, "https://127.0.0.1/"), ("https://a.1/", BASE, None), ("https://0x/", BASE, "https://0.0.0.0/"), ("https://h.0xg/", BASE, "https://h.0xg/"), ("https://h.0xa./", BASE, None), ("https://1.a/", BASE, "https://1.a/"),
    ("mailto:a b@c?d#e f", BASE, "mailto:a b@c?d#e%20f"), ("data:text/html,<b>", BASE, "data:text/html,<b>"), ("x://H%zz/../a?b'", BASE, "x://H%zz/a?b'"), ("x:///p", BASE, "x:///p"), ("x:/..//p", BASE, "x:/.//p"), ("x://a b/", BASE, None), ("non-special:opaque", None, "non-special:opaque"),
    ("x", "mailto:a", None), ("#x", "mailto:a", "mailto:a#x"), ("/p", "x://h/a", "x://h/p"), ("p", "x://h", "x://h/p"), ("x", None, None),
    ("file:///C|/a/../..", None, "file:///C:/"), ("file:c:\\x", None, "file:///c:/x"), ("file://localhost/x", None, "file:///x"), ("/x", "file:///C:/y/z", "file:///C:/x"), ("..", "file:///C:/", "file:///C:/"), ("file://h/x", None, "file://h/x"), ("//h/y", "file:///x", "file://h/y"),
)


@pytest.mark.parametrize(("value", "base", "href"), CASES)
def test_joined(value, base, href):
    got = parse_url(value, base)
    assert (got and got[0]) == href
    if href is not None:
        assert parse_url(href, None)[0] == href  # what is written reads as itself


HOSTS = (
    ("faß.de", "xn--fa-hia.de"), ("Bücher.example", "xn--bcher-kva.example"), ("рф", "xn--p1ai"), ("wіkіреdіа.org", "xn--wkd-8cdx9d7hbd.org"), ("ὈΔΥΣΣΕΎΣ", "xn--" + "ὀδυσσεύσ".encode("punycode").decode()), ("βόλος.com", "xn--nxasmm1c.com"), ("FAẞ.de", "xn--fa-hia.de"), ("a。b", "a.b"), ("e‍vil.com", None), ("क्‍ष.com", "xn--" + "क्‍ष".encode("punycode").decode() + ".com"),
    ("ev­il.com", "evil.com"), ("ｅｖｉｌ.com", "evil.com"), ("xn--fa-hia.de", "xn--fa-hia.de"), ("XN--FA-HIA.de", "xn--fa-hia.de"), ("xn--a", None), ("xn--evil-", None), ("́a.com", None), ("a�.com", None), ("אב.com", "xn--4dbc.com"), ("אa.com", None), ("1א.com", None), ("Ⅷ.com", "viii.com"),
)


@pytest.mark.parametrize(("text", "host"), HOSTS)
def test_hosts(text, host):
    assert to_ascii(text) == host
    assert (parse(f"https://{text}/") or parse("x:")).host == host


def test_original_hosts_and_kinds():
    assert parse_url("https://Bücher.example/", BASE)[2:] == ("xn--bcher-kva.example", "Bücher.example", "domain")
    assert parse_url("https://127.1/", BASE)[2:] == ("127.0.0.1", "127.1", "ipv4") and parse_url("https://[::1]/", BASE)[2:] == ("[::1]", "[::1]", "ipv6")
    assert parse_url("mailto:x", BASE)[2:] == (None, None, None) and parse_url("a/b", BASE)[2:] == ("host.example", "host.example", "domain")


def test_reading_what_was_written_changes_nothing():
    rnd, parts = random.Random(4), [*"/\\?#:@.[]% é'\"<a", "//", "..", "%2e", "http:", "https:", "x:", "h.org", ":80", "1.2.3.4", "[::1]"]
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(9)))
        got = parse_url(text, rnd.choice([BASE, "http://h/", "x://y/z", "file:///a"]))
        if got is not None:
            assert parse_url(got[0], None)[0] == got[0], text


def test_hashes_of_rows_together_are_those_of_each():
    rnd = random.Random(1)
    rows = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(40))) for _ in range(300)]
    assert siphash13(rows).tolist() == [int(siphash13([r])[0]) for r in rows]
    assert siphash13([b"https://trusted.com/btn.png\xff"]).tolist() == [0x006621E470212FDA] and siphash13([]).tolist() == []


def test_pieces_of_an_ipv6_address_have_four_digits_at_most():
    assert parse_url("wss://[::ffff]:443/x", None)[0] == "wss://[::ffff]/x" and parse_url("wss://[::1:e009]:443/x", None)[0] == "wss://[::1:e009]/x"
    assert parse_url("wss://[::1e009]:443/x", None) is None


def test_the_last_number_of_an_ipv4_address_fills_the_bytes_that_are_left():
    assert parse_url("ftp://0x7f.16777215/..", None)[0] == "ftp://127.255.255.255/" and parse_url("ftp://0x7f.16777216/..", None) is None
