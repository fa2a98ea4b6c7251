"""URLs as browsers read them: parsing, joining and writing by the URL Standard, with host names by UTS 46.

A value is cut where the standard's states would leave it: scheme, authority, path, query and fragment. What each part may
hold as it is, and what is percent-encoded, are sets of characters; hosts are decoded before they are mapped, so that no
spelling of a host reaches another one. Code points are mapped by rules over the Unicode data of Python (compatibility
forms, case folding, what is ignored) instead of a table; joiners pass after a virama only.
"""

from __future__ import annotations

import functools
import ipaddress
import re
import unicodedata
from dataclasses import dataclass, replace

#: Fixed values of the standard: default ports of the special schemes, and the characters that no host may hold.
SPECIAL = {"ftp": 21, "file": None, "http": 80, "https": 443, "ws": 80, "wss": 443}
FORBIDDEN_HOST = frozenset("\0\t\n\r #/:<>?@[\\]^|")
FORBIDDEN_DOMAIN = FORBIDDEN_HOST | frozenset(map(chr, range(32))) | frozenset("%\x7f")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_EDGES = "".join(map(chr, range(33)))
_BREAKS = {9: None, 10: None, 13: None}
_PLAIN_HOST = re.compile(r"[a-z0-9\-_]+(?:\.[a-z0-9\-_]+)*\.?")
_DRIVE = re.compile(r"[A-Za-z][:|]")


def _encoder(more: str):  # noqa: ANN202
    """A function that percent-encodes control characters, what is not ASCII, and `more`; it does nothing twice."""
    odd = re.compile(f"[^\x20-\x7e]|[{re.escape(more)}]" if more else "[^\x20-\x7e]")
    return lambda text: odd.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode("utf-8", "replace")), text)


in_opaque = _encoder("")
in_fragment = _encoder(' "<>`')
in_query = _encoder(' "#<>')
in_special_query = _encoder(" \"#<>'")
in_path = _encoder(' "#<>?^`{}')
in_userinfo = _encoder(' "#<>?^`{}/:;=@[\\]|')


@dataclass(frozen=True)
class Url:
    """path is a list of segments, or the text of a path that has none; host_text is the host as it was written."""

    scheme: str
    userinfo: str = ""
    host: str | None = None
    host_text: str | None = None
    host_kind: str | None = None
    port: int | None = None
    path: tuple[str, ...] | str = ()
    query: str | None = None
    fragment: str | None = None

    def written(self) -> str:
        out = f"{self.scheme}:"
        if self.host is not None:
            out += "//" + (f"{self.userinfo}@" if self.userinfo else "") + self.host + ("" if self.port is None else f":{self.port}")
        elif not isinstance(self.path, str) and len(self.path) > 1 and self.path[0] == "":
            out += "/."
        out += self.path if isinstance(self.path, str) else "".join(f"/{p}" for p in self.path)
        return out + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")


# hosts


def _number(part: str) -> int | None:
    """A part of an IPv4 address: decimal, octal after 0, hexadecimal after 0x; None if it is none."""
    base = 16 if part[:2] in ("0x", "0X") else 8 if len(part) > 1 and part[0] == "0" else 10
    digits = part[2:] if base == 16 else part[1:] if base == 8 else part
    if digits == "":
        return 0 if part else None
    return int(digits, base) if re.fullmatch({16: "[0-9A-Fa-f]+", 10: "[0-9]+", 8: "[0-7]+"}[base], digits) else None


def v4(host: str) -> str | None:
    """The dotted form of a host that ends in a number, of one to four parts; "" if it ends in none, None if it is no address."""
    parts = host.split(".")
    if len(parts) > 1 and parts[-1] == "":
        parts.pop()
    if not re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]):
        return ""
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    whole = sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1])) + numbers[-1]
    return ".".join(str(whole >> s & 255) for s in (24, 16, 8, 0))


#: Code points that stay where case folding would change them, and those that are left out.
_STAY = frozenset("ßς‌‍")
_LEFT_OUT = re.compile("[­͏᠋-᠍᠏​⁠⁤︀-️﻿\U000e0100-\U000e01ef]")


@functools.lru_cache(maxsize=1 << 16)
def mapped(c: str) -> str | None:
    """What UTS 46 (not transitional) makes of a code point; None if it may not stand in a host."""
    if c in _STAY or c < "\x80":
        return c.lower()
    if c in "。｡":
        return "."
    if c == "ẞ":
        return "ß"
    if _LEFT_OUT.match(c):
        return ""
    out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold())
    bad = any(unicodedata.category(x) in ("Cc", "Cf", "Cs", "Co", "Cn", "Zl", "Zp") or x == "�" or "⿰" <= x <= "⿿" for x in (c, *out))
    return None if bad else out


def _bidi(label: str) -> bool:
    """Whether a label keeps the rule of RFC 5893 for domains with right-to-left text."""
    kinds = [unicodedata.bidirectional(c) for c in label]
    body = [k for k in kinds if k != "NSM"]
    if not body:
        return False
    if kinds[0] in ("R", "AL"):
        return set(kinds) <= {"R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and body[-1] in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(kinds)
    return kinds[0] == "L" and set(kinds) <= {"L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and body[-1] in ("L", "EN")


def _valid(label: str) -> bool:
    """Whether a label, after mapping, may stand: composed, of code points that map to themselves, no mark first, joiners after a virama."""
    if unicodedata.normalize("NFC", label) != label or unicodedata.category(label[0])[0] == "M":
        return False
    for i, c in enumerate(label):
        if mapped(c) != c or c == "." or (c in "‌‍" and (i == 0 or unicodedata.combining(label[i - 1]) != 9)):
            return False
    return True


@functools.lru_cache(maxsize=1 << 16)
def to_ascii(domain: str) -> str | None:
    """The domain as browsers ask for it; None if it is none."""
    if domain.isascii() and "xn--" not in domain.lower():
        return domain.lower()
    parts = [mapped(c) for c in domain]
    if None in parts:
        return None
    labels, plain = unicodedata.normalize("NFC", "".join(parts)).split("."), []
    for label in labels:
        if label.startswith("xn--"):
            try:
                word = label[4:].encode("ascii").decode("punycode")
                if word.isascii() or not _valid(word) or word.encode("punycode").decode() != label[4:]:
                    return None
            except (UnicodeError, IndexError, OverflowError, ValueError):
                return None
        elif label.isascii():
            word = label
        elif _valid(label):
            word = label
        else:
            return None
        plain.append(word)
    if any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for w in plain for c in w) and not all(_bidi(w) for w in plain if w):
        return None
    return ".".join(w if w.isascii() else "xn--" + w.encode("punycode").decode() for w in plain)


def _decoded(text: str) -> str:
    """text with its percent-encoded bytes decoded."""
    if "%" not in text:
        return text
    data = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m.group(1), 16)]), text.encode("utf-8", "replace"))
    return data.decode("utf-8", "replace")


def parse_host(text: str, special: bool) -> tuple[str, str] | None:
    """The host and its kind: domain, ipv4 or ipv6."""
    if special and _PLAIN_HOST.fullmatch(text) and "xn--" not in text and v4(text) == "":
        return text, "domain"
    if text.startswith("["):
        if not text.endswith("]") or "%" in text:
            return None
        try:
            return f"[{_six(ipaddress.IPv6Address(text[1:-1]))}]", "ipv6"
        except ValueError:
            return None
    if not special:
        return None if FORBIDDEN_HOST & set(text) else (in_opaque(text), "domain")
    host = to_ascii(_decoded(text))
    if not host or FORBIDDEN_DOMAIN & set(host):
        return None
    number = v4(host)
    return None if number is None else (number, "ipv4") if number else (host, "domain")


def _six(address: ipaddress.IPv6Address) -> str:
    """The address in hexadecimal, the first longest run of two zeros or more as `::`; never with a dotted end."""
    words = [f"{int(address) >> s & 0xFFFF:x}" for s in range(112, -1, -16)]
    runs = [(len(m.group()) // 2, m.start() // 2) for m in re.finditer(r"(?:0,){2,}", ",".join(w if w == "0" else "x" for w in words) + ",")]
    if not runs:
        return ":".join(words)
    size, at = max(runs, key=lambda r: (r[0], -r[1]))
    return f"{':'.join(words[:at])}::{':'.join(words[at + size :])}"


# URLs


def _up(path: tuple[str, ...], scheme: str) -> tuple[str, ...]:
    """path without its last segment; a drive of a file stays."""
    return path if scheme == "file" and len(path) == 1 and re.fullmatch("[A-Za-z]:", path[0]) else path[:-1]


def _with_path(url: Url, text: str) -> Url:
    """url with the segments of text added to its path; text may begin with a slash."""
    special, path = url.scheme in SPECIAL, url.path
    segments = re.split(r"[/\\]", text) if special else text.split("/")
    if segments and segments[0] == "" and len(segments) > 1:
        segments = segments[1:]
    for i, s in enumerate(segments):
        last, dots = i == len(segments) - 1, s.lower().replace("%2e", ".")
        if dots == "..":
            path = _up(path, url.scheme)
        elif dots != ".":
            if url.scheme == "file" and not path and _DRIVE.fullmatch(s):
                s = s[0] + ":"
            path = (*path, in_path(s))
            continue
        if last:
            path = (*path, "")
    return replace(url, path=path)


def _with_authority(scheme: str, text: str) -> tuple[Url, str] | None:
    """What an authority at the begin of text makes, and the rest of text."""
    special = scheme in SPECIAL
    m = re.match(r"[^/\\]*" if special else "[^/]*", text)
    authority, rest = m.group(), text[m.end() :]
    user, at, place = authority.rpartition("@")
    name, colon, password = user.partition(":")
    userinfo = in_userinfo(name) + (f":{in_userinfo(password)}" if password else "")
    bracket = re.match(r"\[[^\]]*\]?", place)
    host = bracket.group() if bracket else place.partition(":")[0]
    port, tail = None, place[len(host) :]
    if tail and not tail.startswith(":") or (not host and (special or tail or at)):
        return None
    if tail[1:]:
        if not (tail[1:].isascii() and tail[1:].isdigit()) or (port := int(tail[1:])) > 65535:
            return None
        port = None if port == SPECIAL.get(scheme) else port
    got = parse_host(host, special) if host else ("", "domain")
    if got is None:
        return None
    return Url(scheme, userinfo, got[0], host, got[1], port), rest


def _file(text: str, base: Url | None) -> Url | None:
    m = re.match(r"[/\\]{2}([^/\\]*)", text)
    if m and not _DRIVE.fullmatch(m.group(1)):
        got = parse_host(m.group(1), True) if m.group(1) else ("", "domain")
        if got is None:
            return None
        host = "" if got[0] == "localhost" else got[0]
        return _with_path(Url("file", host=host, host_text=m.group(1), host_kind=got[1]), text[m.end() :] or "/")
    fresh = Url("file", host="", host_text="", host_kind="domain")
    if m:
        return _with_path(fresh, text[2:])
    if base is None or base.scheme != "file":
        return _with_path(fresh, text or "/")
    if text[:1] in ("/", "\\"):
        drive = base.path[:1] if base.path and re.fullmatch("[A-Za-z]:", base.path[0]) and not re.match(r"[/\\][A-Za-z][:|](?:[/\\]|$)", text) else ()
        return _with_path(replace(base, path=drive, query=None, fragment=None), text)
    if not text:
        return replace(base, fragment=None)
    if re.match(r"[A-Za-z][:|](?:[/\\]|$)", text):
        return _with_path(fresh, text)
    return _with_path(replace(base, path=_up(base.path, "file"), query=None, fragment=None), text)


def parse(value: str, base: Url | None = None) -> Url | None:
    """value joined to base; None if a browser would not follow it."""
    text = value.strip(_EDGES).translate(_BREAKS)
    text, sharp, fragment = text.partition("#")
    fragment = in_fragment(fragment) if sharp else None
    m = _SCHEME.match(text)
    scheme = m.group(1).lower() if m else None
    if m:
        text = text[m.end() :]
    elif base is None:
        return None
    elif isinstance(base.path, str):
        return replace(base, fragment=fragment) if sharp and not text else None
    else:
        scheme = base.scheme
    special = scheme in SPECIAL
    slash = r"[/\\]" if special else "/"
    relative = not m or (special and base is not None and base.scheme == scheme and not re.match("//", text))
    if m and not special and not text.startswith("/"):
        path, mark, query = text.partition("?")
        return Url(scheme, path=in_opaque(path), query=in_query(query) if mark else None, fragment=fragment)
    text, mark, query = text.partition("?")
    query = (in_special_query if special else in_query)(query) if mark else None
    if scheme == "file":
        out = _file(text, base if base is not None and base.scheme == "file" else None)
        kept = base.query if out is not None and base is not None and base.scheme == "file" and not text else None
    elif (m and special and not relative) or re.match(slash * 2, text):
        got = _with_authority(scheme, re.sub(r"^[/\\]+", "", text) if special else text[2:])
        out, kept = got and _with_path(got[0], got[1] or ("/" if special else "")) if got is None or got[1] or special else got[0], None
    elif m and not special:
        out, kept = _with_path(Url(scheme), text), None
    elif re.match(slash, text):
        out, kept = _with_path(replace(base, path=(), query=None, fragment=None), text), None
    elif not text:
        out, kept = replace(base, fragment=None), base.query
    else:
        out, kept = _with_path(replace(base, path=base.path[:-1], query=None, fragment=None), text), None
    if out is None:
        return None
    return replace(out, query=query if mark else kept, fragment=fragment)


@functools.lru_cache(maxsize=1 << 12)
def parsed_base(text: str | None) -> Url | None:
    return None if text is None else parse(text)


@functools.lru_cache(maxsize=1 << 13)  # a page's links repeat; each worker has a table of its own
def parse_url(value: str, base: str | None) -> tuple | None:
    """href, scheme, host, host as written and its kind of value, composed and joined to base; None if it cannot be."""
    url = parse(unicodedata.normalize("NFC", value), parsed_base(base))
    if url is None:
        return None
    host = url.host or None
    return url.written(), url.scheme, host, url.host_text if host else None, url.host_kind if host else None
