"""The tokenizer against a reader that goes through the standard's states character by character."""

import random

import numpy as np
import pytest

from cleanlake.functions.markup import END, START, Scan
from cleanlake.operators.html import sanitize_html
from cleanlake.operators.policy import Policy

BLANKS = "\t\n\f\r "
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")


def read_tag(text, i):
    """From the `<` of a tag: its name, its attributes (name, value), whether it closes itself, and where it ends; None if it never does."""
    i += 2 if text[i + 1] == "/" else 1
    name, attrs, state, closing = "", [], "name", False
    while True:
        if i >= len(text):
            return None
        c = text[i]
        if state == "name":
            if c in BLANKS:
                state = "before name"
            elif c == "/":
                state = "self-closing"
            elif c == ">":
                break
            else:
                name += c
        elif state == "self-closing":
            if c == ">":
                closing = True
                break
            state = "before name"
            continue
        elif state == "before name":
            if c == "/":
                state = "self-closing"
            elif c == ">":
                break
            elif c not in BLANKS:
                attrs.append([c, ""])
                state = "attribute name"
        elif state == "attribute name":
            if c in BLANKS:
                state = "after name"
            elif c == "/":
                state = "self-closing"
            elif c == ">":
                break
            elif c == "=":
                state = "before value"
            else:
                attrs[-1][0] += c
        elif state == "after name":
            if c == "/":
                state = "self-closing"
            elif c == "=":
                state = "before value"
            elif c == ">":
                break
            elif c not in BLANKS:
                attrs.append([c, ""])
                state = "attribute name"
        elif state == "before value":
            if c in "\"'":
                state = c
            elif c == ">":
                break
            elif c not in BLANKS:
                state = "unquoted"
                continue
        elif state in "\"'":
            if c == state:
                state = "after value"
            else:
                attrs[-1][1] += c
        elif state == "unquoted":
            if c in BLANKS:
                state = "before name"
            elif c == ">":
                break
            else:
                attrs[-1][1] += c
        elif state == "after value":
            state = "before name"
            if c == "/":
                state = "self-closing"
            elif c == ">":
                break
            elif c not in BLANKS:
                continue
        i += 1
    return name.lower(), [(n.lower(), v) for n, v in attrs], closing, i + 1


def raw_end(text, i, name):
    """Where the raw text that begins at i ends."""
    escaped = twice = False
    while i < len(text):
        low = text[i : i + len(name) + 3].lower()
        if name == "script":
            if text.startswith("<!--", i) and not escaped:
                escaped, i = True, i + 2
                continue
            if text.startswith("-->", i):
                escaped = twice = False
            if escaped and not twice and low.startswith("<script") and low[7:8] and low[7] in BLANKS + "/>":
                twice, i = True, i + 7
                continue
        if low.startswith(f"</{name}") and low[len(name) + 2 :] and low[-1] in BLANKS + "/>":
            if not twice:
                return i
            twice = False
        i += 1
    return len(text)


def read(text):
    """name, attributes, closing, begin, end and raw text of the start tags of a text without foreign content."""
    out, i = [], 0
    while i < len(text):
        after = text[i + 1 : i + 2]
        if text[i] != "<":
            i += 1
        elif after.isascii() and after.isalpha() or after == "/" and text[i + 2 : i + 3].isascii() and text[i + 2 : i + 3].isalpha():
            tag = read_tag(text, i)
            if tag is None:
                return out
            name, attrs, closing, end = tag
            body = raw_end(text, end, name) if after != "/" and name in RAW else len(text) if after != "/" and name == "plaintext" else end
            if after != "/":
                out.append((name, attrs, closing, i, end, text[end:body]))
            i = body
        elif text.startswith("<!--", i):
            begin, i = i, i + 4
            if text.startswith(">", i):
                i += 1
            elif text.startswith("->", i):
                i += 2
            else:
                ends = [(text.find(e, begin + 4), len(e)) for e in ("-->", "--!>")]
                i = min((a + n for a, n in ends if a >= 0), default=len(text))
        elif after and after in "!?" or after == "/" and text[i + 2 : i + 3]:
            close = text.find(">", i + 2)
            i = len(text) if close < 0 else close + 1
        else:
            i += 1
    return out


def scanned(texts, narrow):
    data = [t.encode() for t in texts]
    s = Scan(b"".join(data), np.cumsum([len(d) for d in data]), narrow)
    tokens = s.real[s.kind[s.real] == START]
    owner, node = s.attributes_of(tokens)
    cut = lambda a, b: s.data[a:b].decode()
    out, at = [[] for _ in texts], np.concatenate([[0], s.ends])
    for k, t in enumerate(tokens.tolist()):
        doc = int(np.searchsorted(s.ends, s.at[t], side="right"))
        attrs = [(cut(s.node[n], s.node_name_end[n]).lower(), cut(*s.node_value[:, n]) if s.node_value[0, n] >= 0 else "") for n in node[owner == k]]
        out[doc].append((cut(*s.name[:, t]).lower(), attrs, bool(s.closing[t]), int(s.at[t] - at[doc]), int(s.end[t] - at[doc]), cut(s.end[t], s.body_end[t])))
    return out


PARTS = [*"<>\"'=/! -?a\n", "<", "<", ">", '"', "<!--", "-->", "--!>", "<a ", "<b", "</a", "<br/>", "x=1", "y='2'", 'z="3"', " on=", "<script", "<script>", "</script", "</script>", "<style>", "</style >", "<title>", "</title>", "<!DOCTYPE x>", "<?x", "</>", "</ x>", "=", "<textarea/>", "</TEXTAREA>"]


@pytest.mark.parametrize("narrow", [0, 24])
def test_tags_are_those_of_the_states(narrow):
    rnd = random.Random(narrow + 1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40))) for _ in range(6000)] + ["", "<", "<a", "<a b", "<!", "<!-", "<!--", "</", "</a", "a" * 50]
    got = scanned(texts, narrow)
    for t, g in zip(texts, got, strict=True):
        assert g == read(t), t


def test_other_letters_and_places_in_bytes():
    text = "é<p ü=ß 漢='字'>€<b x=é>"
    got = scanned([text], 24)[0]
    assert [(n, a) for n, a, *_ in got] == [("p", [("ü", "ß"), ("漢", "字")]), ("b", [("x", "é")])]
    assert [text.encode()[b:e].decode() for *_, b, e, _ in got] == ["<p ü=ß 漢='字'>", "<b x=é>"]


#: Documents, and the names and attributes of the tags that a browser sees in them.
FOREIGN = {
    "<svg><style><img src=x onerror=1></style></svg><style><b></style><i>": ["svg", "style", "img", "style", "i"],
    "<svg><style><path a></style></svg><style><b></style><i>": ["svg", "style", "path", "style", "i"],
    '<svg><![CDATA[ > <a title=" ]]><path onclick=1>"></svg><b>': ["svg", "path", "b"],
    '<p><![CDATA[ > <a title=" ]]><b>">': ["p", "a"],
    "<svg/><style><b></style>": ["svg", "style"],
    "<svg><title><style><b></style></title></svg>": ["svg", "title", "style"],
    "<svg><foreignObject><textarea><b></textarea></foreignObject><style><g></style></svg>": ["svg", "foreignobject", "textarea", "style", "g"],
    "<math><mi><style><b></style></mi><style><c></style></math>": ["math", "mi", "style", "style", "c"],
    "<math><annotation-xml encoding='text/html'><style><b></style></annotation-xml></math>": ["math", "annotation-xml", "style"],
    "<svg></p><style><b></style>": ["svg", "style"],
    "<svg><font><style><b></style></svg>": ["svg", "font", "style", "b"],
    "<svg><font color=x><style><b></style>": ["svg", "font", "style"],
    "<svg><svg></svg><style><c></style></svg><style><b></style>": ["svg", "svg", "style", "c", "style"],
    "<div><svg><p><style><b></style>": ["div", "svg", "p", "style"],
}


@pytest.mark.parametrize("text", FOREIGN)
def test_foreign_content(text):
    assert [t[0] for t in scanned([text, text], 24)[1]] == FOREIGN[text]


def test_text_of_a_foreign_script_is_its_text():
    (_, script, _), = scanned(["<svg><script>alert(1)<!-- --></script><b>"], 24)
    assert script[5] == "alert(1)<!-- -->"


def test_end_tags_are_walked_over():
    s = Scan(b"<a></a b='>'><c>", np.array([16]))
    assert [int(k) for k in s.kind[s.real]] == [START, END, START]


#: What came through earlier readers of markup.
ATTACKS = {
    "1 < 2 <img src=x onerror=alert(1)>": "1 < 2 <img src=\"{}.png\">",
    "<b>ok</b> <3 <a href=javascript:alert(1)>x</a>": '<b>ok</b> <3 <a href="#">x</a>',
    "<b title=it's id=x onerror=alert(1)>": "<b title=it's id=x>",
    '<a title=a"b href=javascript:alert(1)>': '<a title=a"b href="#">',
    "<!--><b id=x onerror=alert(1)>-->": "<!--><b id=x>-->",
    "<!-- a --!><b id=x onerror=alert(1)>": "<!-- a --!><b id=x>",
    '<b """ onclick=1>': '<b """>',
    "<a href='java\nscript:alert(1)'>x</a>": '<a href="#">x</a>',
    "<a href='  javascript:alert(1)'>x</a>": '<a href="#">x</a>',
    "<svg><style><b onclick=1></style>": "<svg><style><b></style>",
    "<p x=a/ onclick=1/>": "<p x=a/>",
}


def test_attacks_and_unquoted_values(spark):
    texts = [*ATTACKS, '<IMG """><SCRIPT>alert("XSS")</SCRIPT>">', "<img src=/i.png?v=1>"]
    got = sanitize_html(spark.createDataFrame(list(enumerate(texts)), "page_id long, html string"), Policy())
    out = {r.page_id: r.output for r in got.output.collect()}
    named = {r.page_id: r for r in got.subresources.collect()}
    for i, want in enumerate(ATTACKS.values()):
        assert out[i] == want.format(named[i].local_name.rpartition(".")[0] if i in named else ""), texts[i]
    assert out[len(ATTACKS)] is None
    last = named[len(ATTACKS) + 1]
    assert last.url == "https://localhost/i.png?v=1" and out[len(ATTACKS) + 1] == f'<img src="{last.local_name}">'
