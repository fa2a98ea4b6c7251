"""The start tags of HTML documents by the standard's tokenizer, run over the bytes of a batch of documents at once.

A state of the tokenizer passes over bytes until one of its set ends it. So each state is a sorted list of the places of
the bytes that end it, and all tags of a batch take a transition together: a search in that list. What an attribute leads
to depends on its place alone, so that each place is worked out once, however many `<` before it lead there; when few are
left open they are finished one by one. Which tags are real, and not within a comment, another tag or raw text, is then
one walk from each token's end to the next token; only there is it known which script or foreign element a tag stands in.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa

#: Classes of bytes, as bits.
BLANK, SLASH, GREATER, EQUALS = 1, 2, 4, 8
CLASS = np.zeros(256, np.uint8)
for _bytes, _bit in ((b"\t\n\f\r ", BLANK), (b"/", SLASH), (b">", GREATER), (b"=", EQUALS)):
    CLASS[np.frombuffer(_bytes, np.uint8)] = _bit
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True

#: Fixed values of the HTML standard: elements whose content is text up to their end tag, and those that end foreign content.
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext")
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SVG_POINTS, MATH_POINTS = frozenset(("foreignobject", "desc", "title")), frozenset(("mi", "mo", "mn", "ms", "mtext"))
FONT_BREAKOUT = re.compile(rb"(?i)[\t\n\f\r /](?:color|face|size)[\t\n\f\r />=]")
HTML_ENCODING = re.compile(rb"(?i)[\t\n\f\r /]encoding[\t\n\f\r ]*=[\t\n\f\r ]*[\"']?(?:text/html|application/xhtml\+xml)[\"'\t\n\f\r />]")

#: Open places that are worked out together; fewer are finished one by one.
NARROW = 24
#: An attribute, and what stands between it and the next; group 5 is a quote that nothing closes.
_ONE = re.compile(rb"""([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+(=)[\t\n\f\r ]*+(?:"([^"]*+)"|'([^']*+)'|(["'])|([^\t\n\f\r >]*+)))?+()[\t\n\f\r /]*+""")
_SCRIPT = re.compile(rb"(?i)<!--|-->|<(/?)script(?=[\t\n\f\r />])")

#: Kinds of tokens; OPEN_END is an end tag that the document ends within.
START, END, COMMENT, OTHER, OPEN_END = 1, 2, 3, 4, 5


def _ends_of_runs(mask: np.ndarray) -> np.ndarray:
    """The places behind each run of true values."""
    return np.flatnonzero(mask[:-1] & ~mask[1:]) + 1


class Scan:
    """The tokens of documents, which are data[ends[i - 1]:ends[i]], and the attributes of their start tags."""

    def __init__(self, data: bytes, ends: np.ndarray, narrow: int = NARROW):
        self.data, self.ends, self.narrow = data, ends, narrow
        self.buf = np.frombuffer(data + b"\0\0\0\0", np.uint8)
        kind = CLASS[self.buf]
        self.blank, self.gap = (kind & BLANK) != 0, (kind & (BLANK | SLASH)) != 0
        self.blank_ends, self.gap_ends = _ends_of_runs(self.blank), _ends_of_runs(self.gap)
        self.name_stops = np.flatnonzero(kind & (BLANK | SLASH | GREATER))
        self.attribute_stops = np.flatnonzero(kind & (BLANK | SLASH | GREATER | EQUALS))
        self.value_stops = np.flatnonzero(kind & (BLANK | GREATER))
        self.greater = np.flatnonzero(kind & GREATER)
        self.quotes = {q: np.flatnonzero(self.buf == q) for q in (34, 39)}
        self._tokens()
        self._attributes()
        self._walk()

    def _limit(self, at: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, at, side="right").clip(max=max(len(self.ends) - 1, 0))] if len(self.ends) else at

    @staticmethod
    def _next(places: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The first of places at or after at; limit if there is none before it."""
        i = np.searchsorted(places, at)
        return np.minimum(np.append(places, np.iinfo(np.int64).max)[i], limit)

    @staticmethod
    def _skip(mask: np.ndarray, run_ends: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Where the run of mask that at stands in ends; at if it stands in none."""
        out, inside = at.copy(), np.flatnonzero(mask[at])
        out[inside] = run_ends[np.searchsorted(run_ends, at[inside], side="right")]
        return np.minimum(out, limit)

    def _tokens(self) -> None:
        """What each `<` may begin, and, but for tags, where that ends."""
        at = np.flatnonzero(self.buf == 60)
        limit = self._limit(at)
        one, two = self.buf[at + 1], self.buf[at + 2]
        one, two = np.where(at + 1 < limit, one, 0), np.where(at + 2 < limit, two, 0)
        kind = np.zeros(len(at), np.uint8)
        kind[LETTER[one]] = START
        kind[(one == 47) & LETTER[two]] = END
        kind[((one == 47) & ~LETTER[two] & (two != 0)) | (one == 33) | (one == 63)] = OTHER
        kind[(one == 33) & (two == 45) & (self.buf[at + 3] == 45) & (at + 3 < limit)] = COMMENT
        some = kind != 0
        self.at, self.kind, self.limit = at[some], kind[some], limit[some]
        self.end = np.zeros(len(self.at), np.int64)
        other = np.flatnonzero(self.kind == OTHER)
        self.end[other] = np.minimum(self._next(self.greater, self.at[other] + 2, self.limit[other]) + 1, self.limit[other])
        comment = np.flatnonzero(self.kind == COMMENT)
        g, b = self.greater[self.greater >= 3], self.buf
        two_dashes, bang = (b[g - 1] == 45) & (b[g - 2] == 45), (b[g - 1] == 33) & (b[g - 2] == 45) & (b[g - 3] == 45)
        starts, closes = np.where(two_dashes, g - 2, g - 3)[two_dashes | bang], (g + 1)[two_dashes | bang]
        s, lim = self.at[comment], self.limit[comment]
        ends = np.append(closes, np.iinfo(np.int64).max)[np.searchsorted(starts, s + 4)]
        ends = np.where(b[(s + 4).clip(max=len(b) - 1)] == 62, s + 5, ends)
        ends = np.where((b[(s + 4).clip(max=len(b) - 1)] == 45) & (b[(s + 5).clip(max=len(b) - 1)] == 62), s + 6, ends)
        self.end[comment] = np.minimum(ends, lim)

    def _step(self, p: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
        """name end, value begin and end (-1 for none), where the attribute ends, and the next place: of the attributes that begin at p."""
        name_end = self._next(self.attribute_stops, p + 1, limit)
        q = self._skip(self.blank, self.blank_ends, name_end, limit)
        equals = (q < limit) & (self.buf[q] == 61)
        v = self._skip(self.blank, self.blank_ends, np.where(equals, np.minimum(q + 1, limit), q), limit)
        first = np.where(equals & (v < limit), self.buf[v], 0)
        close = v.copy()
        for quote, places in self.quotes.items():
            of = np.flatnonzero(first == quote)
            close[of] = self._next(places, v[of] + 1, limit[of])
        quoted = (first == 34) | (first == 39)
        bare_end = self._next(self.value_stops, v, limit)
        begin = np.where(quoted, v + 1, np.where(equals, v, -1))
        end = np.where(quoted, close, np.where(equals, bare_end, -1))
        after = np.where(quoted, np.minimum(close + 1, limit), np.where(equals, bare_end, name_end))
        after = np.where(quoted & (close >= limit), limit, after)
        return name_end, begin, end, after, self._skip(self.gap, self.gap_ends, after, limit)

    def _one(self, p: int, limit: int) -> tuple[int, ...]:
        m = _ONE.match(self.data, p, limit)
        if m.start(5) >= 0:
            return m.end(1), m.end(5), limit, limit, limit
        group = next((g for g in (3, 4, 6) if m.start(g) >= 0), 0)
        return m.end(1), *(m.span(group) if group else (-1, -1)), m.start(7), m.end()

    def _attributes(self) -> None:
        """All places where an attribute may begin, what each leads to, and where tags end."""
        tags = np.flatnonzero((self.kind == START) | (self.kind == END))
        begin, limit = self.at[tags] + np.where(self.kind[tags] == START, 1, 2), self.limit[tags]
        self.name = np.zeros((2, len(self.at)), np.int64)
        self.name[0, tags] = begin
        self.name[1, tags] = name_end = self._next(self.name_stops, begin, limit)
        first = self._skip(self.gap, self.gap_ends, name_end, limit)
        seen, found = np.zeros(len(self.buf), bool), [np.zeros((6, 0), np.int64)]
        open_ = lambda p, lim: (p < lim) & (self.buf[p] != 62)
        front = np.unique(first[open_(first, limit)])
        while len(front) > self.narrow:
            seen[front] = True
            lim = self._limit(front)
            rows = self._step(front, lim)
            found.append(np.stack([front, *rows]))
            following = np.unique(rows[-1][open_(rows[-1], lim)])
            front = following[~seen[following]]
        rest, stack = [], front.tolist()
        lims = dict(zip(stack, self._limit(front).tolist(), strict=True))
        for p in stack:
            lim = lims[p]
            while p < lim and self.data[p] != 62 and not seen[p]:
                seen[p] = True
                rest.append((p, *self._one(p, lim)))
                p = rest[-1][-1]
        if rest:
            found.append(np.array(rest, np.int64).T)
        nodes = np.concatenate(found, axis=1)
        nodes = nodes[:, np.argsort(nodes[0], kind="stable")]
        self.node, (_, _, _, after, following) = nodes[0], nodes[1:]
        self.node_name_end, self.node_value = nodes[1], nodes[2:4]
        lim = self._limit(self.node)
        more = open_(following, lim)
        self.node_next = np.where(more, np.searchsorted(self.node, following).clip(max=max(len(self.node) - 1, 0)), -1)
        # the place of `>`, or the document's end, that a node leads to in the end
        last = np.where(more, self.node_next, np.arange(len(self.node)))
        while not np.array_equal(far := last[last], last):
            last = far
        self.closing = np.zeros(len(self.at), bool)
        self.first_node = np.full(len(self.at), -1, np.int64)
        inside = open_(first, limit)
        at_node = np.searchsorted(self.node, first[inside])
        self.first_node[tags[inside]] = at_node
        stop, before = first.copy(), name_end.copy()
        stop[inside], before[inside] = following[last[at_node]], after[last[at_node]]
        whole = stop < limit
        self.closing[tags] = whole & (stop > before) & (self.buf[(stop - 1).clip(min=0)] == 47)
        self.end[tags] = np.where(whole, stop + 1, limit)
        self.kind[tags[~whole]] = np.where(self.kind[tags[~whole]] == END, OPEN_END, 0)  # no tag, and nothing comes after it

    def named(self, name: str, kind: int) -> np.ndarray:
        """The tokens of a kind that bear a name."""
        size = len(name)
        some = np.flatnonzero((self.kind == kind) & (self.name[1] - self.name[0] == size))
        some = some[LOWER[self.buf[self.name[0, some]]] == ord(name[0])]
        chars = LOWER[self.buf[self.name[0, some][:, None] + np.arange(size)]]
        return some[(chars == np.frombuffer(name.encode(), np.uint8)).all(axis=1)]

    def _lower_name(self, i: int) -> str:
        return self.data[self.name[0, i] : self.name[1, i]].decode("utf-8", "replace").lower()

    def _walk(self) -> None:
        """The real tokens; for raw text elements, where their text ends."""
        self.body_end = self.end.copy()
        special = np.zeros(len(self.at), bool)
        comments = self.at[self.kind == COMMENT]
        for name in RAW_TEXT:
            own = self.named(name, START)
            closers = np.sort(np.concatenate([self.named(name, END), self.named(name, OPEN_END)])) if name != "plaintext" else own[:0]
            closers = closers[self.name[1, closers] < self.limit[closers]]
            self.body_end[own] = self._next(self.at[closers], self.end[own], self.limit[own])
            if name == "script":  # an escaped script may hold an end tag
                special[own] = np.searchsorted(comments, self.end[own]) < np.searchsorted(comments, self.body_end[own])
        for name in ("svg", "math"):
            special[self.named(name, START)] = True
        special &= ~(self.closing & ~np.isin(np.arange(len(self.at)), self.named("script", START)))
        self.places = self.at.tolist()
        following = np.searchsorted(self.at, self.body_end).tolist()
        odd, real, i, n, self.foreign_text = special.tolist(), [], 0, len(self.places), []
        while i < n:
            real.append(i)
            if odd[i]:
                i = self._script(i) if self._lower_name(i) == "script" else self._foreign(i, real)
            else:
                i = following[i]
        self.real = np.array(real, np.int64)
        tags = self.real[(self.kind[self.real] == START) | (self.kind[self.real] == END)]
        for i in self.foreign_text:  # the text of a foreign script or style ends with the next tag
            j = int(np.searchsorted(tags, i, side="right"))
            self.body_end[i] = min(self.places[tags[j]] if j < len(tags) else int(self.limit[i]), int(self.limit[i]))

    def _script(self, i: int) -> int:
        """Sets where the text of a script that holds a comment ends: within one, a script begun there must end there first."""
        begin, limit, state = int(self.end[i]), int(self.limit[i]), 0
        at, out = begin, limit
        while m := _SCRIPT.search(self.data, at, limit):
            text = m.group()
            at = m.start() + 2 if text == b"<!--" else m.end()
            if text == b"<!--":
                state = state or 1
            elif text == b"-->":
                state = 0
            elif m.group(1):
                if state < 2:
                    out = m.start()
                    break
                state = 1
            elif state == 1:
                state = 2
        self.body_end[i] = out
        return bisect_left(self.places, out)

    def _foreign(self, i: int, real: list[int]) -> int:
        """Walks on from an svg or math element until none is open; its tokens go to real. The first token after it."""
        limit, n = int(self.limit[i]), len(self.places)
        stack = [self._lower_name(i)]  # svg, math, and names of the points where HTML may stand
        i = bisect_left(self.places, int(self.end[i]))
        self.body_end[real[-1]] = self.end[real[-1]]
        while i < n and self.places[i] < limit and stack:
            at, end, kind = self.places[i], int(self.end[i]), int(self.kind[i])
            foreign = stack[-1] in ("svg", "math")
            real.append(i)
            name = self._lower_name(i) if kind in (START, END) else ""
            if kind == START:
                open_tag = self.data[at:end]
                if foreign and (name in BREAKOUT or (name == "font" and FONT_BREAKOUT.search(open_tag))):
                    while stack and stack[-1] in ("svg", "math"):
                        stack.pop()
                    foreign = False
                    if not stack:
                        return bisect_left(self.places, int(self.body_end[i]))
                if foreign:
                    self.body_end[i] = end
                    if name in ("script", "style") and not self.closing[i]:
                        self.foreign_text.append(i)
                    point = name in SVG_POINTS if stack[-1] == "svg" else name in MATH_POINTS or (name == "annotation-xml" and HTML_ENCODING.search(open_tag))
                    if (point or name in ("svg", "math")) and not self.closing[i]:
                        stack.append(name)
                elif name in ("svg", "math"):
                    if not self.closing[i]:
                        stack.append(name)
                elif name == "script":
                    i = self._script(i)
                    continue
                else:
                    end = int(self.body_end[i])
            elif kind == END:
                if foreign and name in ("p", "br"):
                    while stack and stack[-1] in ("svg", "math"):
                        stack.pop()
                elif name in stack:
                    while stack.pop() != name:
                        pass
            elif kind == OTHER and foreign and self.data.startswith(b"<![CDATA[", at):
                close = self.data.find(b"]]>", at + 9, limit)
                end = limit if close < 0 else close + 3
            i = bisect_left(self.places, end)
        return i

    def attributes_of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' attributes in order: for each the place of its token in tokens, and its node."""
        owner, now = np.arange(len(tokens)), self.first_node[tokens]
        owners, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(now):
            some = now >= 0
            owner, now = owner[some], now[some]
            if len(now) <= self.narrow:
                break
            owners.append(owner), nodes.append(now)
            now = self.node_next[now]
        chain = self.node_next
        for o, p in zip(owner.tolist(), now.tolist(), strict=True):
            rest = []
            while p >= 0:
                rest.append(p)
                p = int(chain[p])
            owners.append(np.full(len(rest), o, np.int64)), nodes.append(np.array(rest, np.int64))
        owners, nodes = np.concatenate(owners), np.concatenate(nodes)
        order = np.argsort(nodes, kind="stable")  # tags lie one behind another
        return owners[order], nodes[order]


def ranges(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False, missing: np.ndarray | None = None) -> pa.Array:
    """The strings at those ranges of UTF-8; null where missing."""
    size = end - begin if missing is None else np.where(missing, 0, end - begin)
    total = np.cumsum(size)
    at = np.repeat(begin - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)
    data = buf[at]
    offsets = np.concatenate([[0], total]).astype(np.int32)
    valid = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(size), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(LOWER[data] if lower else data))])


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
