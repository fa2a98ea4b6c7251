"""Filling in middles, aligned tokenizers and token counts against brute force, on small tables with every awkward row."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cleanlake.llm import alignment, fill_in_middle, splice, token_counts

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, key string, n int, row long, ids string, pair string, groups string, output string, h1 string, n_bytes int"
ALPHABETS = ["abcdefghij", "  \n\t ", "'stredmlv'!?.,", "0123456789", "漢字éñ😀ﬁ½", "<|endoftext|>", "<s>", "<0x41>", " the of and is ", "'s", "▁", "\x00"]


def awkward(rnd, most=30):
    parts = []
    for _ in range(rnd.randrange(1, most)):
        a = rnd.choice(ALPHABETS)
        if a[0] in "< '":
            parts.append(a * rnd.choice([1, 1, 2, 40]))
        elif rnd.random() < 0.3:
            parts.append(rnd.choice(a) * rnd.randrange(1, 400))
        else:
            parts.append("".join(rnd.choice(a) for _ in range(rnd.randrange(1, 150))))
    return "".join(parts)


def texts():
    rnd = random.Random(11)
    plain = ["the quick brown fox", "The Quick, brown\nfox <P> jumps", "<S>", "a<M", "x" * 3000, "a b " * 3000, "été 漢字 😀", " leading", "\n\n", "1"]
    return [(i, t) for i, t in enumerate([None, "", *plain, *plain[:3], *(awkward(rnd) for _ in range(60)), *(awkward(rnd).replace("▁", " ") for _ in range(20))])] + [(7, "same id"), (7, "same id"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "i", "p", "g", "o", "h", 3) for i, t in rows], SCHEMA).repartition(3)


def sorted_rows(rows):
    return sorted(rows, key=repr)


# filling in middles


def arranged(i, t):
    t = t or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return (i, len(units), "plain", None, None, t, t)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (i, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", t)


def test_middles(docs):
    rows = fill_in_middle.fill_in_middle(docs)
    got = rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restored(rows["output"], rows["form"]).alias("r")).collect()
    want = [arranged(i, t) for i, t in texts()]
    assert sorted_rows(map(tuple, got)) == sorted_rows(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_units_of_long_texts_are_those_of_the_whole():
    rnd = random.Random(3)
    for _ in range(60):
        t = awkward(rnd)
        whole = [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t)]
        units = fill_in_middle.Units(t, rnd.choice([1, 5, 100]))
        assert len(units) == len(whole)
        for k in {0, len(whole), rnd.randrange(len(whole) + 1)}:
            assert units.end(k) == (whole[k - 1] if k else 0)


@pytest.mark.parametrize("text", ["<", "<<S", "<P<S<M", "a<S", "><>", "M>"])
def test_pieces_of_markers_come_back(spark, text):
    rows = spark.range(200).selectExpr("id as doc_id").crossJoin(spark.createDataFrame([(text,)], "text string"))
    out = fill_in_middle.fill_in_middle(rows)
    assert out.where(fill_in_middle.restored(out["output"], out["form"]) != text).count() == 0


# splicing


@pytest.mark.parametrize("special", [True, False])
def test_spliced_chunks_are_the_whole(special):
    own, rnd = token_counts.JsonTokenizer(open(JSON).read(), special), random.Random(5)
    assert own.chunks
    for _ in range(250):
        t = awkward(rnd)
        got = own.long(t, rnd.choice([300, 512, 1024]), rnd.choice([130, 150, 200]))
        assert got.tolist() == own.own.encode(t, add_special_tokens=False).ids


def test_spliced_pieces_are_the_whole():
    own, rnd = alignment.PieceIds(open(MODEL, "rb").read()), random.Random(6)
    for _ in range(250):
        t = awkward(rnd)
        assert own.long(t, rnd.choice([300, 512, 1024]), rnd.choice([130, 150, 200])).tolist() == own.own.encode(t)


def test_overlap_is_widened_until_a_token_is_shared():
    """Two encodings that agree only on tokens far into the overlap: 7 letters a token, counted from the chunk's own begin."""
    calls = []

    def encode(data):
        calls.append(len(data))
        cuts = [0, *(i for i in range(1, len(data)) if data[i - 1 : i] == b"|"), len(data)]
        words = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return np.array([len(w) for w in words], np.int64), 0

    size = np.arange(4000, dtype=np.int64)
    data = (b"x" * 700 + b"|") * 40
    assert splice.encode_long(data, encode, size, 4096, 128).tolist() == [701] * 40
    assert splice.encode_long(b"x" * 3000, encode, size, 1024, 128).tolist() == [3000]
    assert max(calls) == 4096


@pytest.mark.parametrize(("name", "cut"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_only_proved_tokenizers_are_cut(name, cut):
    assert splice.splittable(open(public_tokenizers.path(name)).read()) == cut


# token counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(docs, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        own = Tokenizer.from_file(path)
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    else:
        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(piece.encode(t))
    got = token_counts.count_tokens(docs, path, limit=40, chunk=700, overlap=150).collect()
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 40) for i, t in texts()]
    assert sorted_rows(map(tuple, got)) == sorted_rows(want)


# alignment


def brute_force(rows):
    """Groups by sets of byte ends, links by comparing all pairs of a text, counts by a dictionary."""
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    letters = splice.byte_letters()
    out, counts = [], collections.Counter()
    for i, t in rows:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        wa = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        wb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not t or b"".join(wa) != (" " + t).encode() or b"".join(wb) != (" " + t).encode():
            out.append((i, [], [], []))
            continue
        ends = lambda w: list(np.cumsum([len(x) for x in w]))
        ea, eb = ends(wa), ends(wb)
        both = sorted(set(ea) & set(eb))
        groups = [([x for x, e in zip(ids_a, ea, strict=True) if s < e <= u], [x for x, e in zip(ids_b, eb, strict=True) if s < e <= u]) for s, u in zip([0, *both], both, strict=False)]
        at_b = collections.defaultdict(list)
        for y, e in zip(ids_b, eb, strict=True):
            at_b[e].append(y)
        links = [(x, y) for x, e in zip(ids_a, ea, strict=True) for y in at_b[e]]
        counts.update(links)
        out.append((i, ids_a, ids_b, groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    done = []
    for i, ids_a, ids_b, groups, *rest in out:
        links = rest[0] if rest else []
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        done.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), text))
    return done


@pytest.mark.parametrize("looked_up", [alignment.LOOKED_UP, 20])
def test_alignment(docs, looked_up):
    got = alignment.align(docs, JSON, MODEL, looked_up=looked_up, chunk=700, overlap=150).collect()
    want = brute_force(texts())
    assert sorted_rows(map(tuple, got)) == sorted_rows(want)
    assert any(w[1] and w[4] < w[1] for w in want) and sum(w[1] == 0 for w in want) > 5


def test_roots_join_chains_and_stars():
    rnd = random.Random(2)
    for n in (1, 2, 9, 200):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(2 * n))] + [(i, i + 1) for i in range(n // 3)]
        own = list(range(n))
        for _ in range(n):
            for x, y in edges:
                own[x] = own[y] = min(own[x], own[y])
        one, two = (np.array(x, np.int64) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
        assert alignment.roots(n, one, two).tolist() == own


def test_packed_ids_come_back():
    for ids in ([], [0], [2**30 + 5, 7, 50256], list(range(5000))):
        assert alignment.unpacked(alignment.packed(np.array(ids, np.int64)), len(ids)).tolist() == ids


# all three


def test_empty_tables(spark):
    none = frame(spark, texts()).limit(0)
    assert fill_in_middle.fill_in_middle(none).collect() == []
    assert token_counts.count_tokens(none, JSON).collect() == []
    assert alignment.align(none, JSON, MODEL).collect() == []


def test_tables_without_any_token(spark):
    none = frame(spark, [(1, None), (2, ""), (2, "")])
    assert sorted(map(tuple, alignment.align(none, JSON, MODEL).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), *[(2, 0, 0, 0, 0, 0, 0, "")] * 2]
