"""The trained operators: their arithmetic against brute force, and their accuracy on rows held out."""

import functools
import itertools
import random

import numpy as np
import public_tokenizers
import pytest

from cleanlake.llm import ann, chat, langid, quality, toxicity
from cleanlake.llm.common import labelled_sample

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LABELS = "doc_id long, quality int, toxic int"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def odd_documents(spark):
    rows = [(None, "hello there", "en"), (1, None, "en"), (2, "", None), (3, "12 !?", "en"), (4, "word " * 4000, "en"), (4, "word " * 4000, "en"), (5, "x" * 5000, "en"), (6, "\x00 ퟿ é", "fr")]
    return spark.createDataFrame([(*r, 0.5, 1, True, "z") for r in rows], "doc_id long, text string, lang string, score double, predicted int, held_out boolean, lang_pred string")


# language


def test_forward_sums_all_segmentations():
    pieces = [langid.MARK + "ab", "ab", "a", "b", langid.MARK, "bc", "c", langid.MARK + "a"]
    p = np.random.default_rng(0).random((len(pieces) + 2, 3))
    p[-2], p[-1] = langid.UNKNOWN, 0
    lattice, index = langid.Lattice(pieces), {x: i for i, x in enumerate(pieces)}

    def brute(word, j):
        @functools.cache
        def tail(i):
            cuts = ((p[index[word[i:k]], j] if word[i:k] in index else langid.UNKNOWN if k == i + 1 else 0) * tail(k) for k in range(i + 1, len(word) + 1))
            return 1.0 if i == len(word) else sum(cuts)

        return np.log(tail(0))

    for w in ("abc", "zab", "aabbcc", "a", "é" * 40, "ab" * 30, "abcz" * 16):
        word = langid.MARK + w
        got = lattice.forward(lattice.pieces(lattice.codes([word])), p)[0]
        assert got == pytest.approx([brute(word, j) for j in range(3)])


def brute_counts(lattice, pieces, word, p):
    """The expected number of each piece over all segmentations of a word, one by one."""
    index, out, total = {x: i for i, x in enumerate(pieces)}, np.zeros(len(pieces) + 2), [0.0]

    def walk(i, prob, used):
        if i == len(word):
            total[0] += prob
            np.add.at(out, used, prob)
        for k in range(i + 1, len(word) + 1):
            x = index.get(word[i:k], len(pieces) if k == i + 1 else None)
            if x is not None:
                walk(k, prob * p[x], [*used, x])

    walk(0, 1.0, [])
    return out / total[0]


def test_expected_counts_and_long_words(monkeypatch):
    pieces = [langid.MARK + "ab", "ab", "a", "b", langid.MARK, "bc", "c", langid.MARK + "a"]
    p = np.random.default_rng(0).random((len(pieces) + 2, 3))
    p[-2], p[-1] = langid.UNKNOWN, 0
    lattice = langid.Lattice(pieces)
    for w in ("abcab", "zab", "aabbccab"):
        got = lattice.expected(lattice.pieces(lattice.codes([langid.MARK + w])), p[:, 1], np.array([2.0]))
        assert got[:-1] == pytest.approx(2 * brute_counts(lattice, pieces, langid.MARK + w, p[:, 1])[:-1])
    rnd = random.Random(1)
    for length in (513, 1024, 1025, 3000):
        word = langid.MARK + "".join(rnd.choice("abcz") for _ in range(length - 1))
        found = lattice.pieces(lattice.codes([word]))
        counts = lattice.expected(found, p[:, 0], np.ones(1))
        assert sum(counts[i] * len(x) for i, x in enumerate(pieces)) + counts[len(pieces)] == pytest.approx(length)
        in_blocks = lattice.forward(found, p)
        monkeypatch.setattr(langid, "BLOCK", 10**9)
        assert in_blocks == pytest.approx(lattice.forward(found, p))
        monkeypatch.undo()


def test_fitting_raises_the_likelihood_and_scores_add_up(monkeypatch):
    pieces = langid.usable_pieces(PIECES)
    texts = {"de": ["der hund und die katze sind im haus", "das ist ein haus"], "en": ["the dog and the cat are in the house", "this is a house"]}
    lattice = langid.Lattice(pieces)
    words = [w for t in texts["en"] for w in t.split()]
    monkeypatch.setattr(langid, "POOLED", 1e-6)  # the likelihood of one language alone
    likelihood = [sum(float(lattice.forward(lattice.pieces(lattice.codes([langid.MARK + w])), langid.fit(pieces, texts, r))[0, 1]) for w in words) for r in (1, 2, 4)]
    assert likelihood == sorted(likelihood)
    monkeypatch.undo()
    p = langid.fit(pieces, texts)
    logs, counts = langid.Scorer(pieces, p).score(["the cat", "der hund", "", "x" * 100_000])
    for text, got in zip(("the cat", "der hund"), logs, strict=False):
        assert got == pytest.approx(sum(lattice.forward(lattice.pieces(lattice.codes([langid.MARK + w])), p)[0] for w in text.split()))
    assert logs[0, 1] > logs[0, 0] and logs[1, 0] > logs[1, 1] and counts.tolist() == [2, 2, 0, 1]


def test_languages_held_out(spark):
    docs = table(spark, "documents")
    got = langid.identify(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_texts(spark):
    docs = table(spark, "documents").select("doc_id", "text", "lang").unionByName(odd_documents(spark).selectExpr("doc_id + 1000000 as doc_id", "text", "lang"))
    got = {r.doc_id: r for r in langid.identify(docs, PIECES).where("doc_id is null or doc_id >= 1000000").collect()}
    assert [got[10**6 + i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[None].held_out and got[None].lang_pred != "und"
    assert {r.lang_pred for r in langid.identify(odd_documents(spark).where("doc_id = 2"), PIECES).collect()} == {"und"}
    assert langid.identify(odd_documents(spark).limit(0), PIECES).count() == 0


# toxicity


def brute_kernel(a, b):
    """The kernel of two marked units by the definition: all common subsequences, by place."""

    def weights(word):
        c, out = toxicity.classes([word])[0], {}
        for at in itertools.combinations(range(len(word)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.REACH:
                u = tuple(int(c[i]) for i in at)
                out.setdefault(u, []).append(toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.ORDER))
        return out

    x, y = weights(a), weights(b)
    norm = np.sqrt(sum(w**2 for ws in x.values() for w in ws))
    landmark = {u: sum(w) for u, w in y.items() if toxicity.OTHER not in u}
    size = np.sqrt(sum(w**2 for w in landmark.values()))
    return sum(sum(w) * landmark[u] for u, w in x.items() if u in landmark) / norm / size


def test_string_kernel():
    mark = "\x00"
    kernel = toxicity.Kernel([mark + "idiot", mark + "chóna"])
    for w in ("idiot", "i-d-iot", "idioootic", "ídiot", "chóna", "zz~~zz", "worthless"):
        got = kernel.of([mark + w])[0]
        assert got == pytest.approx([brute_kernel(mark + w, mark + "idiot"), brute_kernel(mark + w, mark + "chóna")], abs=1e-5)


def test_folded_weights_are_kernel_whitening_and_machine():
    """A unit's score is the machine's on its whitened kernels, by the definition of the kernel; a text's, of its best unit."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(4, 7)))
    rows = [(" ".join([word() for _ in range(5)] + ["idiot"] * (i % 2)), i % 2) for i in range(60)]
    seen = {}
    real, kernels = toxicity.separate, toxicity.Kernel

    class Kept(kernels):
        def __init__(self, landmarks):
            super().__init__(landmarks)
            seen["landmarks"], seen["kernel"] = landmarks, self

    def kept(x, y, weight, **rest):
        seen["w"] = real(x, y, weight, **rest)
        return seen["w"]

    toxicity.separate, toxicity.Kernel = kept, Kept
    try:
        model = toxicity.fit(rows)
    finally:
        toxicity.separate, toxicity.Kernel = real, kernels
    marks = seen["landmarks"]
    own = seen["kernel"].table.T @ seen["kernel"].table
    value, vector = np.linalg.eigh(own.astype(float))
    whiten = vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T
    score = lambda window: float(np.array([brute_kernel(window, m) for m in marks]) @ whiten @ seen["w"][:-1] + seen["w"][-1])
    for u in ("idiot", "idi-ot", "abcdef", "xidiotxxabcdefghijabcdefghij"):
        want = max(score(w) for w in toxicity.windows(u))
        assert model.unit_scores([u])[0] == pytest.approx(max(want, -1.0), abs=1e-3)
        assert score(model.best_window(u)) == pytest.approx(want, abs=1e-3)
    text = "abcdef idiot jjjj idiott"
    each = [max([-1.0, *(score(w) for w in toxicity.windows(u) if len(w) >= toxicity.ORDER)]) for u in set(toxicity.units(text))]
    count = min(3, sum(e > toxicity.EVIDENCE for e in [max([-1.0, *(score(w) for w in toxicity.windows(u))]) for u in toxicity.units(text)]))
    logit = np.array([max(each), count, 1.0]) @ model.calibration
    assert model.probability(toxicity.Scorer(model).evidence([text]))[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-3)


def test_toxicity_finds_gapped_insults_and_spares_others(spark):
    rnd, insults = random.Random(2), ("idiot", "moron", "clown", "worthless")
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 3 == 0:
            w[rnd.randrange(60)] = rnd.choice(insults)
        rows.append((i, " ".join(w), i % 3 == 0))
    docs = [(i, t) for i, t, _ in rows] + [(1000 + i, " ".join(word() for _ in range(20)) + " " + x) for i, x in enumerate(("idi-ot", "m.o.r.o.n", "w o r t h l e s s", "cllown", "1diot", "theron"))]
    docs += [(2000, None), (2001, ""), (None, "moron"), (2002, "thon " * 5000), (2002, "thon " * 5000)]
    got = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows] + [(None, 1, 1), (7, None, None)], LABELS)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(by[i].predicted, int(y)) for i, _, y in rows if by[i].held_out]
    assert held and sum(a == b for a, b in held) / len(held) > 0.97
    assert [by[1000 + i].predicted for i in range(6)] == [1, 1, 1, 1, 1, 0]
    assert by[2000].predicted == by[2001].predicted == by[2002].predicted == 0 and by[None].predicted == 1 and by[None].held_out


def test_toxicity_of_all_scripts_and_disguises():
    rnd = random.Random(4)
    alphabets = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "Greek": "αβγδεζηθλμξπρστφψω", "Arabic": "ابتثجحدذرزسشصضطظعغفقكلمنهوي", "Devanagari": "कखगघचछजझटठडतथदधनपफबभमयरलवशसह", "Han": "".join(map(chr, range(0x4E00, 0x4F60)))}
    insults = {"Cyrillic": "грубиян", "Greek": "ξζψφθδ", "Arabic": "جضخشغ", "Devanagari": "झठभछघ", "Han": "馬鹿"}
    letters = "abcdefghklmnoprstuvw"

    def text(kind, bad):
        word = lambda: "".join(rnd.choice(alphabets.get(kind, letters)) for _ in range(rnd.randrange(4, 8)))
        found = [word() for _ in range(12)]
        if bad:
            found.insert(rnd.randrange(12), bad)
        return ("" if kind == "Han" else " ").join(found)

    every = {**insults, "Latin": "idiot"}
    kinds = [(k, i % 2) for k in every for i in range(80)]
    scorer = toxicity.Scorer(model := toxicity.fit([(text(k, every[k] if bad else ""), bad) for k, bad in kinds]))
    score = lambda texts: model.probability(scorer.evidence(texts))
    for k, bad in every.items():
        assert (score([text(k, bad) for _ in range(20)]) > 0.5).mean() >= 0.9, k
        assert (score([text(k, "") for _ in range(20)]) < 0.5).mean() >= 0.9, k
    disguised = ["ｉｄｉｏｔ", "\U0001d422\U0001d41dio\U0001d42d", "i\u0336d\u0336i\u0336o\u0336t\u0336", "іdіоt", "id\u200biot", "IDI\u041eT"]
    assert all(toxicity.units(d) == ["idiot"] for d in disguised) and toxicity.units("e\u0301") == toxicity.units("é")
    assert (toxicity.classes(["ạ", "ế", "đ"]) != toxicity.OTHER).all() and (toxicity.classes(["😀", "1", "€"])[::2] == toxicity.OTHER).all()
    assert toxicity.units("сор") == ["cop", "сор"]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [r.score for r in toxicity.score_toxicity(docs, spark.createDataFrame([], LABELS)).collect()] == [0.0]
    assert toxicity.score_toxicity(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


# quality


def test_quality_held_out(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = quality.score_quality(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.quality is not None]
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    odd = quality.score_quality(docs.select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text")), labels)
    assert all(0 <= r.score <= 1 for r in odd.collect()) and odd.count() == docs.count() + 8


def test_quality_without_labels_rejects_nothing(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in quality.score_quality(odd_documents(spark), none).collect()} == {1}
    assert quality.score_quality(odd_documents(spark).limit(0), none).count() == 0


def test_passages_cover_texts_and_attention_sums_to_one():
    texts = ["", "a\nb", "x" * 2000, "é\n\n"]
    data, begin, counts = quality.passages(texts)
    assert counts.tolist() == [1, 2, 3, 3] and len(data) == sum(len(t.encode()) + 1 for t in texts)
    model = quality.fit([("good words here", 1), ("bad ### %%%", 0)] * 3)
    x = (quality.describe(data, begin) - model.center) / model.scale
    weights = model.forward(x, np.cumsum(counts) - counts, counts)["s"]
    assert np.add.reduceat(weights, np.cumsum(counts) - counts) == pytest.approx(np.ones(4))


def brute_score(model, text):
    """The forward pass by the definition, one passage after the other."""
    w, codes, raw = {k: v.astype(float) for k, v in model.weights.items()}, [], []
    data, begin, _ = quality.passages([text])
    for x in (quality.describe(data, begin) - model.center) / model.scale:
        h = np.tanh(np.array([sum(x[i] * w["e"][i, j] for i in range(len(x))) for j in range(quality.CODE)]) + w["eb"])
        gate = [np.tanh(h @ w["v"][:, k]) / (1 + np.exp(-(h @ w["u"][:, k]))) for k in range(quality.GATE)]
        codes.append(h)
        raw.append(sum(g * a for g, a in zip(gate, w["a"], strict=True)))
    share = np.exp(raw) / np.exp(raw).sum()
    return 1 / (1 + np.exp(-(sum(s * h for s, h in zip(share, codes, strict=True)) @ w["c"] + w["cb"][0])))


def test_quality_is_the_brute_force_forward_pass_and_its_gradient():
    texts = ["good words here\nand more of them", "bad ### %%%", "", "x" * 2000 + "\né fine line\n\nEND", "one two two two"] * 2
    model = quality.fit([(t, i % 2) for i, t in enumerate(texts[:5])])
    assert model.score(texts) == pytest.approx([brute_score(model, t) for t in texts], abs=1e-5)
    data, begin, counts = quality.passages(texts)
    x, y = (quality.describe(data, begin) - model.center) / model.scale, np.arange(len(texts)) % 2.0
    start = np.cumsum(counts) - counts
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, start, counts)["p"]) + (1 - y) * np.log(1 - p))
    rnd = np.random.default_rng(3)
    for k, g in model.gradient(x, start, counts, y).items():
        for _ in range(4):
            at = tuple(rnd.integers(n) for n in model.weights[k].shape)
            old, side = model.weights[k][at], []
            for d in (1e-5, -1e-5):
                model.weights[k][at] = old + d
                side.append(loss())
            model.weights[k][at] = old
            assert (side[0] - side[1]) / 2e-5 == pytest.approx(g[at], abs=1e-6), k


def test_samples_are_bounded_and_take_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(i % 10, "t" * (i % 10 + 1) + ("" if i < 10 else " other")) for i in range(40)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, 1, 0), (None, 1, 0), (50, 1, 0)], LABELS)
    got = labelled_sample(docs, labels, "quality", 4, 9, 100)
    assert len(got) == 10 and sorted(y for _, y in got) == [0] * 5 + [1] * 5
    few = labelled_sample(docs, labels, "quality", 4, 9, 100, most_bytes=20)
    assert all(sum(len(t) for t, y in few if y == k) <= 20 for k in (0, 1)) and {y for _, y in few} == {0, 1} and set(few) < set(got)
    langs = docs.withColumn("lang", (docs.doc_id % 2).cast("string"))
    texts = langid.training_texts(langs, 4, 9, 3)
    assert sorted(texts) == ["0", "1"] and all(len(t) == 3 for t in texts.values())
    assert list(langid.training_texts(langs, 4, 9, 3, languages=1)) == ["0"]


# neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<float>, rank int, score string").repartition(3)


@pytest.mark.parametrize("distance", [False, True])
def test_neighbours_against_brute_force(spark, monkeypatch, distance):
    monkeypatch.setattr(ann, "CANDIDATES", 400)
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(1200, 24)).astype(np.float32)
    x[600:700] = x[:100] + rnd.normal(size=(100, 24)) * 0.05
    x[700:760] = x[5]  # many of one vector
    got = {}
    for r in ann.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), distance=distance).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x, recall = x.astype(float), []
    assert sorted(got) == list(range(0, 1200, 20))
    for q, rows in got.items():
        exact = -((x - x[q]) ** 2).sum(axis=1) if distance else (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(len(x)), -exact)) if i != q][:20]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert [r[2] for r in rows] == pytest.approx([exact[r[1]] for r in rows], abs=1e-12)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        recall.append(len(set(best) & {r[1] for r in rows}) / 20)
    assert np.mean(recall) > 0.95


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (20, None), (40, [1.0, 2.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (9, [])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (0, 3, 40, 1.0), (40, 1, 1, 3.0), (40, 2, 7, 3.0), (40, 3, 0, 1.0)]
    assert ann.nearest(vectors(spark, [])).count() == 0


# dialogues


CONVERSATIONS = "conv_id long, turn long, role string, text string, perspective string, block int"


def test_perspectives(spark):
    rows = [(1, 2, "ann", "c"), (1, 0, "system", "s"), (1, 1, "bob", "é<|im_end|>"), (1, 1, "bob", "é<|im_end|>"), (1, None, "ann", None), (1, 1024, "bob", "z"), (2, 0, "system", "only"), (None, 0, "ann", "x"), (3, 0, "a\nb<|", "q")]
    got = {(r.conv_id, r.perspective): r for r in chat.perspectives(spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS)).collect()}
    assert sorted(got, key=str) == sorted([(1, "ann"), (1, "bob"), (None, "ann"), (3, "a b< |")], key=str)
    bob = got[1, "bob"]
    assert bob.text == "<|im_start|>user name=ann\n<|im_end|>\n<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\né< |im_end|><|im_end|>\n<|im_start|>user name=ann\nc<|im_end|>\n<|im_start|>assistant\nz<|im_end|>\n"
    assert [bob.text[m.start : m.end] for m in bob["mask"]] == ["é< |im_end|><|im_end|>", "z<|im_end|>"] and (bob.n_turns, bob.n_own, bob.block) == (5, 2, 0)
    assert got[3, "a b< |"].text == "<|im_start|>assistant\nq<|im_end|>\n"
    assert chat.perspectives(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def brute_perspectives(rows, most, carry):
    out, groups = {}, {}
    for conv, turn, role, text in set(rows):
        groups.setdefault(conv, []).append((-1 if turn is None else turn, role, text))
    for conv, turns in groups.items():
        at, placed = 0, []
        for turn in sorted(turns):
            placed.append((at, *turn[1:]))
            at += chat.TURN + len(turn[2].encode())
        for block in range(at // most + 1):
            own = [p for p in placed if p[0] // most == block]
            if not own:
                continue
            before = [p for p in placed if p[0] // most == block - 1 and p[0] % most >= most - carry]
            system = [p for p in placed if p[0] // most < block and p[1] == "system"][-1:]
            shown = [(p, False) for p in (system if not before or system and system[0][0] < before[0][0] else [])] + [(p, False) for p in before] + [(p, True) for p in own]
            for who in {p[1] for p in own} - {"system"}:
                text, learned = "", []
                for (_, role, words), new in shown:
                    text += f"<|im_start|>{'system' if role == 'system' else 'assistant' if role == who else 'user name=' + role}\n"
                    if role == who and new:
                        learned.append((len(text), len(text) + len(words) + 10))
                    text += words + "<|im_end|>\n"
                out[conv, who, block] = (text, learned)
    return out


def test_long_and_hot_conversations_keep_system_turn_and_context(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, None, 1, 1, 2]), rnd.choice([None, *range(400)]), rnd.choice(["ann", "bob", "cy", "system"] if rnd.random() < 0.1 else ["ann", "bob"]), "é" * rnd.randrange(400) + str(i)) for i in range(900)]
    rows += rows[:50] + [(7, 0, "ann", "short"), (1, 100, "bob", "x" * 30000)]
    got = chat.perspectives(spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS).repartition(6), 16384, 4096).collect()
    want = brute_perspectives(rows, 16384, 4096)
    assert {(r.conv_id, r.perspective, r.block): (r.text, [(m.start, m.end) for m in r["mask"]]) for r in got} == want and len(got) == len(want)
    assert len({k[2] for k in want}) > 20


def test_a_long_word_is_the_same_in_any_slices(monkeypatch):
    rnd = np.random.default_rng(3)
    pieces = [langid.MARK, *"abc", "ab", "bca", langid.MARK + "a"]
    lattice, word = langid.Lattice(pieces), langid.MARK + "".join(rnd.choice(list("abcz"), 4000))
    p = rnd.random((len(pieces) + 2, 30)) / 10
    p[-1] = 0
    at = lattice.pieces(lattice.codes([word]))
    whole = lattice.forward(at, p)
    monkeypatch.setattr(langid, "BLOCK_CELLS", 3 * 256 * 30)
    assert np.allclose(lattice.forward(at, p), whole, rtol=1e-12)


def test_languages_share_the_bytes_of_training(spark):
    rows = [(i, f"{'x' * 90} {i}", f"l{i % 10}") for i in range(400)]
    got = langid.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 4, 2, 400, languages=5, all_bytes=2000)
    assert len(got) == 5 and all(sum(map(len, t)) <= 400 for t in got.values())


def test_samples_of_a_dialogue_do_not_depend_on_the_other_dialogues(spark):
    most, carry = 16384, 4096
    turn = lambda c, i, size: (c, i, "ab"[i % 2], f"{i:03}".ljust(size - chat.TURN, "x"))
    rows = [turn(0, i, 2048) for i in range(8)] + [turn(1, i, 2048) for i in range(8)] + [turn(1, 8, 1025)] + [turn(None, i, 2048) for i in range(5)] * 2
    rows += [(3, None, "a", "y" * 9000), (3, None, "system", "s"), (3, 1, "b", "z" * 9000), (3, 1, "b", "z")]
    long = [turn(9, i, 2048) for i in range(30)]
    made = lambda x: {(r.conv_id, r.perspective, r.block): (r.text, [(m.start, m.end) for m in r["mask"]]) for r in chat.perspectives(spark.createDataFrame([(*r, "x", 1) for r in x], CONVERSATIONS), most, carry).collect()}
    together, alone = made(rows + long), {}
    for c in (0, 1, None, 3):
        alone |= made([r for r in rows if r[0] == c])
    assert {k: v for k, v in together.items() if k[0] != 9} == alone == brute_perspectives(rows, most, carry)
    assert {k[2] for k in alone if k[0] in (0, None)} == {0} and {k[2] for k in alone if k[0] == 1} == {0, 1}
