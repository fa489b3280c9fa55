"""Tokens, packing, syncmers, quality, html: each against brute force or by its defined results."""

import base64
import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import html_text, packing, quality, syncmers, tokens

EDGE = "doc_id long, text string, score double, bucket string, length string"
BITS = ["a", "Word.", "WORD!!", "b ", " ", "\n", "  ", "'s", "é", "é", "<|endoftext|>", "😀", "　", "\x1c", "\x85", "1", "漢", ".", " the", "x's", "Ναϊ"]


def odd_texts(n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (4, "one two"), (4, "other"), (5, long), (6, "x" * 60_000), (None, "no id"), (7, "漢" * 20_000)]
    return spark.createDataFrame([(i, t, 0.5, "b", "l") for i, t in rows], EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EDGE)


def test_token_counts_equal_the_library():
    path = tokens.default_tokenizer()
    library, counter, small = tokens.load(path), tokens.Counter(path), tokens.Counter(path, chunk=40, overlap=6)
    texts = odd_texts(400, 120)
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == wanted
    assert [small.count(t) for t in texts] == wanted


def test_overlaps_are_spliced_without_gaps():
    counter = tokens.Counter(tokens.default_tokenizer(), chunk=50, overlap=4)
    text = "alpha beta " * 40 + "x" * 300 + " gamma" * 20
    spans = list(counter.spans(text))
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(n for *_, n in spans) == len(counter.tokenizer.encode(text).ids)


def test_token_counts_of_edge_rows(edge, empty):
    got = tokens.count_tokens(edge).collect()
    library = tokens.load(tokens.default_tokenizer())
    wanted = collections.Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "").ids)) for r in edge.collect())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == wanted
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and tokens.count_tokens(empty).count() == 0


def test_packing_ids_equal_the_library():
    path = packing.default_tokenizer()
    library, encoder = tokens.load(path), packing.Encoder(path)
    for text in odd_texts(400, 60):
        assert encoder.ids(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_encodes_a_word_once_in_any_case_and_with_any_marks():
    path = packing.default_tokenizer()
    library, encoder = tokens.load(path), packing.Encoder(path, (7,), most=40)
    asked, model = [], encoder.model

    class Model:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    encoder.model = Model()

    def same(texts):
        ids, ends = encoder.encode(pa.array(texts, pa.string()))
        wanted = [library.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == wanted

    same(["Zorble zorble, ZORBLE! (zorble) zorble.", None, "", " \n", "zorble... Zorble|"])
    same(["ZORBLE$ zorble"])
    assert asked == ["zorble"]
    # Forgetting what is used least changes no ids.
    for k in range(60):
        same([f"ZORBLE, {chr(97 + k % 26)}{chr(97 + k // 26)}x \x1c{k}' Éa{chr(97 + k % 26)}. <|endoftext|>a, é É! ", "  "] + odd_texts(3, 30, k))
        assert len(encoder.places) <= 40 + 60
    assert asked.count("zorble") < 10
    # A tokenizer whose model doesn't see plain words letter by letter gets whole words.
    assert packing.letter_pieces(library) and packing.letter_pieces(tokens.load(tokens.default_tokenizer())) is None
    encoder.letters = None
    same(["Wombly wombly, WOMBLY!", "é"])


def test_known_words_are_looked_up_once_and_not_compared():
    compared = []

    class Value(bytes):
        __hash__ = bytes.__hash__

        def __eq__(self, other):
            compared.append(other)
            return bytes.__eq__(self, other)

    asked = []
    memo = tokens.Memo(lambda words: (asked.append(sorted(words)), [Value(w.encode()) for w in words])[1], most=2000)
    assert memo.all(["a", "b", "a", "b!", "x" * 99]) == [b"a", b"b", b"a", b"b!", b"x" * 99]
    asked.clear(), compared.clear()
    found = memo.all(["b!", "a", "b", "a"])
    assert not asked and not compared and found == [b"b!", b"a", b"b", b"a"]
    # Forgetting all changes no value; words too long to keep are asked for again.
    for k in range(40):
        assert memo.all([f"n{k}", "a", f"n{k},", "x" * 99]) == [f"n{k}".encode(), b"a", f"n{k},".encode(), b"x" * 99]


def check_packed(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_packing_edge_rows(edge, empty):
    got = packing.pack(edge, capacity=64).collect()
    bins = check_packed(got, 64)
    assert bins == -(-sum(r.length for r in got) // 64)
    library = tokens.load(packing.default_tokenizer())
    wanted = collections.Counter()
    for r in edge.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        wanted.update((r.doc_id, k, at, len(ids[at : at + 64]), zlib.crc32(np.asarray(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    assert packing.pack(empty).count() == 0


def test_plan_places_every_piece_once():
    rng = random.Random(4)
    counts = collections.Counter(rng.choice((7, 100, 64, rng.randint(1, 100))) for _ in range(3000))
    patterns = packing.plan(dict(counts), 100)
    placed = collections.Counter()
    for _, times, lengths in patterns:
        assert sum(lengths) <= 100
        placed.update({n: times * k for n, k in collections.Counter(lengths).items()})
    assert placed == counts
    # No packing does with fewer bins than the sum asks for, nor than there are pieces of more than half a bin.
    least = max(-(-sum(k * v for k, v in counts.items()) // 100), sum(v for k, v in counts.items() if k > 50))
    assert sum(t for _, t, _ in patterns) <= 1.02 * least + 1


def test_two_replace_the_smallest():
    # Greedy puts 6 and 3 into a bin of 10; 6 with 2 and 2 fills it.
    assert packing.best_two(np.bincount([2, 2, 9], minlength=11), 4) == [2, 2]
    assert [x[2] for x in packing.plan({6: 1, 3: 1, 2: 2}, 10)] == [[6, 2, 2], [3]]


def brute_syncmers(text, k, s):
    inner = syncmers._grams(syncmers._mixed(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + syncmers._BASE), s)
    w = k - s + 1
    return [i for i in range(len(text) - k + 1) if inner[i : i + w].min() in (inner[i], inner[i + w - 1])]


def test_syncmers_are_those_of_the_definition():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice("abcé ") for _ in range(rng.randint(16, 200)))
        h, at = syncmers.anchors(text)
        assert at.tolist() == brute_syncmers(text, syncmers.K, syncmers.S)
        # Context-free: the same stretch has the same anchors elsewhere.
        g, to = syncmers.anchors("zz" + text)
        inside = to >= 2
        assert (to[inside] - 2).tolist() == at.tolist() and g[inside].tolist() == h.tolist()


def plain_likeness(one, other):
    """By all syncmers of both texts, as pairs of the k-mer's own characters and its first place."""
    places = [{t[i : i + syncmers.K]: i for i in reversed(brute_syncmers(t, syncmers.K, syncmers.S))} for t in (one, other)]
    both = sorted((i, -places[1][g]) for g, i in places[0].items() if g in places[1])
    ends = []  # the longest rising chain, by patience
    for _, to in both:
        at = next((n for n, e in enumerate(ends) if e >= -to), len(ends))
        ends[at : at + 1] = [-to]
    return 2 * len(ends) / (len(places[0]) + len(places[1]))


def test_likeness_is_that_of_all_anchors():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij éß") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    off = []
    for n in (30, 100, 300, 600, 1200, 2500, 4000):
        for part in (0.0, 0.1, 0.5, 0.9):
            one, two = make(n), make(n)
            cut = int(part * len(one))
            two = two[: len(two) // 3] + one[:cut] + two[len(two) // 3 :] if part < 0.5 else one[:cut] + two[cut:]
            off.append(abs(syncmers.likeness(syncmers.fingerprint(one), syncmers.fingerprint(two)) - plain_likeness(one, two)))
            assert off[-1] < 1e-9 or n > 300  # short texts keep all anchors
            assert abs(syncmers.likeness(syncmers.fingerprint(one, share=1.0), syncmers.fingerprint(two, share=1.0)) - plain_likeness(one, two)) < 1e-9
    assert np.mean(off) < 0.01 and max(off) < 0.05
    # A passage of a twentieth of another text always shows.
    for _ in range(40):
        other, passage = make(1500), make(75)
        mixed = other[:4000] + passage + other[4000:]
        assert syncmers.likeness(syncmers.fingerprint(passage + make(1400)), syncmers.fingerprint(mixed)) > 0.01


def test_fingerprints_of_long_texts_keep_all_anchors():
    rng = random.Random(12)
    one, two = ("".join(rng.choice("abcdefgh ") for _ in range(30_000)) for _ in range(2))
    mixed = syncmers.edited(one, two)
    h, _ = syncmers.anchors(one)
    held = np.frombuffer(base64.b64decode(syncmers.fingerprint(one)), "<u4")
    assert (len(held) - 1) // 2 == len(np.unique(h >> np.uint64(32)))
    assert abs(syncmers.likeness(syncmers.fingerprint(one), syncmers.fingerprint(mixed)) - plain_likeness(one, mixed)) < 1e-9


def test_syncmers_of_edge_rows(edge, empty):
    rows = [r for r in syncmers.compare_with_edits(edge).collect()]
    source = sorted({(r.doc_id if r.doc_id is not None else -1, r.text or "") for r in edge.collect()})
    first = {}
    for i, t in source:
        first.setdefault(i, t)
    ids = sorted(first)
    assert len(rows) == edge.count()
    texts = collections.Counter()
    for i, t in ((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in edge.collect()):
        following = first[ids[ids.index(i) - 1]]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        one, two = syncmers.fingerprint(t), syncmers.fingerprint(changed)
        texts[(i, len(t), hashlib.sha256(changed.encode()).hexdigest(), one, two, round(syncmers.likeness(one, two), 9), round(syncmers.likeness(one, syncmers.fingerprint(following)), 9))] += 1
    assert texts == collections.Counter((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    assert syncmers.compare_with_edits(empty).count() == 0


def test_syncmers_find_the_edited_half(spark, sf_dir):
    rows = syncmers.compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("n_chars > 200").collect()
    assert np.mean([r.near_edited for r in rows]) > 0.4 and np.mean([r.near_next for r in rows]) < 0.05


def test_trees_learn_and_walk_alike():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.fit(x[:1000], y[:1000], rounds=60)
    assert ((trees.score(x[1000:]) > 0.5) == y[1000:]).mean() > 0.93

    def walk(row):
        raw, bins = trees.base, trees.binned(row[None])[0]
        for node in trees.roots:
            for _ in range(trees.depth):
                node = trees.left[node] if bins[trees.feature[node]] <= trees.bin[node] else trees.right[node]
            raw += trees.value[node]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose([walk(r) for r in x[1000:1020]], trees.score(x[1000:1020]))


def test_compressed_is_of_the_whole_text():
    rng, at = random.Random(4), quality.STATISTICS.index("compressed")
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    for n in (0, 1000, 600_000):
        text = " ".join(rng.choice(words) for _ in range(n))
        raw = text.encode()
        assert quality.statistics(text)[at] == len(zlib.compress(raw, 1)) / max(1, len(raw))
    assert len(raw) > 3 << 20 and abs(quality.statistics(text)[at] - quality.statistics(text[: 1 << 20])[at]) < 0.01


def test_quality_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    judged = got.join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in judged]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in judged)


def test_quality_edge_rows(spark, edge, empty, sf_dir):
    labels = spark.createDataFrame([(4, 1), (4, None), (5, 7), (None, 0)], "doc_id long, quality int")
    got = quality.classify(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(empty, labels).count() == 0 and quality.classify(edge, labels.limit(0)).first().score == 0.5
    kept = quality.accepted(edge, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept.columns == edge.columns and kept.count() <= edge.count()


def simple_truth(page):
    import html
    import re

    article = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    found = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?h1>|</?p>", article)]
    return "\n".join(b for b in found if b)


def test_html_of_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    wanted = {r.page_id: simple_truth(r.html) for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == wanted and all(r.n_chars == len(r.text) for r in got)


def test_html_on_layouts_it_was_not_trained_on():
    field, right, total = html_text.default_field(), 0, 0
    for page, labels in html_text.labelled_pages(150, seed=99):
        kept = field.decode(page)
        texts = [b[0] for b in html_text.blocks(page)]
        wanted = [t for t, label in zip(texts, labels, strict=True) if label]
        right += sum((collections.Counter(kept) & collections.Counter(wanted)).values())
        total += max(len(kept), len(wanted))
    assert right / total > 0.98


def test_viterbi_is_the_best_path():
    import itertools

    rng = random.Random(3)
    for _ in range(50):
        field = html_text.Field({}, [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)])
        scores = [rng.uniform(-2, 2) for _ in range(7)]

        def total(labels, field=field, scores=scores):
            return sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(field.pairs[a][b] for a, b in zip(labels, labels[1:], strict=False))

        assert abs(total(field.viterbi(scores)) - max(map(total, itertools.product((0, 1), repeat=7)))) < 1e-9


def test_html_blocks_and_edge_rows(spark):
    page = "<title>t</title><body><p>a&amp;b <b>c</b>d<br>e<p>f<script>'<p>x'</script><ul><li>g<li>h</ul><!-- <p>no --><td attr='>'>i"
    assert [b[0] for b in html_text.blocks(page)] == ["a&b cd e", "f", "g", "h", "i"]
    rows = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (2, None, "", 1), (3, "u", "<article><p>" + "word. " * 30_000, 1), (None, "u", "<a <b> < & &#x41; &bogus; <p", 1)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_text.extract(rows).collect()}
    assert got[1].text == got[2].text == "" and got[3].n_chars == 6 * 30_000 - 1 and html_text.extract(rows).count() == 5
    assert html_text.extract(rows.limit(0)).count() == 0


def test_html_with_the_tags_of_head_and_body_left_out(spark, sf_dir):
    import re

    shown = {"<article><p>a</article>": ["a"], "a<p>b": ["a", "b"], " <!-- c --> <p>a": ["a"], "<head><img><h1>a</h1>b": ["a", "b"], "<noframes><p>n</noframes><p>a<title>u</title>b": ["a", "b"], "&#32;<body><p>a": ["a"]}
    for rest, texts in shown.items():
        page = "<html><head><meta charset=x><title>T</title><script>'<p>s'</script><link href=y>\n<style>p {}</style>" + rest
        assert [b[0] for b in html_text.blocks(page)] == texts
    assert html_text.blocks("<head><title>t</title><noscript><p>n</noscript></head>") == []
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(100)
    rows = [(r.page_id, re.sub("</head>|</?body[^>]*>", "", r.html), simple_truth(r.html)) for r in pages.collect()]
    cut = spark.createDataFrame([(i, "u", h, 1) for i, h, _ in rows], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r.text for r in html_text.extract(cut).collect()}
    assert any(text for _, _, text in rows) and all("<head>" in h and "<body" not in h for _, h, _ in rows)
    assert got == {i: text for i, _, text in rows}


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<b>" * n + "x</i>" * n, lambda n: "".join(f'<span class="{chr(97 + i % 26)}{"".join(chr(97 + int(c)) for c in str(i))}">x<p>' for i in range(n)), lambda n: '<a "' * n, lambda n: '<a ">"' * n,
        lambda n: "<i><td>" + "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "x</div>" * n, lambda n: "<script>" + "</script " * n, lambda n: "<b>" * n + "<svg><body>" * n, lambda n: "<!-- " * n, lambda n: "<a" * n,
    ],
)
def test_hostile_pages_take_time_in_proportion(make):
    """Up to a megabyte of markup: no search goes over the same open elements or the same rest of the page again and again."""
    field = html_text.Field({}, [[0.0, 0.0], [0.0, 0.0]])

    def took(n):
        began = time.process_time()
        field.decode(make(n))
        return time.process_time() - began

    took(1000)
    assert took(50_000) < 2.6 * took(25_000) + 0.5
