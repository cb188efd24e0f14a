"""The operators on texts, against brute force, on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import chat, html_text, ngram_jaccard, packing, quality, token_counts, toxicity
from sievework.llm.byte_bpe import encode_decode, loaded
from sievework.llm.components import components
from sievework.llm.exact_dedup import exact_dedup
from sievework.llm.linking import Block
from sievework.llm.ngram_jaccard import jaccard_components
from sievework.llm.shingles import Shingler

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE = public_tokenizers.path("byte_bpe_50k.json")
KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, row string, key string"


def sample_text(r, n):
    return " ".join(r.choice(["the", "Of", "and", "rend", "é", "中文", "x1", "idiot", "don't", "a,b"]) for _ in range(n))


def awkward(spark, seed=0):
    """Null ids, texts and other columns; empty and blank texts; copies; repeated rows; a long text."""
    r = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "one", "One", "one two three four", "a b c d e", "a b c d e f g h i j k l m n o p"]
    texts += ["a b c d e f g h i j k l m n o q", sample_text(r, 9000), "!" * 3000, "\x00  ﻿", "<s>[INST] \\ </s>"]
    base = sample_text(r, 60).split()
    for _ in range(30):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(["new", "words", "here"])
        texts.append(" ".join(words))
    rows = [(k * 3, x, None, "src" if k % 2 else None, None, 0.5, k, "r", "k") for k, x in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "one", None, None, None, None, None, None, None)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, KIND).repartition(5)


def empty(spark):
    return spark.createDataFrame([], KIND)


def test_exact_dedup(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        want = []
        for i, t in rows:
            top = pick(x for x in groups[t] if x is not None)
            want.append((i, top, len(groups[t]), i == top, hashlib.sha256(t.encode()).hexdigest()))
        got = [tuple(r) for r in exact_dedup(docs, keep=keep).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup(empty(spark)).count() == 0


def brute_components(rows, percent=75):
    sets = {}
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("block", [1_500_000, 60])
def test_jaccard_components(spark, block):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components([x for x in rows if x[0] is not None])
    got = jaccard_components(docs, block_shingles=block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == want[r.doc_id]


def test_jaccard_on_families_with_shared_passages(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(55)] for _ in range(3)]
    rows = []
    for family in range(12):
        base = [word() for _ in range(r.choice([20, 60, 150]))] + r.choice(passages)
        for _ in range(r.choice([1, 2, 9])):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, " ".join(passages[0] + [word()] * k)) for k in range(8)]
    want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(docs).collect()} == want


def with_a_passage():
    """Documents that share a passage, near copies of some, and short pieces of the passage."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    rows = [(k, " ".join(passage + [word() for _ in range(25)])) for k in range(120)]
    rows += [(200 + k, f"{rows[k][1]} {word()}") for k in range(10)]
    return rows + [(300 + k, " ".join(passage[k : k + 6 + k % 3])) for k in range(30)]


def test_jaccard_with_a_passage_of_many_documents(spark):
    rows = with_a_passage()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(docs).collect()} == brute_components(rows)


def test_a_passage_of_many_documents_joins_nothing(spark):
    """Also the part of it that no document emits, since it comes late in the order of hashes."""
    docs = spark.createDataFrame(with_a_passage(), "id long, text string").repartition(4)
    classes = ngram_jaccard._sets(docs, 5).groupBy("key_a", "key_b").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    loose = components(ngram_jaccard._loose(docs, classes, 5, 75)).join(classes, F.col("node") == F.col("key_a"))
    assert loose.where("rep < 300").groupBy("component").count().agg(F.max("count")).first()[0] == 2


def test_jaccard_empty_table(spark):
    assert jaccard_components(empty(spark)).count() == 0


def test_block_links_are_exact():
    r = random.Random(3)
    for _ in range(60):
        bases = [set(r.sample(range(200), r.randint(1, 30))) for _ in range(3)]
        sets = []
        for _ in range(r.randint(1, 30)):
            own = set(r.choice(bases))
            for _ in range(r.randint(0, 6)):
                own ^= {r.randrange(300)}
            if own:
                sets.append(own)
        up = list(range(len(sets)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
        got = Block([np.array(sorted(x), np.uint64) for x in sets], 75).linked()
        assert got.tolist() == [root(i) for i in range(len(sets))]


def test_shingles_count_words_as_defined():
    shingler = Shingler()
    for text, n in (("", 0), (" \x0b\x0c\r", 0), ("a", 1), ("A b", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a a", 1), ("a b", 1)):
        assert len(shingler(text)) == n
    assert (shingler("THE of\tX y Z") == shingler("the OF x\ny z")).all() and (shingler("É a") != shingler("é a")).all()


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 200)] + [(5, k) for k in range(300, 340)] + [(7, 7), (None, 3), (-4, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 100 for k in range(100, 201)} | {k: 5 for k in [5, *range(300, 340)]} | {-4: -4, 9: -4}
    assert got == want


def test_bpe_round_trip(spark):
    docs = awkward(spark)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=loaded(RANKS).ranks, special_tokens={})
    texts = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    got = sorted((r.doc_id or -1, bytes(r.decoded).decode(), np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.ids_sha256) for r in encode_decode(docs, RANKS).collect())
    for (i, text), (j, decoded, ids, n, digest) in zip(texts, got, strict=True):
        assert i == j and decoded == text and ids == library.encode_ordinary(text) and n == len(ids)
        assert digest == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert encode_decode(empty(spark), RANKS).count() == 0


def test_bpe_on_random_signs():
    bpe, r = loaded(RANKS), random.Random(1)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    signs = list("aabst'rvelmd  \n\t  é中1２½!?.#ñ 　​\x1c\x85") + ["'ll", "'s", "<|endoftext|>"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(3000)]
    texts += ["ab" * 2000, "".join(r.choices("abcdefghij", k=1500)), " " * 700, "中文字" * 300]
    assert [x.tolist() for x in bpe.coded(texts)] == [library.encode_ordinary(x) for x in texts]


def test_toxicity_of_repeated_words(spark):
    """Documented: repetitions in a row count once, wherever they are in the text."""
    clean = [f"some kind words {k}" for k in range(40)]
    model = toxicity.train(clean + [f"{x} you idiot" for x in clean], np.repeat([0, 1], 40))
    texts = ["idiot", "idiot " * 500, "Idiot idiot", "some idiot words", "some some idiot idiot idiot words words", "some kind words", "words " * 500]
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert found[0] == found[1] == found[2] and found[3] == found[4] and found[3] > 0.5 > max(found[5], found[6])


def test_packing(spark):
    docs = awkward(spark)
    tokenizer = Tokenizer.from_file(BPE)
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    seen, sequences, many = {}, {}, {k: len(v) for k, v in ids.items()}
    for r in packing.pack(docs, BPE).collect():
        own = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)
        part = own[r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {k: sum(map(len, v)) for k, v in ids.items()} and all(many.values())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    assert packing.pack(empty(spark), BPE).count() == 0


def test_packing_of_added_tokens(spark):
    """Against the tokenizer with its default setting."""
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end} x", f" it's {end} 's{end}", "<|endoftext|", f"<|{end}\n  \n{end}  y", "plain words", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(BPE)
    want = [[*tokenizer.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    assert want[0] == [64, 50256, 65, 1]
    coded = packing._coder(BPE)
    assert [[*x.tolist(), 1] for x in coded(texts)] == want
    for r in packing.pack(docs, BPE).collect():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_fullest_windows():
    from itertools import product

    r = random.Random(2)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 4))}
        space = r.randint(0, 60)
        used = packing.closest(sorted(counts), counts.get, space)
        sums = [sum(k * n for k, n in zip(counts, many)) for many in product(*[range(v + 1) for v in counts.values()])]
        assert all(n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(x for x in sums if x <= space)


def greedy(word, pieces):
    at, n, word = 0, 0, (*word, token_counts.END)
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_longest_match_against_greedy():
    r = random.Random(1)
    for _ in range(150):
        pieces = [tuple(r.choices(b"abc", k=r.randint(1, 4))) + (token_counts.END,) * r.randint(0, 1) for _ in range(r.randint(1, 25))]
        words = [bytes(r.choices(b"abc", k=r.randint(1, 12))) for _ in range(30)]
        got = token_counts.LongestMatch(pieces).counts(words).tolist()
        assert got == [greedy(w, set(pieces)) for w in words]


def test_token_counts(spark):
    docs, path = awkward(spark), public_tokenizers.path("word_bpe_49k.json")
    got = sorted(((r.doc_id or -1, r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()))
    automaton = token_counts.loaded(path)
    want = []
    for r in docs.collect():
        words = (r.text or "").lower().split()
        parts = [p.encode() for w in words for p in token_counts.PARTS.findall(w)]
        want.append((r.doc_id or -1, len(words), int(automaton.counts(parts).sum())))
    assert got == sorted(want) and token_counts.count_tokens(empty(spark), path).count() == 0


@pytest.mark.parametrize("opening", ["<div>", "<font>", "<a><b>", "<ul><li>", "<table><tr><td>", "<blockquote>"])
def test_visibility_in_deep_pages(opening):
    """What is hidden stays so at any depth, and ends close their own elements."""
    within = "<script>var x = 1;</script><style>b {}</style><div style='display:none'>no<b>no</b></div><div>in</div>"
    for many in (10, 200, 3000):
        tag = opening.rsplit("<", 1)[1][:-1]
        text = html_text.visible_text(f"<div hidden>{opening * many}{within}{f'</{tag}>' * many}no</div>")
        assert text == ""
        lines = html_text.visible_text(opening * many + within).split()
        assert lines[-1] == "in" and not {"no", "var", "b"} & set(lines)
    assert html_text.visible_text("<div>" * 300 + "a" + "</div>" * 299 + "<p hidden>b" + "</div>c") == "a\nc"


def test_html():
    page = """<html><head><title>t</title></head><body><h1>Head &amp; more</h1><p>One <b>two</b>three\n four<p hidden>no<p>five<br>six
    <ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><table><tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td>kiwi fruit<td>2</table>
    tail<pre>\n a\n   b</pre><div style="display: none">z</div><script>var a = "</p>";</script>1 < 2 <unclosed"""
    want = "Head & more\n\nOne twothree four\n\nfive\nsix\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nName        Qty\napple       10\nkiwi fruit  2\n\ntail\n\n a\n   b\n\n1 < 2"
    assert html_text.visible_text(page) == want
    assert html_text.visible_text("<div>" * 5000 + "deep") == "deep"
    r = random.Random(1)
    bits = ["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "<ul>", "<li>", "x ", "<!--", "-->", "<", "&lt;", "<td colspan=3>", "<div", "'", '"', ">"]
    for _ in range(500):
        html_text.visible_text("".join(r.choices(bits, k=25)))


def test_html_rows(spark):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (2, None, None), (3, "", "y"), (None, "<li>b", "z")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r.page_id or 0, r.text) for r in html_text.extract_text(pages).collect())
    assert got == [(0, "b"), (1, "a"), (1, "a"), (2, ""), (3, "")]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_chat_round_trip():
    r = random.Random(0)
    bits = ["a", "\\", "\n", *chat.CONTROL, "<", "|", chat.PROBE]
    for _ in range(400):
        turns = [("".join(r.choices(["user", "assistant", "\n", "\\", "<s>"], k=r.randint(0, 2))), "".join(r.choices(bits, k=r.randint(0, 6)))) for _ in range(r.randint(1, 4))]
        text, found, rewrote = chat.spans(turns, chat.marked)
        assert not rewrote and chat.read_back(text) == turns
        assert [chat.unescape(text[c:d]) for _, _, c, d in found] == [x for _, x in turns]


def test_templates_that_rewrite_history_are_found():
    forget = lambda turns: "".join(f"[{r}:{t if k == len(turns) - 1 else ''}]" for k, (r, t) in enumerate(turns))
    closing = lambda turns: "".join(f"[{r}:{t}]" for r, t in turns) + "END"
    for template in (forget, closing):
        assert chat.spans([("u", "hello"), ("a", "there")], template)[2]


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 1), (2, None, None, None, None), (2, 0, "assistant", "</s>", 0), (2, 0, "assistant", "</s>", 0)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chats)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and got[1].loss_chars == 1
    assert got[2].n_turns == 3 and got[2].loss_sha256 == hashlib.sha256(b"</s></s>").hexdigest()
    assert chat.format_chats(chats.limit(0)).count() == 0


def test_toxicity_learns_words_and_their_misspellings(spark):
    r = random.Random(5)
    clean = [sample_text(r, r.randint(5, 300)).replace("idiot", "nice") for _ in range(150)]
    toxic = [f"{x} you idiot {x}" for x in clean]
    model = toxicity.train(clean + toxic, np.array([0] * 150 + [1] * 150))
    got = toxicity.scores(["the and of", "such an idiot", "such an idi0t", "", sample_text(r, 3000).replace("idiot", "rend")], model, {})
    assert got[0] < 0.5 < got[1] and got[2] > 0.5 and got[3] < 0.5 and got[4] < 0.5
    docs = awkward(spark)
    assert toxicity.score_toxicity(docs, model).where("score BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity.rows_with_toxicity(docs, model).select("row.*").columns == docs.columns
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_quality_network(spark):
    r = random.Random(6)
    good = [sample_text(r, r.randint(30, 300)) for _ in range(60)]
    bad = [" ".join([r.choice(["ab", "cd"])] * r.randint(30, 300)) for _ in range(60)]
    net = quality.train(good + bad, np.array([1] * 60 + [0] * 60), epochs=12)
    got = quality.scores([sample_text(r, 200), "ab " * 200, ""], net)
    assert got[0] > 0.5 > got[1] and 0 <= got[2] <= 1
    long = (sample_text(r, 300) + " ") * 1200
    raw = long.encode()
    assert len(raw) > quality.BYTES_AT_ONCE and np.allclose(quality._long(raw, net), quality._short([raw], net))
    docs = awkward(spark)
    assert quality.score_quality(docs, net).where("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality.score_quality(empty(spark), net).count() == 0


def test_quality_gradient():
    """The written-out gradient against finite differences."""
    r = np.random.default_rng(0)
    raws, labels = [b"some text of a few words " * 12, b"xx yy " * 50], np.array([1, 0])
    net = quality.Network(
        r.normal(0, 0.5, (257, quality.EMBEDDED)), r.normal(0, 0.25, (2, quality.BLOCK * quality.EMBEDDED, quality.FILTERS)),
        r.normal(0, 0.1, quality.FILTERS), r.normal(0, 0.3, 3 * quality.FILTERS), np.zeros(1),
    )

    def loss():
        points, halves = quality.laid_out(raws)
        p = quality.probability(quality.described(quality.pooled(net, points, halves)[0], halves) @ net.weights + net.bias)
        return -np.mean(np.where(labels == 1, np.log(p), np.log(1 - p))) + 0.5e-4 * (net.weights**2).sum()

    for x, g in zip(net.parameters(), quality.backward(net, raws, labels), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        x[at] += 1e-5
        up = loss()
        x[at] -= 2e-5
        down = loss()
        x[at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=0.02)


def test_scores_depend_on_the_text_alone(spark):
    """Alone, together, in another order, and over other partitions: to the last bit."""
    r, g = random.Random(4), np.random.default_rng(3)
    texts = ["", "a", "ab c", "x" * 127, "x" * 128, "x" * 129, "é" * 64, " \n"] + [sample_text(r, r.randint(1, 400)) for _ in range(60)]
    net = quality.Network(
        g.normal(0, 0.5, (257, quality.EMBEDDED)).astype("f4"), g.normal(0, 0.25, (2, quality.BLOCK * quality.EMBEDDED, quality.FILTERS)).astype("f4"),
        g.normal(0, 0.1, quality.FILTERS).astype("f4"), g.normal(0, 0.3, 3 * quality.FILTERS).astype("f4"), np.zeros(1, "f4"),
    )
    bad = toxicity.train([x for x in texts if x.strip()], np.arange(sum(bool(x.strip()) for x in texts)) % 2, epochs=6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for score, over in (
        (lambda x: quality.scores(x, net), lambda d: quality.score_quality(d, net)),
        (lambda x: toxicity.scores(x, bad, {}), lambda d: toxicity.score_toxicity(d, bad)),
    ):
        alone = [float(score([x])[0]) for x in texts]
        assert score(texts).tolist() == alone and score(texts[::-1]).tolist() == alone[::-1]
        for parts in (1, 7):
            got = {x.doc_id: x.score for x in over(docs.repartition(parts)).collect()}
            assert [got[k] for k in range(len(texts))] == alone


def test_quality_without_usable_labels(spark):
    texts = [sample_text(random.Random(k), 50) for k in range(6)]
    docs = spark.createDataFrame([(k + 1, x) for k, x in enumerate(texts)], "doc_id long, text string")
    kind = "doc_id long, quality int, toxic int"
    for rows, low, high in (([], 0.5, 0.5), ([(None, 1, 1), (2, None, None), (3, 7, 7), (99, 1, 1)], 0.5, 0.5), ([(k, 1, 1) for k in range(1, 7)], 0.5, 1.0)):
        labels = spark.createDataFrame(rows, kind)
        found = {x.score for x in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
        assert len(found) == 1 and low <= found.pop() <= high
        texts_, marks = toxicity.labelled_sample(docs, labels, "toxic", 10, 10_000)
        assert len(texts_) == len(marks) <= len(rows)
    twice = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 0, 0), (2, 0, 0)], kind)
    assert toxicity.labelled_sample(docs, twice, "quality", 10, 10_000)[1].tolist() == [1, 0]


def test_texts_in_templates_that_look_at_them():
    """Texts are found where what surrounds them depends on texts, and where a text is left out."""
    r = random.Random(2)
    sized = lambda turns: "".join(f"{role}({len(text)}):{text};" for role, text in turns)
    silent = lambda turns: "".join("#" if text == "skip" else f"<{text}>" for _, text in turns)
    for template in (sized, silent, chat.marked):
        for _ in range(60):
            turns = [("u", r.choice(["skip", "", "a(b", ";", chat.PROBE, chat.PROBE * 2, "x" * 50, "12):"])) for _ in range(r.randint(1, 12))]
            text, found, rewrote = chat.spans(turns, template)
            assert not rewrote and text == template(turns)
            for (_, own), (_, _, low, high) in zip(turns, found, strict=True):
                assert text[low:high] == own or (template is silent and own == "skip")


def test_long_conversations_and_texts(spark):
    many = [("user" if k % 2 else "assistant", f"turn {k} \\ <s>") for k in range(3000)]
    long = [("user", "[INST] word \n" * 100_000), ("assistant", "\\" * 100_001)]
    for turns in (many, long):
        text, found, rewrote = chat.spans(turns, chat.marked)
        assert not rewrote and chat.read_back(text) == turns
        assert [chat.unescape(text[c:d]) for _, _, c, d in found] == [x for _, x in turns]
    rows = [(1, k, role, text) for k, (role, text) in enumerate(many)] + [(2, k, *x) for k, x in enumerate(long)]
    got = {x.conv_id: x for x in chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv, turns in ((1, many), (2, long)):
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(turns), len(loss))
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_token_counts_against_greedy_on_the_vocabulary(spark):
    """Every word by greedy longest matching over the vocabulary's pieces, without the automaton."""
    import json
    import time
    import unicodedata

    path = public_tokenizers.path("word_bpe_49k.json")
    sign = {chr(b): b for b in packing.PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in packing.PRINTABLE)}
    pieces = set()
    for piece in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        bare = piece.removesuffix("</w>")
        if bare and set(bare) <= sign.keys():
            pieces.add((*map(sign.get, bare), *[token_counts.END] * (bare != piece)))

    def near(word):
        at, n, word = 0, 0, (*word, token_counts.END)
        while at < len(word):
            end = next((e for e in range(min(len(word), at + 130), at, -1) if word[at:e] in pieces), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    r = random.Random(7)
    texts = [sample_text(r, 40), "Don't re-read naïve CAFÉ café ½ 12345 ﬁn", "中文字 русский עברית 😀😀", "x" * 700, "ab" * 300 + " é" * 300, None, ""]
    texts += ["".join(r.choices("abcdeéñ中’'0 .-́", k=r.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_tokens) for x in token_counts.count_tokens(docs, path).collect()}
    for k, text in enumerate(texts):
        words = unicodedata.normalize("NFC", text or "").lower().split()
        assert got[k] == (len(words), sum(near(p.encode()) for w in words for p in token_counts.PARTS.findall(w)))
    automaton, began = token_counts.loaded(path), time.time()
    assert automaton.counts([b"abcdefgh" * 125_000])[0] > 0 and time.time() - began < 5


def test_clashing_digests_stop_the_job(spark):
    """Two texts of one digest differ in length or second hash: an error, not a lost document."""
    from pyspark.sql import functions as F

    from sievework.llm.exact_dedup import _merge

    rows = spark.createDataFrame([(0, b"d", 1, 1, 5), (0, b"d", 2, 1, 6)], "run int, digest binary, top long, n long, bytes int")
    rows = rows.withColumn("low", F.struct("bytes")).withColumn("high", F.struct("bytes"))
    with pytest.raises(Exception, match="two texts share a digest"):
        _merge(rows, ["run", "digest"]).collect()
    assert _merge(rows.where("bytes = 5"), ["run", "digest"]).count() == 1


SHOWN = [
    ("<p title=don't>text</p><p>it's</p>tail", "text\n\nit's\n\ntail"),
    ("<p title = 'a>b' class=\"x>y\" data-q=\">\">text<br/>more</p>", "text\nmore"),
    ("a<b c=d/>e</b>f <1 < 2 <", "aef <1 < 2 <"),
    ("a<!-- x > -- y -->b<!-->c<!--->d<!doctype html>e<?php f ?>g</ x>h<!-- never", "abcdegh"),
    ("a<p title='never>b</p>c", "a"),
    ("a</p  class=x>b<br>c</br>d", "a\n\nb\nc\nd"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>after", "yes\nafter"),
    ("<div style='display:none'>no <b style='visibility:visible'>no</b></div>after", "after"),
    ("<style>.a, #i {display:none} b.c{visibility:hidden} p {color:red}</style><i class='x a'>no</i><i id=i>no</i><b class=c>no</b><b>yes</b>", "yes"),
    ("<style>@media print {u {display:none}} @media screen{s{display:none}} /* i{display:none} */</style><u>yes</u><s>no</s><i>!</i>", "yes!"),
    ("<style media=print>u {display:none}</style><u>yes</u>", "yes"),
    ("<style>.a{display:none} .b{display:block}</style><i class='a b'>yes</i><i class=a style='display:inline'>too</i>", "yestoo"),
    ("<style>.a{display:none!important}</style><i class=a style='display:inline'>no</i><p hidden>no<p hidden style='display:block'>yes", "yes"),
    ("<style>div p{display:none} a:hover{display:none}</style><div><p>yes</p><a>yes</a></div>", "yes\n\nyes"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td rowspan=0>a<td rowspan=2>bb<td>c<tr><td>d<tr><td>e<td>f</table>", "a  bb  c\n       d\n   e   f"),
    ("<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>y</table>", "wide one  x\na  b  y"),
    ("<table><tbody><tr><td rowspan=5>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tfoot><tr><td>foot<tbody><tr><td>body<caption>cap</caption></table>", "cap\nbody\nfoot"),
    (f"<table><tr><td>{'w' * 200}<td>x<tr><td>a<td>y</table>", f"{'w' * 200}  x\n{'a':200}  y"),
    ("<ul><li>a<ul><li>b<p>c</p></ul><li hidden>no<li>d</ul><ol start=9><li>x<li value=3>y<li>z</ol>", "- a\n  - b\n\n    c\n\n- d\n\n9. x\n3. y\n4. z"),
    ("<blockquote>a<dl><dt>t<dd>d</dl></blockquote><pre>\n x\n  y</pre>z", "  a\n\n  t\n      d\n\n x\n  y\n\nz"),
    ("<textarea>\n<b>a</b>  b</textarea><select><option>o<option>p</select><img alt=pic><input value=v type=submit><input type=hidden value=no>", None),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>no</dialog>", "s\nt\nyes"),
    ("<plaintext>a<b>c", "a<b>c"),
]


@pytest.mark.parametrize(("page", "want"), SHOWN)
def test_what_pages_show(page, want):
    got = html_text.visible_text(page)
    if want is None:
        assert "<b>a</b>  b" in got and "o\np" in got and "pic" in got and "v" in got and "no" not in got
    else:
        assert got.replace(" \n", "\n") == want


def brute_text(page):
    """The words of pages without tables, lists or hidden parts: what is outside tags, by single signs."""
    out, inside, quote = [], False, ""
    for sign in page:
        if not inside:
            inside = sign == "<"
            out.append(" " if inside else sign)
        elif quote:
            quote = "" if sign == quote else quote
        elif sign in "\"'":
            quote = sign
        elif sign == ">":
            inside = False
    return "".join(out).split()


def test_all_words_of_plain_pages_show():
    r = random.Random(3)
    for _ in range(300):
        bits = ["<div class='a>b'>", "</div>", "<p title=\"x y\">", "</p>", "<h1>", "</h1>", "<span>", "</span>", "<section>", "<blockquote>", "</blockquote>", "<dd>"]
        page = " ".join(r.choice(bits) if r.random() < 0.5 else f"word{k}" for k in range(r.randint(0, 40)))
        assert html_text.visible_text(page).split() == brute_text(page)


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<!-- ", "<a b='c' ", "</a ", "<style>/*", "<title>", "&amp", "<b>", "<table><tr><td>", "<ul><li>x", "<blockquote>x", "<style>a{b:c;", "<td rowspan=9 colspan=9>x", "< ", "<p hidden>"])
def test_hostile_pages_take_linear_time(piece):
    """A quarter and a whole megabyte (tables inside tables: less), with room for a slow machine."""
    import time

    small = 16 if piece.startswith("<table") else 1
    times = []
    for size in (250_000, 1_000_000):
        page = piece * (size // small // len(piece))
        began = time.process_time()
        html_text.visible_text(page)
        times.append(time.process_time() - began)
    assert times[1] < 12 and times[1] < 10 * times[0] + 1


def test_long_tables_with_one_long_cell():
    page = "<table>" + "<tr><td>a<td>b" * 20_000 + f"<tr><td>{'long ' * 20_000}<td>c</table>"
    got = html_text.visible_text(page)
    assert len(got) < 2_000_000 and got.count("b") == 20_000 and got.count("long") == 20_000
