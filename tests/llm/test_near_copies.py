import random
import re

import pytest

from signalframe.llm import graph, near_copies

from conftest import ODD_TEXTS


def brute(docs, k=5, percent=80):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize(("seed", "sent"), [(1, 2_000_000), (2, 0)])
def test_equals_brute_force(spark, seed, sent, monkeypatch):
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", sent)  # 0: everything is joined by a shuffle
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = [t for t in ODD_TEXTS]
    for family in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 9, 30, 80, 200]))]
        if family % 3 == 0:
            base = passage + base
        for copy in range(rng.choice([1, 2, 9, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            base = t if rng.random() < 0.3 else base  # chains, too
            texts.append((" " if rng.random() < 0.8 else "\n").join(w.upper() if rng.random() < 0.1 else w for w in t))
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = near_copies.near_copy_groups(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs)


@pytest.mark.parametrize(("size", "spread"), [(40, 9), (150, 8), (150, 16)])
def test_a_group_of_which_few_link_to_one_centre(spark, size, spread):
    """Copies up to far beyond the threshold from their base, and from each other's, beside texts that share a passage."""
    rng = random.Random(size + spread)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(size)]
    texts = [" ".join(base)] * 3
    for _ in range(220):
        t = list(base)
        for _ in range(rng.randint(0, spread)):
            t[rng.randrange(len(t))] = rng.choice(vocab[:5] if rng.random() < 0.5 else vocab)
        texts.append(" ".join(t))
        if rng.random() < 0.1:  # a family of its own around a far copy
            for _ in range(4):
                u = list(t)
                u[rng.randrange(len(u))] = rng.choice(vocab)
                texts.append(" ".join(u))
    texts += [" ".join(base[: size // 2] + [rng.choice(vocab) for _ in range(size // 2)]) for _ in range(40)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    want = brute(docs)
    assert 1 < len({c for _, c in want.values()}) < len(docs)
    got = near_copies.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_differences_find_links_that_no_centre_has(spark):
    """Three sets around one centre, none of which links to it; two of them link with each other."""
    centre = list(range(100))
    sets = {1: centre, 2: [*range(20, 100), *range(200, 230)], 3: [*range(20, 100), *range(205, 235)], 4: [*range(80), *range(300, 330)]}
    rows = [(1, x, True, len(s), 100, False, sorted(set(s) ^ set(centre))) for x, s in sets.items() if x > 1]
    members = spark.createDataFrame(rows, "c long, x long, own boolean, n long, centre long, linked boolean, d array<long>")
    assert [tuple(r) for r in near_copies._inner_links(members, 80).collect()] == [(3, 2)]


def test_words_that_a_polynomial_hash_confuses(spark):
    """The Thue-Morse word and its complement collide in any polynomial hash modulo a power of two."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"{word} one two three four"), (2, f"{other} one two three four"), (3, f"{word[:64]} one two three four"), (4, f"{other[:64]} one two three four"), (5, f"{word} ONE two three four")]
    got = near_copies.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_a_doc_id_with_two_texts_links_by_both(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "h i j k l m n"), (3, "h i j k l m n"), (4, "o p q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in near_copies.near_copy_groups(docs).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4)]
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [1, 2, 2, 4]


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "A B C d e f"), (7, None)]
    got = near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (5, 2, 1), (7, 0, 7)]


def test_no_rows(spark):
    assert near_copies.near_copy_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 200), (200, 300), (300, 100), (7, 7), (50, 40), (50, 60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 200: 100, 300: 100, 40: 40, 50: 40, 60: 40}
