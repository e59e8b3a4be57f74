import random

from graphloom.llm import ngram_join


def brute(rows, threshold=0.8):
    def grams(text):
        w = ngram_join._find(text or "")
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    sets = [(i, grams(t)) for i, t, _ in rows]
    links = {k: [m for m in range(len(sets)) if m != k and sets[k][1] and len(sets[k][1] & sets[m][1]) / len(sets[k][1] | sets[m][1]) >= threshold] for k in range(len(sets))}
    out = []
    for k in range(len(sets)):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((sets[k][0], min(sets[m][0] for m in seen), len(links[k])))
    return sorted(out)


def test_equals_brute_force(spark, docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for size in (3, 8, 30, 80):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for copies in range(rng.choice([1, 2, 6])):
                w = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    w[rng.randrange(size)] = word()
                rows.append((n, " ".join(w), "a"))
                n += 1
    base = [word() for _ in range(120)]
    for _ in range(70):  # a large group of near copies: several tiles
        w = list(base)
        w[rng.randrange(120)] = word()
        rows.append((n, "  ".join(w), "hot"))
        n += 1
    rows += [(n, "", "a"), (n + 1, None, "a"), (n + 2, "\n", "a"), (n + 3, "one two", "a"), (n + 4, "one  two", "b"), (n + 5, rows[0][1], "a")]
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(docs(rows), block=16).collect())
    assert got == brute(rows)


def test_edges(spark, docs):
    assert ngram_join.near_duplicates(docs([])).count() == 0
    rows = [(7, "a b c d e f", "x"), (7, "a b c d e f", "x"), (None, "a b c d e f", "x"), (9, "long " * 30_000, "x")]
    got = ngram_join.near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in got) == [(-1, -1, 0), (7, 7, 1), (7, 7, 1), (9, 9, 0)]


def test_bands_reach_the_recall():
    b = ngram_join.bands_for()
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** b >= ngram_join.RECALL


def test_ids_that_stand_on_several_texts(spark, docs):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "alpha beta gamma delta epsilon zeta eta theta iota kappa la mu"
    rows = [(1, a, "x"), (1, b, "x"), (2, b + " nu", "x"), (3, a + " more", "x"), (3, "else", "x"), (1, a, "x")]
    got = ngram_join.near_duplicates(docs(rows)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows)) and (2, 1, 1) in {tuple(r) for r in got}


def test_layers_and_repeated_ids_equal_brute_force(spark, docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(400)]
    rows = [(i, " ".join(base[: 40 + 6 * i] + [f"x{i}"] * (i % 3)), "a") for i in range(60)]
    rows += [(i % 20, " ".join(base[10 : 150 + i]), "b") for i in range(40)]
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(docs(rows), block=4, recall=0.999999).collect())
    assert got == brute(rows)


def test_candidates_reach_the_recall_near_the_threshold(spark, docs):
    """Pairs of 0.80 to 0.84: their sets share a band; the shares of pairs found are those of the formula."""
    rng = random.Random(8)
    rows, n = [], 0
    for k in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(130)]
        rows += [(n, " ".join(base), "a"), (n + 1, " ".join([*base, *(f"y{k}x{i}" for i in range(24 + k % 8))]), "a")]
        n += 2
    sims = {i: 126 / (126 + 24 + i // 2 % 8) for i in range(0, n, 2)}
    got = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(docs(rows)).collect()}
    near = [i for i, s in sims.items() if s >= 0.8]
    assert len(near) > 300 and sum(got[i + 1] == i for i in near) / len(near) >= 0.99 and all(got[i + 1] == i + 1 for i, s in sims.items() if s < 0.8)
