import hashlib

import numpy as np

from graphloom.llm import queries, spotsigs

SF = "/root/testdata/sf0.01"


def edited(text, following):
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


def test_query_on_whole_table(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in queries.op4_spotsigs(spark, SF).collect()}
    assert sorted(rows) == sorted(i for i, _ in docs)
    sets = dict(zip((i for i, _ in docs), spotsigs.spots([t for _, t in docs]), strict=True))
    for n, (i, t) in enumerate(docs):
        j, other = docs[(n + 1) % len(docs)]
        e = edited(t, other)
        r = rows[i]
        a, b = set(sets[i].tolist()), set(spotsigs.spots([e])[0].tolist())
        c = set(sets[j].tolist())
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == spotsigs.as_text(sets[i]) and r.edited_fingerprint == spotsigs.as_text(np.array(sorted(b), np.uint32))
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 1e-12
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1)) < 1e-12
    assert np.mean([r.near_edited for r in rows.values()]) > 0.2 > np.mean([r.near_next for r in rows.values()])


def test_spots_equal_a_plain_loop():
    def plain(text):
        words = spotsigs._find(text.lower())
        out = set()
        for i, w in enumerate(words):
            before = words[max(0, i - spotsigs.GAP) : i]
            if w in spotsigs.ANCHORS or not any(x in spotsigs.ANCHORS for x in before):
                out.add((w, *[x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]))
        return out

    texts = ["", "the", "a b c the cat sat on the mat and the dog", " ".join(f"w{i % 17}" for i in range(60)) + " the end of it", "!!!", "x", "der Hund und die Katze"]
    for t, s in zip(texts, spotsigs.spots(texts), strict=True):
        assert len(s) == (len(plain(t)) if spotsigs._find(t) else bool(t))
    assert [x.tolist() for x in spotsigs.spots(texts)] == [spotsigs.spots([t])[0].tolist() for t in texts]


def test_edges(spark, docs):
    rows = [(5, "alpha beta gamma delta", "a"), (5, "alpha beta gamma delta", "a"), (3, None, "a"), (1, "", "b"), (None, "zeta", "b")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in spotsigs.fingerprint(docs(rows), per_bucket=1).collect())
    assert got == [(False, 1, 0), (False, 3, 0), (False, 5, 22), (False, 5, 22), (True, 0, 4)]
    one = spotsigs.fingerprint(docs(rows[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.fingerprint(docs([])).count() == 0


def test_similar_classes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [rng.choice(4000, 40, replace=False) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[: 40 - d], rng.choice(4000, d)])).astype(np.uint32) for b in base for d in (0, 0, 2, 5, 9)]
    df = spark.createDataFrame([(i, spotsigs.as_text(s)) for i, s in enumerate(sets)], "doc_id long, fingerprint string")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = {(a, b) for a in first.values() for b in first.values() if a < b and spotsigs.likeness(sets[a], sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.similar_classes(df).collect()} == want and want
