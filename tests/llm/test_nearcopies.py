import random
from fractions import Fraction

import corpus_pipeline
from quadrille.llm import nearcopies, simhash
from tests.llm import cases


def sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The rows that stay, of (id, text) in their order."""
    found = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            union = len(found[a] | found[b])
            if find(a) != find(b) and (not union or Fraction(len(found[a] & found[b]), union) >= Fraction(4, 5)):
                up[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), (True, 0, len(rows))), (i is None, i or 0, k))
    return sorted(k for _, _, k in best.values())


def copies(seed=5):
    """Chains of edited texts on both sides of 0.8, with lines that many texts share."""
    r = random.Random(seed)
    line = "this one line is in very many of the texts here"
    texts = []
    for _ in range(12):
        words = [f"w{r.randrange(10_000)}" for _ in range(r.choice([3, 6, 30, 120]))] + line.split()
        for _ in range(12):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(r.randint(0, 1 + len(words) // 40)):
                words[r.randrange(len(words))] = f"v{r.randrange(10_000)}"
    r.shuffle(texts)
    return [(i if i % 7 else None, t) for i, t in enumerate(texts)]


def test_groups_equal_brute_force(spark, monkeypatch):
    rows = copies()
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    want = brute(rows)
    assert len(want) < len(rows) - 20
    for rounds, listed in ((0, 0), (2, nearcopies.LISTED)):
        monkeypatch.setattr(nearcopies, "LEADER_ROUNDS", rounds)
        monkeypatch.setattr(nearcopies, "LISTED", listed)
        assert sorted(r.n for r in nearcopies.keep_one(docs.coalesce(1)).collect()) == want


def test_stage_drops_what_differs_in_more_bits_than_op2_allows(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "x", *words[51:]])), (3, " ".join(["y", *words[:30]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).bit_count() > simhash.MAX_BITS
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [1, 3]


def test_repeats_and_rows_without_id(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (5, "other text"), (None, None), (None, ""), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, [docs.collect()[k] for k in brute(rows)])) and len(got) == 4


def test_awkward_rows(spark):
    rows = cases.rows()
    want = sorted(repr(rows[k][:2]) for k in brute([r[:2] for r in rows]))
    assert sorted(repr((r.doc_id, r.text)) for r in nearcopies.keep_one(cases.frame(spark).coalesce(1)).collect()) == want
    assert nearcopies.keep_one(cases.frame(spark).limit(0)).count() == 0


def test_simhash_comes_first(spark, monkeypatch):
    """Pairs come from SimHash's links and are compared exactly; what it alone finds is linked before any file is looked at."""
    r = random.Random(8)
    long = [f"w{r.randrange(10**6)}" for _ in range(4_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-1], "end"])), (3, "other words here and no more"), (4, " ".join(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [simhash.majority(nearcopies.shingles(t.encode())) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.MAX_BITS < (prints[0] ^ prints[2]).bit_count()
    ids = {nearcopies.set_id(nearcopies.shingles(t.encode())): i for i, t in rows[:3]}
    seen = []

    def linked(pairs, heads, numbered, real=nearcopies._linked):
        found = real(pairs, heads, numbered)
        seen.append({tuple(sorted((ids[x.a], ids[x.b]))) for x in found.collect()})
        return found

    monkeypatch.setattr(nearcopies, "_linked", linked)
    assert sorted(x.doc_id for x in nearcopies.keep_one(docs).collect()) == [1, 3]
    assert seen[0] == {(1, 2)} and not any(seen[1:])


def test_a_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies on both sides of 0.8 of one text, whose files hold them all: fewer pairs are compared than 16 for each text."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for i in range(240):
        words = list(base)
        for k in r.sample(range(160), r.randint(1, 4)):
            words[k] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    compared = []

    def linked(pairs, heads, numbered, real=nearcopies._linked):
        compared.append(pairs.count())
        return real(pairs, heads, numbered)

    monkeypatch.setattr(nearcopies, "_linked", linked)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in nearcopies.keep_one(docs.coalesce(1)).collect()) == brute(rows)
    assert sum(compared) < 16 * len(rows)


def test_files_of_a_pair_give_it_once(spark):
    """Two sets that share 30 files in a row are one pair, and so is a pair of the most frequent component and another."""
    rows = [(k, s, s, k, 200, [0, 0, 0, 0]) for s in (1, 2, 3) for k in range(30)] + [(k, 4, 3, k, 200, [0, 0, 0, 0]) for k in range(30)]
    filed = spark.createDataFrame(rows, "key long, set long, root long, pos long, n long, odd array<long>")
    assert sorted(map(tuple, nearcopies._left(filed).collect())) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]
